"""Registered queries over what is carried through cuts and joins, and over documents of scenes and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import media
from ..operators import carry as op
from ..operators import frames, intervals
from ..sources import projects as io
from . import adapters as src
from .adapters import table, with_tables
from .frame_queries import _JUMPS, JUMP_MS, NOMINAL_MS

DAY = 86_400_000
HOUR = 3_600_000


def _index(spark, sf_dir):
    return frames.frame_index(src.packets(spark, sf_dir))


def native_frames(spark, sf_dir):
    native = _index(spark, sf_dir)
    joined = frames.collapse_field_pairs(native, NOMINAL_MS)
    number = (F.row_number().over(W.partitionBy("rec_id").orderBy("pts")) - 1).cast("long")
    return op.native_frames(joined.select("rec_id", number.alias("frame_no"), "pts"), native)


def _keeps(spark, sf_dir):
    spans = src.frame_spans(spark, sf_dir).where("a >= 0 AND b >= a AND b < 40").select("rec_id", F.col("a").alias("start_f"), F.col("b").alias("end_f"))
    return intervals.union(spans.where("start_f % 7 = 0"))


def cut_seconds(spark, sf_dir):
    return op.cut_seconds(_keeps(spark, sf_dir), _index(spark, sf_dir), 1000.0)


def display_order(spark, sf_dir):
    p = src.packets(spark, sf_dir)
    late = F.when(F.col("seq") % 7 == 0, F.col("pts") + 9 * HOUR).otherwise(F.col("pts"))
    return op.display_order(p.select("rec_id", "seq", late.alias("pts")))


def _decoded(spark, sf_dir):
    """Pictures that come up to 90 hours late, some without pts or decoding time; in some recordings more than a buffer holds."""
    p = src.packets(spark, sf_dir)
    ms, r, q = F.coalesce("pts", F.lit(0)), F.col("rec_id"), F.col("seq")
    late = F.when(q % 7 == 0, ms + F.when(r % 3 == 0, 90 * HOUR).otherwise(9 * HOUR)).otherwise(ms)
    pts = F.when(F.col("pts").isNotNull() & ~((r % 5 == 0) & (q % 29 == 0)), F.when((r % 4 == 0) & (q % 2 == 0), ms + 400 * HOUR).otherwise(late))
    return p.select("rec_id", "seq", pts.alias("pts"), F.when(q % 11 > 0, F.col("pts")).alias("dts"))


def reorder_buffer(spark, sf_dir):
    return op.reordered(_decoded(spark, sf_dir)).withColumn("pts", F.coalesce("pts", F.lit(-1)))


def _subtitles(spark, sf_dir):
    p = src.packets(spark, sf_dir).where("pts IS NOT NULL AND config % 2 = 1")
    return p.select("rec_id", "seq", F.when(F.col("seq") % 5 == 0, F.col("pts") - 30 * HOUR).otherwise(F.col("pts")).alias("pts"))


def subtitle_slice(spark, sf_dir):
    return op.sliced_subtitles(_subtitles(spark, sf_dir), src.keep_spans(spark, sf_dir), frames.clock_jumps(_index(spark, sf_dir), JUMP_MS), DAY)


def sound_slice(spark, sf_dir):
    p = src.packets(spark, sf_dir).where("pts IS NOT NULL AND config % 2 = 0")
    start = p.groupBy("rec_id").agg((F.min("pts") + 40_000_000).alias("lo"))
    rel = lambda d, *c: d.join(start, "rec_id").withColumns({x: F.col(x) - F.col("lo") for x in c}).drop("lo")
    late = F.when(F.col("seq") % 9 == 0, F.col("pts") - 12 * HOUR).otherwise(F.col("pts"))
    jumps = frames.clock_jumps(_index(spark, sf_dir), JUMP_MS).join(start, "rec_id").select("rec_id", (F.col("split2") - F.col("lo") * 2).alias("split2"), "amount")
    return op.sliced_sound(rel(p.select("rec_id", "seq", late.alias("pts")), "pts"), rel(src.keep_spans(spark, sf_dir), "s", "e"), jumps, DAY)


def sound_graft(spark, sf_dir):
    p = src.packets(spark, sf_dir).where("pts IS NOT NULL").select("rec_id", F.col("config").cast("long").alias("track"), "seq", "pts")
    start = p.groupBy("rec_id").agg(F.min("pts").alias("lo"))
    spans = src.keep_spans(spark, sf_dir).join(start, "rec_id").select("rec_id", "k", (F.col("s") - F.col("lo")).alias("s"), (F.col("e") - F.col("lo")).alias("e"))
    return op.grafted(p, spans, DAY)


def _scenes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("list_id"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("length"), "role")


def subtitle_carry(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    n = F.explode(F.sequence(F.lit(0), F.lit(4)))
    sets = s.where("role = 'user'").withColumn("n", n).select("list_id", "seq", F.col("n").cast("long").alias("id"), (F.col("n") * 40 + F.col("length") % 50 - 20).cast("long").alias("rel"))
    return op.carried_subtitles(sets, s.select("list_id", "seq", "length"))


def _joins(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    source = F.when(F.col("length") % 11 == 0, "").otherwise(F.concat(F.lit("/tv/s"), F.col("length").cast("string"), F.lit(".a.mkv")))
    kind = F.when(F.col("seq") % 3 == 0, "title").otherwise("scene")
    cut = F.array(F.array(F.col("seq").cast("double"), F.col("length") / 2.0))
    return s.select(F.concat(F.lit("j"), F.col("list_id").cast("string")).alias("name"), "seq", kind.alias("kind"), source.alias("source"), (F.col("length") / 4.0).alias("start"), (F.col("length") / 2.0 - 10).alias("end"), cut.alias("cuts"))


def scene_list_roundtrip(spark, sf_dir):
    j = _joins(spark, sf_dir)
    size = F.substring("name", 2, 9).cast("long")
    target = j.select("name").distinct().select("name", F.when(size % 2 == 0, size % 5 * 320).alias("w"), F.lit(720).alias("h"), F.lit(25.0).alias("fps"))
    out = io.read_scene_list(io.write_scene_list(j, target))
    return out.select("name", F.col("seq").cast("long").alias("seq"), "kind", "source", "start", "end", "duration", F.get(F.get("cuts", F.lit(0)), F.lit(1)).alias("cut_end"), F.coalesce(F.get("target", F.lit(0)), F.lit(-1.0)).alias("width"))


def joined_names(spark, sf_dir):
    j = _joins(spark, sf_dir)
    return io.joined_paths(j, j.select("name").distinct().withColumn("folder", F.lit("/queue")))


def chapters_read(spark, sf_dir):
    p = src.packets(spark, sf_dir)
    return io.read_chapters(p.select("rec_id", (F.col("pts") % 100_000 - 9000).alias("start"), F.when(F.col("config") == 1, 0).otherwise(1).alias("num"), F.col("config").alias("den")))


def _lines(spark, sf_dir):
    spans = src.frame_spans(spark, sf_dir).where("id % 5 = 0")
    hours = lambda c: F.format_string("%.2f", F.col(c) * 3600 * 0.5)
    line = F.when(F.col("id") % 45 == 0, "# a note").otherwise(F.concat(hours("a"), F.lit(" "), hours("b"), F.lit("  0")))
    return spans.select(F.col("rec_id").cast("string").alias("name"), F.col("id").alias("place"), line.alias("line"))


def cut_list_keeps(spark, sf_dir):
    return io.cut_list_keeps(_lines(spark, sf_dir), _index(spark, sf_dir), 1000.0)


def any_format_roundtrip(spark, sf_dir):
    c = src.cuts(spark, sf_dir).where("b > a")
    ext = F.when(F.col("rec_id") % 3 == 0, ".EDL").when(F.col("rec_id") % 3 == 1, ".swproj").otherwise(".vprj")
    cuts = c.select(F.concat(F.lit("r"), F.col("rec_id").cast("string"), ext).alias("name"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    made = io.write_any(cuts, 25.0)
    return io.read_any(made, made.select("name", F.lit(1_000_000).cast("long").alias("frames"), F.lit(25.0).alias("fps")))


def media_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    codec = F.element_at(F.array(*[F.lit(x) for x in ("h264", "hevc", "mpeg2video", "dts", "weird")]), (k % 5 + 1).cast("int"))
    order = F.element_at(F.array(*[F.lit(x) for x in ("progressive", "TT", "bt", "other", "")]), (k % 5 + 1).cast("int"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 4 == 1, F.when(k % 3 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("id"), k.cast("string")))
    return p.select(
        k.alias("id"), media.named(codec, media.CODECS).alias("codec"), media.field_order(order).alias("fields"), media.profile_level(codec, F.when(k % 3 > 0, "Main"), k % 52 - 1).alias("level"),
        media.stream_id(raw, k).alias("stream"), media.duration_timecode(k * 1.37 - 5, F.when(k % 2 == 0, F.lit(25.0)).otherwise(0.0)).alias("length"),
        media.batch_format(F.element_at(F.array(F.lit("mkv"), F.lit("match"), F.lit("mp4")), (k % 3 + 1).cast("int"))).alias("fmt"), media.output_extension(F.when(k % 3 == 0, "mkv").otherwise("ts"), F.when(k % 2 == 0, "/a.b/film.m2ts").otherwise("/a.b/film")).alias("ext"),
    )


_EXTENSIONS = ("mp4", ".MKV", "mov", "webm", "avi", "ts", "mp3", ".ogg", "flac", "WAV", "m4a", "ipod")


def container_rules(spark, sf_dir):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (k % 12 + 1).cast("int"))
    picture = F.element_at(F.array(*[F.lit(x) for x in ("h264", " H265 ", "vp9", "hevc")]), (F.floor(k / 12) % 4 + 1).cast("int"))
    limits = media.level_limits(k % 14 + 29)
    known = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.array_join(media.sound_codecs(ext), " ").alias("sound"), F.array_join(media.picture_codecs(ext), " ").alias("pictures"), media.fitting_sound(F.lit("passthru"), ext).alias("chosen"),
        media.rate_factor(k % 9).alias("factor"), F.array_join(media.container_faults(picture, ext, k % 3), "; ").alias("faults"), known(limits["rate"]).alias("rate"), known(limits["buffer"]).alias("buffer"),
    )


def completion_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pair = lambda a, b, x, y: F.struct(x.alias(a), y.alias(b))
    tracks = F.when(k % 4 == 0, F.array(pair("codec", "language", F.lit("dvb_subtitle"), F.lit("eng")), pair("codec", "language", F.lit("odd"), F.lit("")))).when(k % 4 == 1, F.array().cast("array<struct<codec: string, language: string>>")).when(k % 4 == 2, F.array(pair("codec", "language", F.lit(None).cast("string"), F.lit("deu"))))
    stats = F.struct(
        F.concat(F.lit("/out/"), k.cast("string"), F.lit(".mkv")).alias("path"), (k / 4).alias("seconds"), (k * 1_500_000).alias("size"), F.when(k % 5 > 0, k % 7).alias("scenes"), (k * 9).alias("frames"), (k * 11).alias("sound_frames"), (k % 3).alias("sound_tracks"),
        tracks.alias("subtitles"), (k % 64 / 8.0).alias("took"), F.when(k % 6 > 0, k / 2).alias("rate"), (k * 1250).alias("bitrate"),
    )
    notes = F.when(k % 3 == 0, F.array(pair("label", "text", F.lit("Audio"), F.lit("rebuilt")), pair("label", "text", F.lit("Clock"), k.cast("string"))))
    errors = F.when(k % 7 == 0, F.array(pair("label", "text", F.lit("Video"), F.lit("short"))))
    return o.select(k.alias("id"), F.array_join(media.completion_lines(F.lit("Export complete"), stats, notes, errors), "\n").alias("report"))


def header_bits(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    digits = F.sha2("url", 256)
    data = F.unhex(F.concat(F.when(F.col("page_id") % 4 > 0, "FFF1").otherwise("FF00"), F.substring(digits, 1, 12)))
    return d.select(F.col("page_id").alias("id"), F.coalesce(media.header_channels(data), F.lit(-1)).cast("long").alias("channels"), F.coalesce(media.header_length(data), F.lit(-1)).cast("long").alias("length"))


def print_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 300).cast("int") % 256)
    text = media.print_text(values)
    return e.select(F.col("vec_id").alias("id"), text.alias("text"), F.aggregate(media.print_values(text), F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def command_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat_ws(",", k, k + 1, k + 2)).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(",x"))).otherwise(F.concat_ws(", ", k, k + 5, k + 9, -k))
    words = F.when(k % 2 == 0, F.array(F.lit("in"), F.lit("--keep"), F.concat(F.lit("-"), k.cast("string")), F.lit("-c"), F.lit("--frames"))).otherwise(F.array(F.lit("-k"), F.lit("1:2"), F.lit("-c")))
    line = media.completion_line(F.lit("Scene"), F.lit("/out/a b.mkv"), k / 3, k * 1_500_000, k * 9, k / 7)
    pairs = media.frame_pairs(text)
    return o.select(k.alias("id"), F.coalesce(F.size(pairs), F.lit(-1)).cast("long").alias("pairs"), F.coalesce(F.element_at(pairs, -1)["b"], F.lit(-1)).alias("last"), F.array_join(media.option_value(words), "|").alias("values"), line.alias("line"))


QUERIES = {
    f.__name__: f
    for f in (native_frames, cut_seconds, display_order, reorder_buffer, subtitle_slice, sound_slice, sound_graft, subtitle_carry, scene_list_roundtrip, joined_names, chapters_read, cut_list_keeps, any_format_roundtrip, media_labels, container_rules, completion_reports, header_bits, print_roundtrip, command_texts)
}

_COLLAPSE = f"""gated AS (SELECT rec_id, bool_or(step > 0 AND step < {NOMINAL_MS} * 0.75) AS gate FROM (SELECT rec_id, lead(pts) OVER (PARTITION BY rec_id ORDER BY pts, frame_no) - pts AS step FROM frames) GROUP BY rec_id),
walk AS (SELECT f.rec_id, 0::BIGINT AS n, f.pts AS kept, coalesce(g.gate, false) AS gate FROM frames f JOIN gated g USING (rec_id) WHERE frame_no = 0
UNION ALL SELECT f.rec_id, f.frame_no, CASE WHEN w.gate AND f.pts - w.kept < {NOMINAL_MS} * 0.75 THEN w.kept ELSE f.pts END, w.gate FROM walk w JOIN frames f ON f.rec_id = w.rec_id AND f.frame_no = w.n + 1),
joined AS (SELECT rec_id, kept AS pts, row_number() OVER (PARTITION BY rec_id ORDER BY kept) - 1 AS frame_no FROM (SELECT DISTINCT rec_id, kept FROM walk))"""
_SCENES = "sc AS (SELECT conv_id AS list_id, turn AS seq, CAST(length(text) AS BIGINT) AS length, role FROM conversations)"
_JOINS = f"{_SCENES}, jn AS (SELECT 'j' || list_id AS name, row_number() OVER (PARTITION BY list_id ORDER BY seq) - 1 AS seq, seq AS turn, CASE WHEN seq % 3 = 0 THEN 'title' ELSE 'scene' END AS kind, CASE WHEN length % 11 = 0 THEN '' ELSE '/tv/s' || length || '.a.mkv' END AS source, length / 4.0::DOUBLE AS start, length / 2.0::DOUBLE - 10 AS \"end\", length / 2.0::DOUBLE AS cut_end, list_id FROM sc)"
_KEEPS = "kp AS (SELECT DISTINCT rec_id, unnest(generate_series(a, b)) AS d FROM frame_spans WHERE a >= 0 AND b >= a AND b < 40 AND a % 7 = 0)"
ORACLES = {
    "native_frames": with_tables("frames", f"WITH RECURSIVE {_COLLAPSE}, c AS (SELECT rec_id, (SELECT count(*) FROM joined j WHERE j.rec_id = f.rec_id) <> count(*) AS collapsed FROM frames f GROUP BY rec_id) SELECT j.rec_id, j.frame_no, CASE WHEN collapsed THEN (SELECT f.frame_no FROM frames f WHERE f.rec_id = j.rec_id ORDER BY abs(f.pts - j.pts), f.pts, f.frame_no LIMIT 1) ELSE j.frame_no END AS native_no, collapsed FROM joined j JOIN c USING (rec_id)").replace("WITH ev AS", "WITH RECURSIVE ev AS").replace(", RECURSIVE gated", ", gated"),
    "cut_seconds": with_tables("frames frame_spans", f"WITH {_KEEPS}, w AS (SELECT f.rec_id, f.frame_no AS d FROM frames f WHERE f.rec_id IN (SELECT rec_id FROM frames)), z AS (SELECT * FROM w EXCEPT SELECT * FROM kp), g AS (SELECT rec_id, min(d) AS x, max(d) AS y FROM (SELECT *, d - row_number() OVER (PARTITION BY rec_id ORDER BY d) AS grp FROM z) GROUP BY rec_id, grp), st AS (SELECT rec_id, min(pts) AS start FROM frames GROUP BY rec_id) SELECT g.rec_id, (p.pts - start) / 1000.0::DOUBLE AS a, (q.pts - start) / 1000.0::DOUBLE AS b FROM g JOIN st USING (rec_id) JOIN frames p ON p.rec_id = g.rec_id AND p.frame_no = x JOIN frames q ON q.rec_id = g.rec_id AND q.frame_no = y"),
    "display_order": with_tables("packets", f"WITH p AS (SELECT rec_id, seq, CASE WHEN seq % 7 = 0 THEN pts + {9 * HOUR} ELSE pts END AS pts FROM packets WHERE pts IS NOT NULL), n AS (SELECT rec_id, seq, row_number() OVER (PARTITION BY rec_id ORDER BY pts, seq) - 1 AS place, row_number() OVER (PARTITION BY rec_id ORDER BY seq) - 1 AS came FROM p) SELECT rec_id, seq, place, greatest(0, came - place) AS held, greatest(0, came - place) <= 15 AS in_depth FROM n"),
    "reorder_buffer": with_tables("packets", f"WITH RECURSIVE d AS (SELECT rec_id, seq, CASE WHEN seq % 11 > 0 THEN pts END AS dts, CASE WHEN pts IS NOT NULL AND NOT (rec_id % 5 = 0 AND seq % 29 = 0) THEN CASE WHEN rec_id % 4 = 0 AND seq % 2 = 0 THEN pts + {400 * HOUR} WHEN seq % 7 = 0 THEN pts + CASE WHEN rec_id % 3 = 0 THEN {90 * HOUR} ELSE {9 * HOUR} END ELSE pts END END AS pts FROM packets), "
        "n AS (SELECT *, coalesce(last_value(dts IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS now, {'p': coalesce(pts, -1), 's': seq, 'k': pts IS NOT NULL} AS x FROM d), "
        "w AS (SELECT rec_id, 0::BIGINT AS seq, [x][1:0] AS held, [x][1:0] AS gone FROM n WHERE seq = 1 UNION ALL SELECT h.rec_id, h.seq, h.held[h.k + 1:], h.held[:h.k] FROM (SELECT g.*, greatest(0, least(len(held) - 15, len(list_filter(held, lambda z: z.p <= g.now)))) AS k FROM (SELECT n.rec_id, n.seq, n.now, list_sort(list_append(w.held, n.x)) AS held FROM w JOIN n ON n.rec_id = w.rec_id AND n.seq = w.seq + 1) g) h), "
        "f AS (SELECT rec_id, seq, unnest(gone) AS x, unnest(range(len(gone))) AS i FROM w UNION ALL SELECT rec_id, seq + 1, unnest(held), unnest(range(len(held))) FROM (SELECT rec_id, seq, held[:coalesce(nullif(list_position(list_transform(held, lambda z: z.k), false), 0) - 1, len(held))] AS held FROM w QUALIFY seq = max(seq) OVER (PARTITION BY rec_id))) "
        "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seq, i) - 1 AS place, x.s AS seq, CASE WHEN x.k THEN x.p ELSE -1 END AS pts FROM f").replace("WITH ev AS", "WITH RECURSIVE ev AS").replace(", RECURSIVE d AS", ", d AS"),
    "subtitle_slice": with_tables("frames keep_spans", f"WITH {_JUMPS}, sb AS (SELECT rec_id, seq, CASE WHEN seq % 5 = 0 THEN pts - {30 * HOUR} ELSE pts END AS pts FROM packets WHERE pts IS NOT NULL AND config % 2 = 1), ji AS (SELECT k.rec_id, k.k, split2, amount FROM keep_spans k JOIN jumps j ON j.rec_id = k.rec_id AND split2 > s * 2 AND split2 < e * 2), ln AS (SELECT k.*, e - s - coalesce((SELECT sum(amount) FROM ji WHERE ji.rec_id = k.rec_id AND ji.k = k.k), 0) AS length FROM keep_spans k), la AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY rec_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM ln), ot AS (SELECT sb.rec_id, sb.seq, la.k, CAST(sb.pts - s - coalesce((SELECT sum(amount) FROM ji WHERE ji.rec_id = sb.rec_id AND ji.k = la.k AND split2 <= sb.pts * 2), 0) + begin AS BIGINT) AS out FROM sb JOIN la ON la.rec_id = sb.rec_id AND sb.pts >= s AND sb.pts < e), rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq, k) AS r FROM ot), wk AS (SELECT rec_id, seq, k, out, r FROM rk WHERE r = 1 UNION ALL SELECT x.rec_id, x.seq, x.k, CASE WHEN x.out < w.out THEN w.out + 1 ELSE x.out END, x.r FROM wk w JOIN rk x ON x.rec_id = w.rec_id AND x.r = w.r + 1) SELECT rec_id, seq, k, out FROM wk").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "sound_slice": with_tables("frames keep_spans", f"WITH {_JUMPS}, lo AS (SELECT rec_id, min(pts) + 40000000 AS lo FROM packets WHERE pts IS NOT NULL AND config % 2 = 0 GROUP BY rec_id), sb AS (SELECT p.rec_id, seq, CASE WHEN seq % 9 = 0 THEN pts - {12 * HOUR} ELSE pts END - lo AS pts FROM packets p JOIN lo USING (rec_id) WHERE pts IS NOT NULL AND config % 2 = 0), kk AS (SELECT k.rec_id, k, s - lo AS s, e - lo AS e FROM keep_spans k JOIN lo USING (rec_id)), ji AS (SELECT k.rec_id, k.k, split2 - lo * 2 AS split2, amount FROM kk k JOIN lo USING (rec_id) JOIN jumps j ON j.rec_id = k.rec_id AND split2 - lo * 2 > s * 2 AND split2 - lo * 2 < e * 2), ln AS (SELECT k.*, e - s - coalesce((SELECT sum(amount) FROM ji WHERE ji.rec_id = k.rec_id AND ji.k = k.k), 0) AS length FROM kk k), la AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY rec_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM ln), ot AS (SELECT sb.rec_id, sb.seq, la.k, CAST(sb.pts - s - coalesce((SELECT sum(amount) FROM ji WHERE ji.rec_id = sb.rec_id AND ji.k = la.k AND split2 <= sb.pts * 2), 0) + begin AS BIGINT) AS out FROM sb JOIN la ON la.rec_id = sb.rec_id AND (sb.pts >= s OR s <= 0) AND sb.pts < e), rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq) AS r FROM ot) SELECT rec_id, seq, k, CAST(max(out - r) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + r AS BIGINT) AS out FROM rk"),
    "sound_graft": with_tables("packets keep_spans", "WITH p AS (SELECT rec_id, CAST(config AS BIGINT) AS track, seq, pts FROM packets WHERE pts IS NOT NULL), o AS (SELECT rec_id, min(pts) AS origin FROM p WHERE track = (SELECT min(track) FROM p q WHERE q.rec_id = p.rec_id) GROUP BY rec_id), lo AS (SELECT rec_id, min(pts) AS lo FROM p GROUP BY rec_id), k AS (SELECT rec_id, s - lo AS s, e - lo AS e, coalesce(sum(e - s) OVER (PARTITION BY rec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM keep_spans JOIN lo USING (rec_id)) SELECT p.rec_id, p.track, p.seq, CAST(p.pts - origin - s + b AS BIGINT) AS out FROM p JOIN o USING (rec_id) JOIN k ON k.rec_id = p.rec_id AND p.pts - origin >= s AND p.pts - origin < e"),
    "subtitle_carry": f"WITH {_SCENES}, l AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY list_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sc) SELECT list_id, off + n * 40 + length % 50 - 20 AS at, 'show' AS kind, n AS id FROM l, (SELECT unnest(range(5)) AS n) WHERE role = 'user' AND n * 40 + length % 50 - 20 >= 0 AND n * 40 + length % 50 - 20 < length UNION ALL SELECT list_id, off + length, 'clear', -1 FROM l WHERE role = 'user'",
    "scene_list_roundtrip": f"WITH {_JOINS} SELECT name, seq, kind, source, start, \"end\", greatest(0, \"end\" - start) AS duration, cut_end, CASE WHEN list_id % 2 = 0 THEN list_id % 5 * 320 ELSE -1 END::DOUBLE AS width FROM jn",
    "joined_names": f"WITH {_JOINS}, f AS (SELECT name, arg_min(source, turn) AS s FROM jn WHERE kind <> 'title' AND source <> '' GROUP BY name) SELECT DISTINCT jn.name, CASE WHEN s IS NULL THEN '/queue/Joined Video.ts' ELSE replace(s, '.mkv', ' - Joined.mkv') END AS path FROM jn LEFT JOIN f USING (name)",
    "chapters_read": with_tables("packets", "WITH c AS (SELECT rec_id, (pts % 100000 - 9000)::DOUBLE / config AS t FROM packets WHERE pts IS NOT NULL AND config NOT IN (0, 1)) SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS place, t AS at FROM c WHERE t >= 0"),
    "cut_list_keeps": with_tables("frames frame_spans", "WITH st AS (SELECT rec_id, min(pts) AS start, count(*) AS n FROM frames GROUP BY rec_id), ct AS (SELECT rec_id, id, least(a, b) * 1800000 AS x, greatest(a, b) * 1800000 AS y FROM frame_spans WHERE id % 5 = 0 AND id % 45 > 0), pr AS (SELECT c.rec_id, start + greatest(0, x) AS qx, start + greatest(0, y) AS qy FROM ct c JOIN st USING (rec_id)), hit AS (SELECT rec_id, (SELECT f.frame_no FROM frames f WHERE f.rec_id = p.rec_id ORDER BY abs(f.pts - qx), f.pts, f.frame_no LIMIT 1) AS fx, (SELECT f.frame_no FROM frames f WHERE f.rec_id = p.rec_id ORDER BY abs(f.pts - qy), f.pts, f.frame_no LIMIT 1) AS fy FROM pr p), gone AS (SELECT DISTINCT rec_id, unnest(generate_series(fx, fy)) AS d FROM hit), z AS (SELECT rec_id, frame_no AS d FROM frames EXCEPT SELECT * FROM gone) SELECT rec_id, min(d) AS start_f, max(d) AS end_f FROM (SELECT *, d - row_number() OVER (PARTITION BY rec_id ORDER BY d) AS g FROM z) GROUP BY rec_id, g"),
    "any_format_roundtrip": with_tables("cuts", "SELECT 'r' || rec_id || CASE rec_id % 3 WHEN 0 THEN '.EDL' WHEN 1 THEN '.swproj' ELSE '.vprj' END AS name, a::DOUBLE AS a, b::DOUBLE AS b FROM cuts WHERE b > a"),
    "media_labels": "WITH p AS (SELECT p_partkey AS k, ['h264', 'hevc', 'mpeg2video', 'dts', 'weird'][p_partkey % 5 + 1] AS codec, p_partkey * 1.37::DOUBLE - 5 AS t FROM part), q AS (SELECT *, CAST(floor(t) AS BIGINT) AS w, t - floor(t) AS f FROM p) SELECT k AS id, ['H.264', 'HEVC', 'MPEG-2', 'DTS', 'weird'][k % 5 + 1] AS codec, ['Progressive', 'Interlaced (top field first)', 'Interlaced (bottom field first)', 'Interlaced', 'Unknown'][k % 5 + 1] AS fields, CASE WHEN k % 3 = 0 THEN 'N/A' WHEN codec IN ('h264', 'hevc') AND k % 52 - 1 > 0 THEN 'Main/' || printf('%.1f', (k % 52 - 1) / 10.0::DOUBLE) WHEN codec = 'mpeg2video' AND k % 52 - 1 IN (4, 6, 8, 10) THEN 'Main@' || CASE k % 52 - 1 WHEN 4 THEN 'High' WHEN 6 THEN 'High 1440' WHEN 8 THEN 'Main' ELSE 'Low' END ELSE 'Main' END AS level, CASE k % 4 WHEN 0 THEN 'x' || upper(hex(k)) WHEN 1 THEN CASE WHEN k % 3 = 0 THEN '0' || k ELSE 'x' || upper(hex(k)) END WHEN 2 THEN 'id' || k ELSE '#' || k END AS stream, CASE WHEN t < 0 THEN 'N/A' ELSE printf('%02d:%02d:%02d.%02d', w // 3600, w % 3600 // 60, w % 60, CASE WHEN k % 2 = 0 THEN least(24, CAST(round_even(f * 25, 0) AS BIGINT)) ELSE CAST(floor(f * 100) AS BIGINT) END) END AS length, ['mkv', 'ts', 'mp4'][k % 3 + 1] AS fmt, CASE WHEN k % 3 = 0 THEN '.mkv' WHEN k % 2 = 0 THEN '.m2ts' ELSE '.ts' END AS ext FROM q",
    "container_rules": "WITH p AS (SELECT p_partkey AS k, ['mp4', 'mkv', 'mov', 'webm', 'avi', 'ts', 'mp3', 'ogg', 'flac', 'wav', 'm4a', 'ipod'][p_partkey % 12 + 1] AS ext, p_partkey % 12 IN (1, 7) AS dotted, ['h264', 'hevc', 'vp9', 'hevc'][p_partkey // 12 % 4 + 1] AS pic, p_partkey % 14 + 29 AS level FROM part), "
        "s AS (SELECT *, CASE ext WHEN 'mp3' THEN 'libmp3lame' WHEN 'flac' THEN 'flac' WHEN 'wav' THEN 'pcm_s16le pcm_f32le' WHEN 'ogg' THEN 'libopus libvorbis' WHEN 'm4a' THEN 'aac' WHEN 'ipod' THEN 'aac' WHEN 'mkv' THEN 'aac libmp3lame libopus flac pcm_s16le' WHEN 'webm' THEN 'libopus libvorbis' WHEN 'avi' THEN 'libmp3lame pcm_s16le' ELSE 'aac libmp3lame' END AS sound FROM p) "
        "SELECT k AS id, sound, CASE ext WHEN 'mp4' THEN 'h264 hevc av1' WHEN 'mkv' THEN 'h264 hevc vp9 av1' WHEN 'webm' THEN 'vp9 av1' WHEN 'avi' THEN 'h264' ELSE 'h264 hevc' END AS pictures, CASE WHEN NOT dotted AND ext IN ('mp3', 'flac', 'ogg', 'wav', 'm4a', 'ipod') THEN string_split(sound, ' ')[1] ELSE 'passthru' END AS chosen, "
        "CAST(CASE k % 9 WHEN 1 THEN 23 WHEN 3 THEN 14 WHEN 4 THEN 8 WHEN 5 THEN 3 WHEN 6 THEN 0 ELSE 18 END AS INTEGER) AS factor, "
        "concat_ws('; ', CASE WHEN pic = 'h264' AND ext = 'ogg' THEN 'H.264 video codec is not supported in OGG containers' WHEN pic = 'hevc' AND ext IN ('mp3', 'ogg') THEN 'H.265 video codec is not supported in ' || upper(ext) || ' containers' END, CASE WHEN k % 3 > 1 AND ext IN ('ogg', 'mp3', 'm4a', 'flac', 'wav') THEN upper(ext) || ' format can only have 1 audio track, but ' || k % 3 || ' were selected' END) AS faults, "
        "CAST(1250 * CASE level WHEN 30 THEN 10000 WHEN 31 THEN 14000 WHEN 32 THEN 20000 WHEN 40 THEN 20000 WHEN 41 THEN 50000 WHEN 42 THEN 50000 ELSE -0.0008 END AS BIGINT) AS rate, CAST(CASE level WHEN 30 THEN 233472 WHEN 31 THEN 327680 WHEN 32 THEN 468992 WHEN 40 THEN 585728 WHEN 41 THEN 1464320 WHEN 42 THEN 1464320 ELSE -1 END AS BIGINT) AS buffer FROM s",
    "completion_reports": "WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 4.0::DOUBLE) AS BIGINT) AS s FROM orders) SELECT k AS id, concat_ws(chr(10), 'Export complete', '    Output file     : /out/' || k || '.mkv', printf('    Video length    : %02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60), printf('    Video size      : %.0f MB', round_even(k * 1500000 / 1048576.0::DOUBLE, 0)), '    Output scenes   : ' || CASE WHEN k % 5 > 0 THEN k % 7 ELSE 0 END, '    Video frames    : ' || k * 9, '    Audio frames    : ' || k * 11, '    Audio tracks    : ' || k % 3, "
        "CASE k % 4 WHEN 0 THEN '    Subtitles       : DVB subtitles (eng), ODD' WHEN 1 THEN '    Subtitles       : None' WHEN 2 THEN '    Subtitles       : ? (deu)' END, printf('    Processing time : %.1fs', k % 64 / 8.0::DOUBLE), printf('    Frames/sec      : %.0f', CASE WHEN k % 6 > 0 THEN round_even(k / 2.0::DOUBLE, 0) ELSE 0 END), printf('    Video bitrate   : %.2f Mbps', k * 1250 / 1000000.0::DOUBLE), "
        "CASE WHEN k % 3 = 0 THEN '    * Audio - rebuilt' || chr(10) || '    * Clock - ' || k END, CASE WHEN k % 7 = 0 THEN '    ! Video - short' END) AS report FROM o",
    "header_bits": "WITH b AS (SELECT page_id AS id, list_transform(range(6), lambda i: ('0x' || substr(sha256(url), 1 + 2 * i::INT, 2))::BIGINT) AS x FROM pages) SELECT id, CAST(CASE WHEN id % 4 > 0 THEN (x[1] & 1) * 4 + ((x[2] & 192) >> 6) ELSE -1 END AS BIGINT) AS channels, CAST(CASE WHEN id % 4 > 0 THEN (x[2] & 3) * 2048 + x[3] * 8 + ((x[4] & 224) >> 5) ELSE -1 END AS BIGINT) AS length FROM b",
    "print_roundtrip": "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 300) AS BIGINT) % 256) AS v FROM embeddings) SELECT id, to_base64(unhex(array_to_string(list_transform(v, lambda x: printf('%02x', x)), ''))) AS text, CAST(list_sum(v) AS BIGINT) AS total FROM v",
    "command_texts": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN -1 ELSE 2 END::BIGINT AS pairs, CASE WHEN o_orderkey % 5 < 2 THEN -1 ELSE -o_orderkey END::BIGINT AS last, CASE WHEN o_orderkey % 2 = 0 THEN '-' || o_orderkey ELSE '1:2' END AS values, printf('Scene a b.mkv (%02d:%02d:%02d, %.0f MB, %d frames, %.1fs)', s // 3600, s % 3600 // 60, s % 60, round_even(o_orderkey * 1500000 / 1048576.0::DOUBLE, 0), o_orderkey * 9, o_orderkey / 7.0::DOUBLE) AS line FROM (SELECT *, CAST(floor(o_orderkey / 3.0::DOUBLE) AS BIGINT) AS s FROM orders)",
}
