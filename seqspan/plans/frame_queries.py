"""Registered queries over frame indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as op
from . import adapters as src
from .adapters import with_tables

JUMP_MS = 14_400_000
NOMINAL_MS = 7_200_000
LONG_JUMP_MS = 300_000


def _index(spark, sf_dir):
    return op.frame_index(src.packets(spark, sf_dir))


def null_pts_carry(spark, sf_dir):
    return op.carry_null_bytes(src.packets(spark, sf_dir)).select("rec_id", "pts", "bytes", "is_key")


def keyframe_set(spark, sf_dir):
    return op.keyframes(src.packets(spark, sf_dir))


def median_gop(spark, sf_dir):
    return op.upper_median_gap(op.keyframes(src.packets(spark, sf_dir)))


def nearest_frame(spark, sf_dir):
    return op.nearest(_index(spark, sf_dir), src.probes(spark, sf_dir))


def snap_down_up(spark, sf_dir):
    index = _index(spark, sf_dir)
    ends = index.groupBy("rec_id").agg((F.max("pts") + 40).alias("finish"))
    return op.snap(index, src.probes(spark, sf_dir), ends)


def seconds_to_frame(spark, sf_dir):
    index = _index(spark, sf_dir)
    start = index.groupBy("rec_id").agg(F.min("pts").alias("start"))
    asked = src.probes(spark, sf_dir).join(start, "rec_id").select("rec_id", "id", op.seconds_to_ticks(F.col("id") % 40000 * 60.0005, F.col("start"), 1, 1000).alias("q"))
    return op.nearest(index, asked).join(asked, ["rec_id", "id"]).select("rec_id", "id", "q", "frame_no")


def range_bytes(spark, sf_dir):
    return op.range_bytes(_index(spark, sf_dir), src.frame_spans(spark, sf_dir))


def size_estimate(spark, sf_dir):
    sizes = src.packets(spark, sf_dir).groupBy("rec_id").agg(F.when(F.col("rec_id") % 9 > 0, F.sum("size") * 2).otherwise(0).alias("size"))
    index = _index(spark, sf_dir).withColumns({c: F.when(F.col("rec_id") % 5 > 0, F.col(c)).otherwise(0) for c in ("bytes", "cum_bytes")})
    return op.size_estimate(index, src.frame_spans(spark, sf_dir), sizes)


def picture_groups(spark, sf_dir):
    return op.picture_groups(src.packets(spark, sf_dir))


def _coded(spark, sf_dir):
    p = src.packets(spark, sf_dir).where("pts IS NOT NULL")
    unit = F.when(F.col("size") % 9 == 0, None).when(F.col("is_key"), F.col("size") % 4 + 19).otherwise(F.col("size") % 6 + 5)
    return p.select("rec_id", "seq", "pts", F.when(F.col("seq") % 6 > 0, F.col("pts") - F.col("size") % 50).alias("dts"), "is_key", unit.alias("unit"))


def decodable_groups(spark, sf_dir):
    return op.decodable_groups(_coded(spark, sf_dir)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start_dts", "leading_end_dts")})


def clock_jumps(spark, sf_dir):
    return op.clock_jumps(_index(spark, sf_dir), JUMP_MS)


def jumped_lengths(spark, sf_dir):
    return op.jumped_lengths(src.keep_spans(spark, sf_dir), clock_jumps(spark, sf_dir))


def jump_before(spark, sf_dir):
    return op.jump_before(src.probes(spark, sf_dir), clock_jumps(spark, sf_dir))


def field_pair_collapse(spark, sf_dir):
    return op.collapse_field_pairs(_index(spark, sf_dir), NOMINAL_MS)


def _long(spark, sf_dir):
    return src.long_packets(spark, sf_dir)


def long_frame_index(spark, sf_dir):
    """One recording of all rows, dealt by ranges, as are those below."""
    return op.frame_index(_long(spark, sf_dir), ranges=True)


def _long_probes(spark, sf_dir):
    return src.probes(spark, sf_dir).select(F.lit(0).cast("long").alias("rec_id"), "id", (F.col("q") + F.col("id") % 7 * 1000 - 3000).alias("q"))


def long_range_bytes(spark, sf_dir):
    spans = src.frame_spans(spark, sf_dir).select(F.lit(0).cast("long").alias("rec_id"), "id", (F.col("a") * 40 - 30).alias("a"), (F.col("b") * 41).alias("b"))
    return op.range_bytes(long_frame_index(spark, sf_dir), spans)


def long_nearest_frame(spark, sf_dir):
    return op.nearest(long_frame_index(spark, sf_dir), _long_probes(spark, sf_dir), ranges=True)


def long_snap(spark, sf_dir):
    keys = op.keyframes(_long(spark, sf_dir))
    return op.snap(keys, _long_probes(spark, sf_dir), keys.groupBy("rec_id").agg((F.max("pts") + 40).alias("finish")), ranges=True)


def long_median_gop(spark, sf_dir):
    return op.upper_median_gap(op.keyframes(_long(spark, sf_dir)), ranges=True)


def long_clock_jumps(spark, sf_dir):
    return op.clock_jumps(long_frame_index(spark, sf_dir), LONG_JUMP_MS, ranges=True)


def long_jump_before(spark, sf_dir):
    return op.jump_before(_long_probes(spark, sf_dir), long_clock_jumps(spark, sf_dir), ranges=True)


def long_picture_groups(spark, sf_dir):
    return op.picture_groups(_long(spark, sf_dir), ranges=True)


QUERIES = {
    **{f.__name__: f for f in (long_frame_index, long_range_bytes, long_nearest_frame, long_snap, long_median_gop, long_clock_jumps, long_jump_before, long_picture_groups)},
    "frame_index": _index,
    "null_pts_carry": null_pts_carry,
    "keyframe_set": keyframe_set,
    "median_gop": median_gop,
    "nearest_frame": nearest_frame,
    "snap_down_up": snap_down_up,
    "seconds_to_frame": seconds_to_frame,
    "range_bytes": range_bytes,
    "size_estimate": size_estimate,
    "picture_groups": picture_groups,
    "decodable_groups": decodable_groups,
    "clock_jumps": clock_jumps,
    "jumped_lengths": jumped_lengths,
    "jump_before": jump_before,
    "field_pair_collapse": field_pair_collapse,
}

_JUMPS = f"""steps AS (SELECT *, lead(pts) OVER (PARTITION BY rec_id ORDER BY pts, frame_no) - pts AS step FROM frames),
usual AS (SELECT rec_id, greatest(1, CAST(floor(median(step)) AS BIGINT)) AS usual FROM steps WHERE step IS NOT NULL GROUP BY rec_id HAVING count(*) >= 2),
jumps AS (SELECT rec_id, pts * 2 + step AS split2, step - least(usual, step) AS amount FROM steps JOIN usual USING (rec_id) WHERE step > {JUMP_MS})"""
_NEAREST = "(SELECT f.frame_no FROM frames f WHERE f.rec_id = p.rec_id ORDER BY abs(f.pts - p.q), f.pts, f.frame_no LIMIT 1)"
_CLAMPED = """last AS (SELECT rec_id, max(frame_no) AS last FROM frames GROUP BY rec_id),
held AS (SELECT s.rec_id, id, greatest(0, least(last, a)) AS lo, greatest(0, least(last, b)) AS hi, a, b FROM frame_spans s JOIN last USING (rec_id)),
summed AS (SELECT h.rec_id, h.id, h.a, h.b, CAST(coalesce((SELECT sum(bytes) FROM frames f WHERE f.rec_id = h.rec_id AND f.frame_no BETWEEN h.lo AND h.hi), 0) AS BIGINT) AS bytes FROM held h)"""
ORACLES = {
    "decodable_groups": with_tables("packets", "WITH c AS (SELECT rec_id, seq, pts, CASE WHEN seq % 6 > 0 THEN pts - size % 50 END AS dts, is_key, CASE WHEN size % 9 = 0 THEN NULL WHEN is_key THEN size % 4 + 19 ELSE size % 6 + 5 END AS unit FROM packets WHERE pts IS NOT NULL), o AS (SELECT *, is_key AND (seq = min(CASE WHEN is_key THEN seq END) OVER (PARTITION BY rec_id) OR unit IS NULL OR unit BETWEEN 16 AND 21 OR unit BETWEEN 32 AND 34) AS opens FROM c), g AS (SELECT *, CAST(sum(opens::INT) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS gop, coalesce(unit BETWEEN 6 AND 9, false) AS lead FROM o), h AS (SELECT *, min(CASE WHEN NOT lead AND NOT opens THEN seq END) OVER (PARTITION BY rec_id, gop) AS plain, coalesce(max(CASE WHEN opens THEN unit END) OVER (PARTITION BY rec_id, gop) = 21, false) AS cra FROM g WHERE gop >= 0), i AS (SELECT *, cra AND lead AND NOT opens AND (plain IS NULL OR seq < plain) AS ahead FROM h) SELECT rec_id, gop, max(pts) FILTER (opens) AS start_pts, coalesce(max(dts) FILTER (opens), -1) AS start_dts, arg_max(coalesce(dts, pts), seq) AS end_dts, count(*) AS packets, coalesce(CASE WHEN count(*) FILTER (ahead) > 0 THEN CASE WHEN max(plain) IS NOT NULL THEN max(dts) FILTER (seq = plain) ELSE arg_max(coalesce(dts, pts), seq) END END, -1) AS leading_end_dts, coalesce(bool_or(ahead AND unit IN (8, 9)), false) AS skipped FROM i GROUP BY rec_id, gop"),
    "frame_index": with_tables("frames", "SELECT * FROM frames"),
    "null_pts_carry": with_tables("frames", "SELECT rec_id, pts, bytes, is_key FROM frames"),
    "keyframe_set": with_tables("packets", "SELECT DISTINCT rec_id, pts FROM packets WHERE is_key AND pts IS NOT NULL"),
    "median_gop": with_tables("packets", "WITH k AS (SELECT DISTINCT rec_id, pts FROM packets WHERE is_key AND pts IS NOT NULL), g AS (SELECT rec_id, pts - lag(pts) OVER (PARTITION BY rec_id ORDER BY pts) AS gap FROM k) SELECT rec_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS gap FROM g WHERE gap IS NOT NULL GROUP BY rec_id"),
    "nearest_frame": with_tables("frames probes", f"SELECT p.rec_id, p.id, {_NEAREST} AS frame_no FROM probes p WHERE EXISTS (SELECT 1 FROM frames f WHERE f.rec_id = p.rec_id)"),
    "snap_down_up": with_tables("frames probes", "SELECT p.rec_id, p.id, coalesce((SELECT max(pts) FROM frames f WHERE f.rec_id = p.rec_id AND f.pts <= p.q), (SELECT min(pts) FROM frames f WHERE f.rec_id = p.rec_id)) AS down, coalesce((SELECT min(pts) FROM frames f WHERE f.rec_id = p.rec_id AND f.pts >= p.q), (SELECT max(pts) + 40 FROM frames f WHERE f.rec_id = p.rec_id)) AS up, (SELECT f.pts FROM frames f WHERE f.rec_id = p.rec_id ORDER BY abs(f.pts - p.q), f.pts LIMIT 1) AS near FROM probes p WHERE EXISTS (SELECT 1 FROM frames f WHERE f.rec_id = p.rec_id)"),
    "seconds_to_frame": with_tables("frames probes", f"WITH start AS (SELECT rec_id, min(pts) AS start FROM frames GROUP BY rec_id), p AS (SELECT rec_id, id, start + CAST(round_even(id % 40000 * 60.0005::DOUBLE * 1000, 0) AS BIGINT) AS q FROM probes JOIN start USING (rec_id)) SELECT p.rec_id, p.id, p.q, {_NEAREST} AS frame_no FROM p"),
    "range_bytes": with_tables("frames frame_spans", f"WITH {_CLAMPED} SELECT rec_id, id, bytes FROM summed"),
    "size_estimate": with_tables("frames frame_spans", f"WITH {_CLAMPED}, k AS (SELECT rec_id, CAST(sum(b - a + 1) AS BIGINT) AS kept_frames, sum(bytes) AS kept_bytes FROM summed WHERE b >= a GROUP BY rec_id), w AS (SELECT rec_id, sum(bytes) AS video_bytes, count(*) AS frames FROM frames GROUP BY rec_id), z AS (SELECT rec_id, CASE WHEN rec_id % 9 > 0 THEN sum(size) * 2 ELSE 0 END AS size FROM packets GROUP BY rec_id) SELECT rec_id, kept_frames, round(CASE WHEN size <= 0 THEN 0 WHEN rec_id % 5 = 0 THEN size * (kept_frames / frames::DOUBLE) ELSE kept_bytes + greatest(0, size - video_bytes) * (kept_frames / frames::DOUBLE) END::DOUBLE, 3) AS estimate FROM k JOIN w USING (rec_id) JOIN z USING (rec_id)"),
    "picture_groups": with_tables("packets", "WITH m AS (SELECT *, CASE WHEN is_key OR row_number() OVER (PARTITION BY rec_id ORDER BY seq) = 1 THEN 1 ELSE 0 END AS st FROM packets WHERE pts IS NOT NULL), g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS gop FROM m) SELECT rec_id, gop, min(pts) AS start_pts, max(pts) AS end_pts, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY rec_id, gop"),
    "clock_jumps": with_tables("frames", f"WITH {_JUMPS} SELECT * FROM jumps"),
    "jumped_lengths": with_tables("frames keep_spans", f"WITH {_JUMPS}, o AS (SELECT k.*, CAST(coalesce((SELECT sum(amount) FROM jumps j WHERE j.rec_id = k.rec_id AND j.split2 > k.s * 2 AND j.split2 < k.e * 2), 0) AS BIGINT) AS jumped FROM keep_spans k) SELECT rec_id, k, s, e, jumped, e - s - jumped AS out_length, CAST(coalesce(sum(e - s - jumped) OVER (PARTITION BY rec_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM o"),
    "jump_before": with_tables("frames probes", f"WITH {_JUMPS} SELECT p.rec_id, p.id, p.q, CAST(coalesce((SELECT sum(amount) FROM jumps j WHERE j.rec_id = p.rec_id AND j.split2 <= p.q * 2), 0) AS BIGINT) AS jumped FROM probes p"),
    "field_pair_collapse": with_tables("frames", f"""WITH RECURSIVE gated AS (SELECT rec_id, bool_or(step > 0 AND step < {NOMINAL_MS} * 0.75) AS gate FROM (SELECT rec_id, lead(pts) OVER (PARTITION BY rec_id ORDER BY pts, frame_no) - pts AS step FROM frames) GROUP BY rec_id),
walk AS (SELECT f.rec_id, 0::BIGINT AS n, f.pts AS kept, coalesce(g.gate, false) AS gate FROM frames f JOIN gated g USING (rec_id) WHERE frame_no = 0
UNION ALL SELECT f.rec_id, f.frame_no, CASE WHEN w.gate AND f.pts - w.kept < {NOMINAL_MS} * 0.75 THEN w.kept ELSE f.pts END, w.gate FROM walk w JOIN frames f ON f.rec_id = w.rec_id AND f.frame_no = w.n + 1)
SELECT w.rec_id, w.kept AS pts, CAST(sum(f.bytes) AS BIGINT) AS bytes, arg_min(f.is_key, f.frame_no) AS is_key FROM walk w JOIN frames f ON f.rec_id = w.rec_id AND f.frame_no = w.n GROUP BY w.rec_id, w.kept""").replace("WITH ev AS", "WITH RECURSIVE ev AS").replace(", RECURSIVE gated", ", gated"),
}

# the same statements over all rows as one recording; a probe's neighbours are looked up by one merge, as there are many
_LONG_PROBES = "p AS (SELECT 0::BIGINT AS rec_id, id, q + id % 7 * 1000 - 3000 AS q FROM probes)"
_LONG_JUMPS = _JUMPS.replace("frames", "long_frames").replace(str(JUMP_MS), str(LONG_JUMP_MS))
_FIRST = "f AS (SELECT pts, min(frame_no) AS frame_no FROM long_frames GROUP BY pts)"
ORACLES |= {
    "long_frame_index": with_tables("long_frames", "SELECT * FROM long_frames"),
    "long_range_bytes": with_tables("long_frames frame_spans", "WITH h AS (SELECT id, greatest(0, least(n, a * 40 - 30)) AS lo, greatest(0, least(n, b * 41)) AS hi FROM frame_spans, (SELECT max(frame_no) AS n FROM long_frames)) SELECT 0::BIGINT AS rec_id, id, CAST(CASE WHEN hi < lo THEN 0 ELSE u.cum_bytes - coalesce(l.cum_bytes, 0) END AS BIGINT) AS bytes FROM h JOIN long_frames u ON u.frame_no = hi LEFT JOIN long_frames l ON l.frame_no = lo - 1"),
    "long_nearest_frame": with_tables("long_frames probes", f"WITH {_LONG_PROBES}, {_FIRST}, m AS (SELECT p.id, p.q, b.pts AS bp, b.frame_no AS bn FROM p ASOF LEFT JOIN f b ON p.q >= b.pts), n AS (SELECT m.*, a.pts AS ap, a.frame_no AS an FROM m ASOF LEFT JOIN f a ON m.q <= a.pts) SELECT 0::BIGINT AS rec_id, id, CASE WHEN ap IS NULL OR q - bp <= ap - q THEN bn ELSE an END AS frame_no FROM n"),
    "long_snap": with_tables("long_packets probes", f"WITH {_LONG_PROBES}, f AS (SELECT DISTINCT pts FROM long_packets WHERE is_key AND pts IS NOT NULL), m AS (SELECT p.id, p.q, b.pts AS bp FROM p ASOF LEFT JOIN f b ON p.q >= b.pts), n AS (SELECT m.*, a.pts AS ap FROM m ASOF LEFT JOIN f a ON m.q <= a.pts) SELECT 0::BIGINT AS rec_id, id, coalesce(bp, (SELECT min(pts) FROM f)) AS down, coalesce(ap, (SELECT max(pts) + 40 FROM f)) AS up, CASE WHEN ap IS NULL OR q - bp <= ap - q THEN bp ELSE ap END AS near FROM n"),
    "long_median_gop": ORACLES["median_gop"].replace("packets AS (", "unused AS (", 1).replace("FROM packets WHERE is_key", "FROM (SELECT 0::BIGINT AS rec_id, CASE WHEN event_type <> 'signup' THEN ms END AS pts, event_type = 'view' AS is_key FROM ev) WHERE is_key"),
    "long_clock_jumps": with_tables("long_frames", f"WITH {_LONG_JUMPS} SELECT * FROM jumps"),
    "long_jump_before": with_tables("long_frames probes", f"WITH {_LONG_JUMPS}, {_LONG_PROBES}, j AS (SELECT split2, sum(sum(amount)) OVER (ORDER BY split2) AS total FROM jumps GROUP BY split2) SELECT 0::BIGINT AS rec_id, id, q, CAST(coalesce(total, 0) AS BIGINT) AS jumped FROM p ASOF LEFT JOIN j ON p.q * 2 >= j.split2"),
    "long_picture_groups": ORACLES["picture_groups"].replace("packets AS (" + src.CTES["packets"] + ")", "long_packets AS (" + src.CTES["long_packets"] + ")").replace("FROM packets", "FROM long_packets"),
}
