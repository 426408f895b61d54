"""Registered queries over segments and packets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import frames, segments as op
from . import adapters as src
from .adapters import with_tables
from .frame_queries import _JUMPS, clock_jumps

DAY = 86_400_000


def _groups(spark, sf_dir):
    g = frames.picture_groups(src.packets(spark, sf_dir))
    nxt = F.lead("start_pts").over(W.partitionBy("rec_id").orderBy("gop"))
    return g.select("rec_id", "gop", F.col("start_pts").alias("s0"), F.coalesce(nxt, F.col("end_pts") + 1).alias("e0"))


def _spans(spark, sf_dir):
    return src.keep_spans(spark, sf_dir)


def cut_segments(spark, sf_dir):
    return op.cut_segments(_groups(spark, sf_dir), _spans(spark, sf_dir))


def keyframe_segments(spark, sf_dir):
    return op.cut_segments(_groups(spark, sf_dir), _spans(spark, sf_dir), keyframes=True)


def audio_pieces(spark, sf_dir):
    bounds = src.packets(spark, sf_dir).groupBy("rec_id").agg(F.min("pts").alias("lo"), (F.max("pts") + 1).alias("hi"))
    return op.audio_pieces(_spans(spark, sf_dir), bounds, 19_000_000, 20_000_000)


def adjusted_spans(spark, sf_dir):
    d = src.packets(spark, sf_dir).groupBy("rec_id").agg(F.min("pts").alias("start"), (F.max("pts") - F.min("pts")).alias("duration"))
    rel = _spans(spark, sf_dir).join(d.select("rec_id", F.col("start").alias("o")), "rec_id").select("rec_id", "k", (F.col("s") - F.col("o") - 40_000_000).alias("s"), (F.col("e") - F.col("o")).alias("e"))
    return op.adjusted(rel, d, 1000, 10_000)


def ranges_to_spans(spark, sf_dir):
    return op.ranges_to_spans(src.frame_spans(spark, sf_dir).where("a >= 0"), frames.frame_index(src.packets(spark, sf_dir)))


def packet_restamp(spark, sf_dir):
    return op.restamp(src.packets(spark, sf_dir), _spans(spark, sf_dir), DAY)


def jumps_in_spans(spark, sf_dir):
    return op.jumps_in(_spans(spark, sf_dir), clock_jumps(spark, sf_dir))


def config_change_points(spark, sf_dir):
    return op.change_points(src.packets(spark, sf_dir))


def configs_in_ranges(spark, sf_dir):
    windows = src.packets(spark, sf_dir).select("rec_id").distinct().select("rec_id", F.explode(F.array(F.lit(3).cast("long"), F.lit(20).cast("long"))).alias("lo")).withColumn("hi", F.col("lo") + 1)
    return op.configs_in(op.change_points(src.packets(spark, sf_dir).where("seq > 5")), windows)


def segment_scene(spark, sf_dir):
    return op.scene_of(cut_segments(spark, sf_dir), _spans(spark, sf_dir).withColumn("e", F.col("e") - 30_000_000))


def monotone_fix(spark, sf_dir):
    p = src.packets(spark, sf_dir).select("rec_id", "seq", F.floor(F.col("size") / 100).alias("x"))
    return op.monotone(p, "x", "seq")


def timestamp_repair(spark, sf_dir):
    p = src.packets(spark, sf_dir)
    first = F.min("pts").over(W.partitionBy("rec_id"))
    rel = F.col("pts") - first - 5_000_000
    dts = F.when(F.col("size") % 7 == 0, None).when(F.col("size") % 31 == 0, F.lit(-(1 << 40))).otherwise(rel + F.col("size") % 9 * 10_000_000 - 40_000_000)
    return op.repaired_timestamps(p.select("rec_id", "seq", rel.alias("pts"), dts.alias("dts"), F.when(F.col("seq") % 4 > 0, F.col("size") % 50).alias("duration"))).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("pts", "duration")})


def interleave(spark, sf_dir):
    p = src.packets(spark, sf_dir)
    dts = F.when(F.col("config") % 2 == 1, F.col("pts") - F.col("size"))
    even = p.where("seq % 2 = 0").select("rec_id", F.lit(0).alias("stream"), "seq", "pts", dts.alias("dts"))
    odd = p.where("seq % 2 = 1").select("rec_id", F.lit(1).alias("stream"), "seq", "pts", dts.alias("dts"))
    return op.interleave(even, odd)


def sane_timestamps(spark, sf_dir):
    dts = F.when(F.col("config") > 2, F.col("pts") + F.col("size") - 20_000)
    return src.packets(spark, sf_dir).where("pts IS NOT NULL").select("rec_id", "seq", op.sane_timestamps(F.col("pts"), dts).alias("pts"))


def repair_plan(spark, sf_dir):
    return op.runs_to_repair(src.packets(spark, sf_dir).withColumn("size", F.when(F.col("seq") % 13 == 0, 0).when(F.col("seq") % 17 == 0, 6).otherwise(F.col("size") + 7)))


QUERIES = {f.__name__: f for f in (cut_segments, keyframe_segments, audio_pieces, adjusted_spans, ranges_to_spans, packet_restamp, jumps_in_spans, config_change_points, configs_in_ranges, segment_scene, monotone_fix, timestamp_repair, interleave, sane_timestamps, repair_plan)}

_GROUPS = "m AS (SELECT *, CASE WHEN is_key OR row_number() OVER (PARTITION BY rec_id ORDER BY seq) = 1 THEN 1 ELSE 0 END AS st FROM packets WHERE pts IS NOT NULL), gg AS (SELECT *, CAST(sum(st) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS gop FROM m), g2 AS (SELECT rec_id, gop, min(pts) AS s0, max(pts) AS end_pts FROM gg GROUP BY rec_id, gop), groups AS (SELECT rec_id, gop, s0, coalesce(lead(s0) OVER (PARTITION BY rec_id ORDER BY gop), end_pts + 1) AS e0 FROM g2)"
_CUT = f"{_GROUPS}, segs AS (SELECT g.rec_id, g.gop, k, greatest(s, s0) AS s, least(e, e0) AS e, NOT (s0 >= s AND e0 <= e) AS recode FROM groups g JOIN keep_spans p ON g.rec_id = p.rec_id AND s < e0 AND e > s0)"
_CHANGES = "changes AS (SELECT rec_id, seq, config FROM (SELECT *, lag(config) OVER (PARTITION BY rec_id ORDER BY seq) AS was FROM packets) WHERE was IS NULL OR was <> config)"
ORACLES = {
    "cut_segments": with_tables("packets keep_spans", f"WITH {_CUT} SELECT * FROM segs"),
    "keyframe_segments": with_tables("packets keep_spans", f"WITH {_CUT} SELECT g.rec_id, g.gop, min(k) AS k, s0 AS s, e0 AS e, false AS recode FROM groups g JOIN keep_spans p ON g.rec_id = p.rec_id AND s < e0 AND e > s0 GROUP BY g.rec_id, g.gop, s0, e0"),
    "audio_pieces": with_tables("packets keep_spans", "WITH c AS (SELECT k.rec_id, k, greatest(s, lo) AS s, least(e, hi) AS e FROM keep_spans k JOIN (SELECT rec_id, min(pts) AS lo, max(pts) + 1 AS hi FROM packets GROUP BY rec_id) USING (rec_id)), n AS (SELECT *, CAST(greatest(0, ceil((e - s - 20000000) / 19000000)) AS BIGINT) AS n FROM c), j AS (SELECT *, unnest(generate_series(0, n)) AS j FROM n) SELECT rec_id, k, s + j * 19000000 AS s, CASE WHEN j < n THEN s + j * 19000000 + 19000000 ELSE e END AS e FROM j"),
    "adjusted_spans": with_tables("packets keep_spans", "WITH d AS (SELECT rec_id, min(pts) AS start, max(pts) - min(pts) AS duration FROM packets GROUP BY rec_id), r AS (SELECT rec_id, k, s - start - 40000000 AS s, e - start AS e, start, duration FROM keep_spans JOIN d USING (rec_id)) SELECT rec_id, k, CASE WHEN s <= 1000 THEN -10000 ELSE s END + start AS s, CASE WHEN e >= duration - 1000 THEN duration + 10000 ELSE e END + start AS e FROM r"),
    "ranges_to_spans": with_tables("frames frame_spans", "WITH l AS (SELECT rec_id, max(pts) + 1 AS fin FROM frames GROUP BY rec_id) SELECT p.rec_id, p.id, coalesce(x.pts, fin) AS s, coalesce(y.pts, fin) AS e FROM frame_spans p JOIN l USING (rec_id) LEFT JOIN frames x ON x.rec_id = p.rec_id AND x.frame_no = p.a LEFT JOIN frames y ON y.rec_id = p.rec_id AND y.frame_no = p.b + 1 WHERE p.b >= p.a AND p.a >= 0"),
    "packet_restamp": with_tables("packets keep_spans", "WITH l AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM keep_spans) SELECT p.rec_id, p.seq, l.k, CAST(p.pts - l.s + b AS BIGINT) AS out FROM packets p JOIN l ON l.rec_id = p.rec_id AND p.pts >= l.s AND p.pts < l.e"),
    "jumps_in_spans": with_tables("frames keep_spans", f"WITH {_JUMPS} SELECT k.rec_id, k.k, string_agg(split2 || ':' || amount, ',' ORDER BY split2, amount) AS jumps FROM keep_spans k JOIN jumps j ON j.rec_id = k.rec_id AND split2 > s * 2 AND split2 < e * 2 GROUP BY k.rec_id, k.k"),
    "config_change_points": with_tables("packets", f"WITH {_CHANGES} SELECT * FROM changes"),
    "configs_in_ranges": with_tables("packets", f"WITH p5 AS (SELECT * FROM packets WHERE seq > 5), {_CHANGES.replace('FROM packets', 'FROM p5')}, u AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY rec_id ORDER BY seq), 1099511627776::BIGINT) AS till FROM changes), w AS (SELECT unnest([3, 20]) AS lo) SELECT rec_id, config, min(seq) AS first_seq FROM (SELECT *, seq = min(seq) OVER (PARTITION BY rec_id) AS one FROM u) u JOIN w ON (seq <= lo + 1 OR one) AND till > lo GROUP BY rec_id, config"),
    "segment_scene": with_tables("packets keep_spans", f"WITH {_CUT} SELECT rec_id, gop, k, coalesce((SELECT min(p.k) FROM keep_spans p WHERE p.rec_id = z.rec_id AND p.s * 2 <= z.s + z.e AND z.s + z.e < (p.e - 30000000) * 2), (SELECT max(p.k) FROM keep_spans p WHERE p.rec_id = z.rec_id AND p.s * 2 <= z.s + z.e), -1) AS scene FROM segs z"),
    "monotone_fix": with_tables("packets", "WITH x AS (SELECT rec_id, seq, CAST(floor(size / 100) AS BIGINT) AS x FROM packets) SELECT rec_id, seq, x, max(x - seq) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + seq AS fixed FROM x"),
    "timestamp_repair": with_tables("packets", "WITH r AS (SELECT rec_id, seq, size, pts - min(pts) OVER (PARTITION BY rec_id) - 5000000 AS pts FROM packets), d AS (SELECT rec_id, seq, pts, CASE WHEN size % 7 = 0 OR size % 31 = 0 THEN NULL ELSE pts + size % 9 * 10000000 - 40000000 END AS d0, CASE WHEN seq % 4 > 0 THEN size % 50 END AS du FROM r), s AS (SELECT rec_id, seq, pts, CASE WHEN d0 BETWEEN -900000 AND 1000000000000 THEN d0 END AS dts, du FROM d), w AS (SELECT rec_id, 0::BIGINT AS seq, NULL::BIGINT AS pts, NULL::BIGINT AS dts, NULL::BIGINT AS duration, NULL::BIGINT AS usual FROM (SELECT DISTINCT rec_id FROM s) UNION ALL SELECT x.rec_id, x.seq, CASE WHEN x.pts IS NULL THEN NULL ELSE greatest(x.pts, CASE WHEN x.dts IS NOT NULL THEN greatest(x.dts, coalesce(w.dts + 1, x.dts)) WHEN w.dts >= 0 THEN w.dts + 1 ELSE coalesce(x.pts, 0) END) END, CASE WHEN x.dts IS NOT NULL THEN greatest(x.dts, coalesce(w.dts + 1, x.dts)) WHEN w.dts >= 0 THEN w.dts + 1 ELSE coalesce(x.pts, 0) END, CASE WHEN x.du > 0 THEN x.du ELSE w.usual END, CASE WHEN x.du > 0 THEN x.du ELSE w.usual END FROM w JOIN s x ON x.rec_id = w.rec_id AND x.seq = w.seq + 1) SELECT rec_id, seq, coalesce(pts, -1) AS pts, dts, coalesce(duration, -1) AS duration FROM w WHERE seq > 0").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "interleave": with_tables("packets", "WITH z AS (SELECT rec_id, seq, CAST(seq % 2 AS INTEGER) AS stream, coalesce(CASE WHEN config % 2 = 1 THEN pts - size END, pts, 0) AS key FROM packets) SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY key, stream, seq) - 1 AS place, stream, seq FROM z"),
    "sane_timestamps": with_tables("packets", "SELECT rec_id, seq, CASE WHEN config > 2 THEN greatest(pts, pts + size - 20000) ELSE pts END AS pts FROM packets WHERE pts IS NOT NULL"),
    "repair_plan": with_tables("packets", "WITH f AS (SELECT rec_id, seq, CASE WHEN seq % 17 > 0 THEN config END AS config, row_number() OVER (PARTITION BY rec_id ORDER BY seq) - 1 AS o FROM packets WHERE seq % 13 > 0), u AS (SELECT rec_id, config AS usual FROM f WHERE config IS NOT NULL GROUP BY rec_id, config QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY count(*) DESC, min(seq)) = 1), d AS (SELECT rec_id, o, o - row_number() OVER (PARTITION BY rec_id ORDER BY o) AS g FROM f JOIN u USING (rec_id) WHERE config <> usual) SELECT rec_id, min(o) AS first, max(o) AS last, count(*) AS n FROM d GROUP BY rec_id, g"),
}
