"""Registered queries over sampled flags."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import runs as op
from . import adapters as src
from .adapters import with_tables

HOUR = 3_600_000
GAP, LENGTH = 18 * HOUR, 24 * HOUR
LEVELS = (6 * HOUR, 12 * HOUR, 24 * HOUR, 48 * HOUR)


def break_runs(spark, sf_dir):
    """The flagship: runs of the flag and what lies between them."""
    runs = op.runs_of(src.samples(spark, sf_dir), F.col("on"), GAP, LENGTH)
    nxt = F.coalesce(F.lead("t0").over(W.partitionBy("rec_id").orderBy("t0")), F.col("t1"))
    return runs.select("rec_id", "t0", "t1", "n", (nxt - F.col("t1")).alias("until_next"))


def rolling_min(spark, sf_dir):
    return op.rolling_min(src.samples(spark, sf_dir), "width").select("rec_id", "i", "width", "low")


def _rare(spark, sf_dir):
    return src.samples(spark, sf_dir).withColumn("on", F.col("width") >= 250)


def sustained_runs(spark, sf_dir):
    return op.sustained(_rare(spark, sf_dir), 12 * HOUR).select("rec_id", "i", "held")


def consecutive_runs(spark, sf_dir):
    return op.consecutive_runs(_rare(spark, sf_dir), 500)


def multi_level_support(spark, sf_dir):
    return op.levels_agreeing(_rare(spark, sf_dir), LEVELS, GAP, 12 * HOUR, 3)


def merge_absence(spark, sf_dir):
    rows = _rare(spark, sf_dir).withColumn("merged", F.col("on") & (F.col("i") % 5 < 3) & (F.col("width") % 9 > 0))
    return op.merge_absence(rows).select("rec_id", "i", "present")


def anchor_gaps(spark, sf_dir):
    return op.gaps_between(op.runs_of(_rare(spark, sf_dir), ~F.col("on"), 12 * HOUR, 6 * HOUR))


def junction_mask(spark, sf_dir):
    return op.junction_mask(_rare(spark, sf_dir), 2 * HOUR)


def bucket_mode(spark, sf_dir):
    return op.bucket_mode(src.samples(spark, sf_dir), "width", 40)


def plain_mode(spark, sf_dir):
    return op.bucket_mode(src.samples(spark, sf_dir), "width", 1)


def weighted_mode(spark, sf_dir):
    return op.weighted_mode(src.samples(spark, sf_dir), "aspect")


def shape_runs(spark, sf_dir):
    rows = src.samples(spark, sf_dir).withColumn("height", F.col("width") * 7 % 200 + F.when(F.col("i") % 40 < 25, 0).otherwise(60))
    return op.shape_runs(rows, 20, 0.35, GAP, 4 * HOUR)


def refined_sampling(spark, sf_dir):
    s = src.samples(spark, sf_dir)
    rel = s.withColumn("rel", F.floor((F.col("t") - F.min("t").over(W.partitionBy("rec_id"))) / 60_000).cast("long"))
    lengths = rel.groupBy("rec_id").agg(F.max("rel").alias("length"))
    return op.refined_sampling(lengths, rel.where("width >= 470").select("rec_id", F.col("rel").alias("t")), 600, 100, 1200)


QUERIES = {f.__name__: f for f in (break_runs, rolling_min, sustained_runs, consecutive_runs, multi_level_support, merge_absence, anchor_gaps, junction_mask, bucket_mode, plain_mode, weighted_mode, shape_runs, refined_sampling)}

_RARE = 'rare AS (SELECT rec_id, i, t, width >= 250 AS "on", width FROM samples)'


def _runs(name: str, source: str, flag: str, gap: int, length: int, keys: str = "rec_id") -> str:
    return (
        f"{name} AS (SELECT {keys}, min(t) AS t0, max(t) AS t1, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS run FROM "
        f"(SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t, i) <= {gap} THEN 0 ELSE 1 END AS new FROM {source} WHERE {flag})) GROUP BY {keys}, run HAVING max(t) - min(t) >= {length})"
    )


def _sustained(source: str, length: str, keys: str = "rec_id") -> str:
    return (
        f'isl AS (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN "on" = lag("on") OVER (PARTITION BY {keys} ORDER BY i) THEN 0 ELSE 1 END AS ch FROM {source})), '
        f'sus AS (SELECT *, "on" AND max(t) OVER (PARTITION BY {keys}, island) - min(t) OVER (PARTITION BY {keys}, island) >= {length} AS held FROM isl)'
    )


def _mode(width: int, value: str = "width", source: str = "samples") -> str:
    return f"SELECT rec_id, mode, round(n / sum(n) OVER (PARTITION BY rec_id), 6) AS share FROM (SELECT rec_id, CAST(floor({value} / {width}) * {width} AS BIGINT) AS mode, count(*) AS n FROM {source} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, mode) = 1"


_ALL_LEVELS = f"lv AS (SELECT r.*, level FROM rare r, (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS level))"
ORACLES = {
    "break_runs": with_tables("samples", f"WITH {_runs('r', 'samples', '\"on\"', GAP, LENGTH)} SELECT *, coalesce(lead(t0) OVER (PARTITION BY rec_id ORDER BY t0), t1) - t1 AS until_next FROM r"),
    "rolling_min": with_tables("samples", "SELECT rec_id, i, width, min(width) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS low FROM samples"),
    "sustained_runs": with_tables("samples", f"WITH {_RARE}, {_sustained('rare', str(12 * HOUR))} SELECT rec_id, i, held FROM sus"),
    "consecutive_runs": with_tables("samples", f"WITH {_RARE}, {_sustained('rare', '0')} SELECT rec_id, min(t) AS t0, max(t) + 500 AS t1, count(*) AS n FROM sus WHERE \"on\" GROUP BY rec_id, island"),
    "multi_level_support": with_tables("samples", f"WITH {_RARE}, {_ALL_LEVELS}, {_sustained('lv', 'level', 'rec_id, level')}, {_runs('r', 'sus', 'NOT held', GAP, 12 * HOUR, 'rec_id, level')}, c AS (SELECT DISTINCT rec_id, t0, t1 FROM r) SELECT c.rec_id, c.t0, c.t1, count(DISTINCT level) AS support FROM c JOIN r ON c.rec_id = r.rec_id AND least(c.t1, r.t1) - greatest(c.t0, r.t0) > (c.t1 - c.t0) * 0.5 GROUP BY ALL HAVING count(DISTINCT level) >= 3"),
    "merge_absence": with_tables("samples", f"WITH {_RARE}, m AS (SELECT *, \"on\" AND i % 5 < 3 AND width % 9 > 0 AS merged FROM rare), g AS (SELECT *, sum(ch) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN merged = lag(merged) OVER (PARTITION BY rec_id ORDER BY i) THEN 0 ELSE 1 END AS ch FROM m)), k AS (SELECT *, min(CASE WHEN NOT \"on\" THEN i END) OVER (PARTITION BY rec_id, island) AS a, max(CASE WHEN NOT \"on\" THEN i END) OVER (PARTITION BY rec_id, island) AS b FROM g) SELECT rec_id, i, NOT coalesce(NOT merged AND i BETWEEN a AND b, false) AS present FROM k"),
    "anchor_gaps": with_tables("samples", f"WITH {_RARE}, {_runs('r', 'rare', 'NOT \"on\"', 12 * HOUR, 6 * HOUR)} SELECT * FROM (SELECT rec_id, t1 AS a, lead(t0) OVER (PARTITION BY rec_id ORDER BY t0, t1) AS b FROM r) WHERE b > a"),
    "junction_mask": with_tables("samples", f"WITH {_RARE}, f AS (SELECT rec_id, t FROM (SELECT *, lead(\"on\") OVER (PARTITION BY rec_id ORDER BY t, i) AS next FROM rare) WHERE next <> \"on\") SELECT rec_id, i, NOT \"on\" AND EXISTS (SELECT 1 FROM f WHERE f.rec_id = r.rec_id AND abs(f.t - r.t) <= {2 * HOUR}) AS junction FROM rare r"),
    "bucket_mode": with_tables("samples", _mode(40)),
    "plain_mode": with_tables("samples", _mode(1)),
    "weighted_mode": with_tables("samples", "WITH g AS (SELECT *, lead(t) OVER (PARTITION BY rec_id ORDER BY t, i) - t AS gap FROM samples), w AS (SELECT *, coalesce(gap, lag(gap) OVER (PARTITION BY rec_id ORDER BY t, i), 1) AS weight FROM g) SELECT rec_id, aspect AS mode, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY rec_id, aspect QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY sum(weight) DESC, min(t), min(i)) = 1"),
    "shape_runs": with_tables("samples", f"WITH hh AS (SELECT *, width * 7 % 200 + CASE WHEN i % 40 < 25 THEN 0 ELSE 60 END AS height FROM samples), lows AS (SELECT *, min(width) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS w, min(height) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS h FROM hh), mw AS ({_mode(20, 'w', 'lows')}), mh AS ({_mode(20, 'h', 'lows')}), j AS (SELECT lows.*, mw.mode AS uw, mh.mode AS uh FROM lows JOIN mw USING (rec_id) JOIN mh USING (rec_id) WHERE greatest(mw.share, mh.share) >= 0.35), {_runs('r', 'j', '(w > uw + 20 OR h > uh + 20)', GAP, 4 * HOUR)} SELECT * FROM r"),
    "refined_sampling": with_tables("samples", "WITH rel AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY rec_id)) / 60000) AS BIGINT) AS rel FROM samples), len AS (SELECT rec_id, max(rel) AS length FROM rel GROUP BY rec_id), near AS (SELECT rec_id, greatest(0, rel - 1200) AS lo, least(length, rel + 1200) AS hi FROM rel JOIN len USING (rec_id) WHERE width >= 470), m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM near), w AS (SELECT rec_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY rec_id, g) SELECT rec_id, unnest(generate_series(0, length, 600)) AS t FROM len UNION SELECT rec_id, unnest(generate_series(lo, hi, 100)) FROM w"),
}
