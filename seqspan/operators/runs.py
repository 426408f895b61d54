"""Runs over sampled flags: sessions, persistence, levels of agreement, junctions, modes and sampling plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .intervals import overlapping


def rolling_min(rows: DataFrame, value: str, width: int = 21, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Adds ``low``: the least value among the ``width`` samples round each; at the ends the frame shrinks."""
    half = width // 2
    return rows.withColumn("low", F.min(value).over(W.partitionBy(*keys).orderBy("i").rowsBetween(-half, half)))


def runs_of(rows: DataFrame, flag: Column, merge_gap: int, min_len: int, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """keys, t0, t1, n: runs of flagged samples (t); a gap above ``merge_gap`` starts a new run, and runs last ``min_len`` at least."""
    w = W.partitionBy(*keys).orderBy("t", "i")
    true = rows.where(flag)
    gap = F.col("t") - F.lag("t").over(w)
    marked = true.withColumn("new", F.when(gap.isNull() | (gap > merge_gap), 1).otherwise(0))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = run.groupBy(*keys, "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    return spans.where(F.col("t1") - F.col("t0") >= min_len).drop("run")


def _islands(rows: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``island``: the same for neighbouring samples (by i) with the same flag."""
    w = W.partitionBy(*keys).orderBy("i")
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return rows.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("change")


def sustained(rows: DataFrame, min_len: int | Column, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Adds ``held``: the flag ``on`` where its run of neighbouring samples lasts ``min_len`` at least."""
    w = W.partitionBy(*keys, "island")
    least = F.lit(min_len) if isinstance(min_len, int) else min_len
    return _islands(rows, "on", keys).withColumn("held", F.col("on") & (F.max("t").over(w) - F.min("t").over(w) >= least)).drop("island")


def consecutive_runs(rows: DataFrame, tail: int = 0) -> DataFrame:
    """rec_id, t0, t1, n of each run of neighbouring flagged samples; ``tail`` is added to the end."""
    runs = _islands(rows, "on", ("rec_id",)).where("on").groupBy("rec_id", "island")
    return runs.agg(F.min("t").alias("t0"), (F.max("t") + tail).alias("t1"), F.count("*").alias("n")).drop("island")


def levels_agreeing(rows: DataFrame, levels: Sequence[int], merge_gap: int, min_len: int, least: int, width: int = 1 << 28) -> DataFrame:
    """rec_id, t0, t1, support: spans where the flag is away, found at several levels of persistence.

    At each level the flag must last that long to count.  A span's support is the number of levels with a span that covers
    more than half of it, and ``least`` of them are wanted.
    """
    each = rows.withColumn("level", F.explode(F.array(*[F.lit(x).cast("long") for x in levels])))
    keys = ("rec_id", "level")
    spans = runs_of(sustained(each, F.col("level"), keys), ~F.col("held"), merge_gap, min_len, keys)
    candidates = spans.select("rec_id", F.col("t0").alias("start_f"), F.col("t1").alias("end_f")).distinct()
    other = spans.select("rec_id", "level", F.col("t0").alias("start_f"), F.col("t1").alias("end_f"))
    pairs = overlapping(candidates, other, width, ("level",)).withColumnsRenamed({"start_f": "t0", "end_f": "t1", "s": "c", "e": "d"})
    covered = F.least("t1", "d") - F.greatest("t0", "c") > (F.col("t1") - F.col("t0")) * 0.5
    return pairs.where(covered).groupBy("rec_id", "t0", "t1").agg(F.count_distinct("level").alias("support")).where(F.col("support") >= least)


def merge_absence(rows: DataFrame) -> DataFrame:
    """Adds ``present``: where ``merged`` joins absences, each joined one reaches from its first to its last sample absent by ``on``.

    ``rows`` has rec_id, i, on and merged, the flag after something was left out of account.  What merging added at the ends
    of an absence stays present, and so does a joined one in which nothing was absent.
    """
    island = _islands(rows, "merged", ("rec_id",))
    w = W.partitionBy("rec_id", "island")
    away = F.when(~F.col("on"), F.col("i"))
    inside = ~F.col("merged") & (F.col("i") >= F.col("first")) & (F.col("i") <= F.col("last"))
    out = island.withColumns({"first": F.min(away).over(w), "last": F.max(away).over(w)})
    return out.withColumn("present", ~F.coalesce(inside, F.lit(False))).drop("island", "first", "last")


def gaps_between(spans: DataFrame) -> DataFrame:
    """rec_id, a, b: from the end of each span to the start of the next, where that is later."""
    nxt = F.lead("t0").over(W.partitionBy("rec_id").orderBy("t0", "t1"))
    return spans.select("rec_id", F.col("t1").alias("a"), nxt.alias("b")).where("b > a")


def junction_mask(rows: DataFrame, reach: int) -> DataFrame:
    """rec_id, i, junction: flagless samples within ``reach`` of any change of the flag, which is at the last sample before it."""
    w = W.partitionBy("rec_id").orderBy("t", "i")
    change = F.when(F.lead("on").over(w) != F.col("on"), F.col("t"))
    marked = rows.withColumn("change", change)
    wide = W.partitionBy("rec_id").orderBy("t").rangeBetween(-reach, reach)
    return marked.select("rec_id", "i", (~F.col("on") & F.max("change").over(wide).isNotNull()).alias("junction"))


def bucket_mode(rows: DataFrame, value: str, width: int) -> DataFrame:
    """rec_id, mode, share: the commonest bucket of ``width``, the smallest of equals, and its share."""
    bucket = (F.floor(F.col(value) / width) * width).cast("long")
    counted = rows.groupBy("rec_id", bucket.alias("mode")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("rec_id"))
    rank = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("n"), "mode"))
    return counted.select("rec_id", "mode", F.round(F.col("n") / total, 6).alias("share"), rank.alias("rank")).where("rank = 1").drop("rank")


def weighted_mode(rows: DataFrame, value: str) -> DataFrame:
    """rec_id, mode, weight: the value that holds longest; a sample holds until the next, the last as long as the one before it.

    Of equals the one seen first; a single sample weighs 1.
    """
    w = W.partitionBy("rec_id").orderBy("t", "i")
    gap = F.lead("t").over(w) - F.col("t")
    weighed = rows.withColumn("gap", gap).withColumn("weight", F.coalesce("gap", F.lag("gap").over(w), F.lit(1)))
    summed = weighed.groupBy("rec_id", F.col(value).alias("mode")).agg(F.sum("weight").alias("weight"), F.min(F.struct("t", "i")).alias("first"))
    rank = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("weight"), "first"))
    return summed.withColumn("rank", rank).where("rank = 1").select("rec_id", "mode", "weight")


def shape_runs(rows: DataFrame, tolerance: int, least_share: float, merge_gap: int, min_len: int) -> DataFrame:
    """Runs in which the smoothed picture is wider or higher than the dominant one by more than the tolerance.

    ``rows`` has width and height.  A recording in which neither has a dominant value, in ``least_share`` of the samples, has
    no runs.
    """
    low = rolling_min(rows, "width").withColumnRenamed("low", "w")
    low = rolling_min(low, "height").withColumnRenamed("low", "h")
    usual = [bucket_mode(low, c, tolerance).select("rec_id", F.col("mode").alias(f"usual_{c}"), F.col("share").alias(f"share_{c}")) for c in ("w", "h")]
    told = low.join(usual[0], "rec_id").join(usual[1], "rec_id").where(F.greatest("share_w", "share_h") >= least_share)
    return runs_of(told, (F.col("w") > F.col("usual_w") + tolerance) | (F.col("h") > F.col("usual_h") + tolerance), merge_gap, min_len)


def refined_sampling(lengths: DataFrame, odd: DataFrame, coarse: int, fine: int, reach: int) -> DataFrame:
    """rec_id, t: sampling instants: every ``coarse``, and every ``fine`` within ``reach`` of instants that stood out.

    ``lengths`` has rec_id and length, ``odd`` rec_id and t.  Windows that meet are one.
    """
    sweep = lengths.select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(coarse).cast("long"))).alias("t"))
    near = odd.join(lengths, "rec_id").select("rec_id", F.greatest(F.lit(0), F.col("t") - reach).alias("lo"), F.least(F.col("length"), F.col("t") + reach).alias("hi"))
    w = W.partitionBy("rec_id").orderBy("lo", "hi")
    new = F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    windows = near.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    windows = windows.groupBy("rec_id", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inside = windows.select("rec_id", F.explode(F.sequence("lo", "hi", F.lit(fine).cast("long"))).alias("t"))
    return sweep.unionByName(inside).distinct()
