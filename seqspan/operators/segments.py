"""Segment planning: spans to keep against groups of pictures, packets into spans, re-timing, configuration changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .intervals import overlapping
from .walks import by_group


#: Width of the buckets of times in milliseconds.
DAY = 86_400_000


def in_spans(points: DataFrame, spans: DataFrame, at: str, width: int, closed: bool = False, names: tuple[str, ...] = ("k",)) -> DataFrame:
    """Rows of ``points`` within ``spans`` (rec_id, k, s, e; half open, or closed), once for each span.

    Every span is put at each bucket of ``width`` that it touches, and bucket and recording are joined on equality.  ``names``
    renames the span's k.
    """
    lo, hi = F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long")
    spread = spans.select("rec_id", F.col("k").alias(names[0]), "s", "e", F.explode(F.sequence(lo, hi)).alias("bucket"))
    held = points.withColumn("bucket", F.floor(F.col(at) / width).cast("long")).join(spread, ["rec_id", "bucket"])
    upper = F.col(at) <= F.col("e") if closed else F.col(at) < F.col("e")
    return held.where((F.col(at) >= F.col("s")) & upper).drop("bucket")


def cut_segments(groups: DataFrame, spans: DataFrame, keyframes: bool = False) -> DataFrame:
    """rec_id, gop, k, s, e, recode: each group of pictures (rec_id, gop, s0, e0) against the spans to keep (rec_id, k, s, e).

    A group wholly in a span is copied; of one that a span cuts, the part inside is made anew.  With ``keyframes`` every group
    that a span meets is copied as a whole, once.
    """
    left = groups.select("rec_id", "gop", F.col("s0").alias("start_f"), F.col("e0").alias("end_f"))
    right = spans.select("rec_id", "k", F.col("s").alias("start_f"), F.col("e").alias("end_f"))
    pairs = overlapping(left, right, DAY, ("k",)).withColumnsRenamed({"start_f": "s0", "end_f": "e0"}).where("s < e0 AND e > s0")
    if keyframes:
        return pairs.groupBy("rec_id", "gop", "s0", "e0").agg(F.min("k").alias("k")).select("rec_id", "gop", "k", F.col("s0").alias("s"), F.col("e0").alias("e"), F.lit(False).alias("recode"))
    whole = (F.col("s0") >= F.col("s")) & (F.col("e0") <= F.col("e"))
    return pairs.select("rec_id", "gop", "k", F.greatest("s", "s0").alias("s"), F.least("e", "e0").alias("e"), (~whole).alias("recode"))


def audio_pieces(spans: DataFrame, bounds: DataFrame, longest: int = 19, slack: int = 20) -> DataFrame:
    """rec_id, k, s, e: spans clipped to the sound (``bounds``: rec_id, lo, hi), in pieces of ``longest`` while over ``slack`` is left.

    A span that lies outside of the sound keeps one piece, which ends where it begins or before.
    """
    clipped = spans.join(bounds, "rec_id").select("rec_id", "k", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))
    pieces = F.greatest(F.lit(0), F.ceil((F.col("e") - F.col("s") - slack) / longest)).cast("int")
    each = clipped.withColumn("n", pieces).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n"))))
    start = F.col("s") + F.col("j") * longest
    return each.select("rec_id", "k", start.alias("s"), F.when(F.col("j") < F.col("n"), start + longest).otherwise(F.col("e")).alias("e"))


def adjusted(spans: DataFrame, durations: DataFrame, slack: int, reach: int) -> DataFrame:
    """Spans that begin at the start, or end at the end, reach beyond it by ``reach``; all are moved by the recording's start."""
    s = F.when(F.col("s") <= slack, F.lit(-reach)).otherwise(F.col("s"))
    e = F.when(F.col("e") >= F.col("duration") - slack, F.col("duration") + reach).otherwise(F.col("e"))
    return spans.join(durations, "rec_id").select("rec_id", "k", (s + F.col("start")).alias("s"), (e + F.col("start")).alias("e"))


def ranges_to_spans(spans: DataFrame, index: DataFrame) -> DataFrame:
    """rec_id, id, s, e: the times of frame a and of the frame after b; past the last frame the recording's end."""
    end = index.groupBy("rec_id").agg((F.max("pts") + 1).alias("end"))
    at = index.select("rec_id", F.col("frame_no").alias("a"), F.col("pts").alias("s"))
    after = index.select("rec_id", (F.col("frame_no") - 1).alias("b"), F.col("pts").alias("e"))
    out = spans.where("b >= a").join(end, "rec_id").join(at, ["rec_id", "a"], "left").join(after, ["rec_id", "b"], "left")
    return out.select("rec_id", "id", F.coalesce("s", "end").alias("s"), F.coalesce("e", "end").alias("e"))


def restamp(packets: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """rec_id, seq, k, out: packets in the first span that holds them, moved to where the span begins in the output."""
    w = W.partitionBy("rec_id").orderBy("s", "k").rowsBetween(W.unboundedPreceding, -1)
    laid = spans.select("rec_id", "k", "s", "e", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0)).alias("begin"))
    hit = in_spans(packets.where("pts IS NOT NULL"), laid.select("rec_id", "k", "s", "e"), "pts", width)
    first = hit.withColumn("rank", F.row_number().over(W.partitionBy("rec_id", "seq").orderBy("s", "k"))).where("rank = 1")
    return first.join(laid.select("rec_id", "k", "begin"), ["rec_id", "k"]).select("rec_id", "seq", "k", (F.col("pts") - F.col("s") + F.col("begin")).alias("out"))


def jumps_inside(spans: DataFrame, jumps: DataFrame) -> DataFrame:
    """Spans with each of their jumps (rec_id, split2, amount; split2 is twice a time) strictly inside."""
    doubled = spans.select("rec_id", "k", (F.col("s") * 2).alias("s"), (F.col("e") * 2).alias("e"))
    return in_spans(jumps, doubled, "split2", 2 * DAY).where(F.col("split2") > F.col("s")).drop("s", "e")


def jumps_in(spans: DataFrame, jumps: DataFrame) -> DataFrame:
    """rec_id, k, jumps: each span's clock jumps (split2, amount) strictly inside, in order; none where there are none."""
    return jumps_inside(spans, jumps).groupBy("rec_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split2", "amount"))), lambda x: F.concat_ws(":", x["split2"], x["amount"])), ",").alias("jumps"))


def change_points(packets: DataFrame) -> DataFrame:
    """rec_id, seq, config wherever the configuration differs from the packet before."""
    before = F.lag("config").over(W.partitionBy("rec_id").orderBy("seq"))
    first = F.row_number().over(W.partitionBy("rec_id").orderBy("seq")) == 1
    return packets.withColumn("same", before.eqNullSafe(F.col("config")) & ~first).where("NOT same").select("rec_id", "seq", "config")


def configs_in(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """rec_id, config, first_seq: the configurations in force in any of the windows (rec_id, lo, hi of seq), each once.

    The first one also covers what lies before it.
    """
    until = F.coalesce(F.lead("seq").over(W.partitionBy("rec_id").orderBy("seq")), F.lit(1 << 62))
    spans = changes.withColumn("until", until)
    # what is in force as a window begins is the last change before it; the others begin inside it: buckets hold points only
    inside = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / 64).cast("long"), F.floor(F.col("hi") / 64).cast("long"))))
    began = spans.withColumn("bucket", F.floor(F.col("seq") / 64).cast("long")).join(inside, ["rec_id", "bucket"]).where("seq BETWEEN lo AND hi").select("rec_id", "config", "seq")
    marks = spans.select("rec_id", F.col("seq").alias("at"), F.struct("seq", "config").alias("x")).unionByName(windows.select("rec_id", F.col("lo").alias("at"), F.lit(None).cast(T.StructType([T.StructField("seq", changes.schema["seq"].dataType), T.StructField("config", changes.schema["config"].dataType)])).alias("x")))
    last = F.last("x", ignorenulls=True).over(W.partitionBy("rec_id").orderBy("at", F.col("x").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow))
    earliest = F.min("x").over(W.partitionBy("rec_id"))
    standing = marks.withColumn("y", F.coalesce(last, earliest)).where("x IS NULL AND y IS NOT NULL").select("rec_id", "y.config", "y.seq")
    return began.unionByName(standing).groupBy("rec_id", "config").agg(F.min("seq").alias("first_seq"))


def scene_of(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """rec_id, gop, k, scene: the scene that holds a segment's middle, else the last that began before it, else -1."""
    middle = segments.select("rec_id", "gop", "k", (F.col("s") + F.col("e")).alias("mid2"))
    doubled = scenes.select("rec_id", F.col("k").alias("scene"), (F.col("s") * 2).alias("s"), (F.col("e") * 2).alias("e"))
    held = in_spans(middle, doubled.withColumnRenamed("scene", "k"), "mid2", 2 * DAY, names=("scene",))
    inside = held.groupBy("rec_id", "gop", "k").agg(F.min("scene").alias("inside"))
    # the last scene that began before: one sorted pass over both
    begun = doubled.select("rec_id", F.col("s").alias("at"), F.lit(None).cast("long").alias("gop"), F.lit(None).cast("long").alias("k"), F.struct("s", "scene").alias("x"))
    marks = begun.unionByName(middle.select("rec_id", F.col("mid2").alias("at"), "gop", "k", F.lit(None).cast(begun.schema["x"].dataType).alias("x")))
    last = F.max("x").over(W.partitionBy("rec_id").orderBy("at", F.col("x").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow))
    before = marks.withColumn("y", last).where("x IS NULL").select("rec_id", "gop", "k", F.col("y.scene").alias("before"))
    return before.join(inside, ["rec_id", "gop", "k"], "left").select("rec_id", "gop", "k", F.coalesce("inside", "before", F.lit(-1)).alias("scene"))


def monotone(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Adds ``fixed``: the least strictly rising sequence at or above the values: max(x - rank) so far, plus rank."""
    w = W.partitionBy("rec_id").orderBy(order)
    rank = F.row_number().over(w)
    return rows.withColumn("rank", rank.cast("long")).withColumn("fixed", F.max(F.col(value) - F.col("rank")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("rank")).drop("rank")


def interleave(*streams: DataFrame) -> DataFrame:
    """rec_id, place, stream, seq: packets of several streams by dts (else pts, else 0), the earlier stream first among equals."""
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    key = F.coalesce("dts", "pts", F.lit(0))
    place = F.row_number().over(W.partitionBy("rec_id").orderBy(key, "stream", "seq")) - 1
    return rows.select("rec_id", place.cast("long").alias("place"), "stream", "seq")


def sane_timestamps(pts: Column, dts: Column) -> Column:
    """pts, or dts where that is later; a null stays as it is."""
    return F.when(pts.isNotNull() & dts.isNotNull(), F.greatest(pts, dts)).otherwise(pts)


def runs_to_repair(frames: DataFrame) -> DataFrame:
    """rec_id, first, last, n: runs of neighbouring frames whose configuration isn't the recording's usual one, numbered from 0.

    Frames without bytes don't count; ones of under 7 bytes have no configuration, which ends a run as the usual one does.
    The usual one is the commonest, the one seen first of equals.
    """
    w = W.partitionBy("rec_id").orderBy("seq")
    rows = frames.where("size > 0").select("rec_id", "seq", F.when(F.col("size") >= 7, F.col("config")).alias("config"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    counted = rows.where("config IS NOT NULL").groupBy("rec_id", "config").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    rank = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("n"), "first"))
    usual = counted.withColumn("rank", rank).where("rank = 1").select("rec_id", F.col("config").alias("usual"))
    odd = rows.join(usual, "rec_id").where("config <> usual")
    island = F.col("ordinal") - F.row_number().over(W.partitionBy("rec_id").orderBy("ordinal"))
    return odd.withColumn("g", island).groupBy("rec_id", "g").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n")).drop("g")


#: A dts out of these bounds is none.
SANE_DTS = (-900_000, 1_000_000_000_000)


def repaired_timestamps(packets: DataFrame) -> DataFrame:
    """rec_id, seq, pts, dts, duration of packets with dts that rise, no pts below its dts, and a duration.

    A dts at or below the one before becomes one more than that; without one (or out of ``SANE_DTS``) it is one more than the
    last, or the pts while none is known to be 0 or more.  A missing duration is that of the last packet with one.
    """
    low, high = SANE_DTS

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        last, usual = None, None
        for seq, pts, dts, duration in part:
            if dts is not None and low <= dts <= high:
                dts = dts if last is None or dts > last else last + 1
            else:
                dts = last + 1 if last is not None and last >= 0 else pts if pts is not None else 0
            last = dts
            usual = duration if duration is not None and duration > 0 else usual
            yield key[0], seq, pts if pts is None else max(pts, dts), dts, usual if duration is None or duration <= 0 else duration

    return by_group(packets.select("rec_id", "seq", "pts", "dts", "duration"), ["rec_id"], ["seq"], walk, "rec_id long, seq long, pts long, dts long, duration long")
