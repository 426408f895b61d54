"""Frame index: ordered timestamps with carried bytes, nearest lookups, prefix sums, groups of pictures, clock jumps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scans import Running, medians, outgrown, running
from .walks import by_group


def carry_null_bytes(packets: DataFrame, ranges: bool | None = None) -> DataFrame:
    """rec_id, pts, bytes, is_key: a packet without pts adds its bytes to the next one with pts; trailing ones are dropped.

    ``ranges`` deals a recording over many tasks; where it isn't given, the size of the largest one tells.
    """
    ranges = outgrown(packets, ["rec_id"]) if ranges is None else ranges
    marked = running(packets, ["rec_id"], ["seq"], ranges, ahead=Running(F.col("pts"), "count", backward=True)).where("ahead > 0")
    key = F.bool_or(F.col("is_key") & F.col("pts").isNotNull())
    return marked.groupBy("rec_id", "ahead").agg(F.max("pts").alias("pts"), F.sum("size").alias("bytes"), key.alias("is_key"))


def frame_index(packets: DataFrame, ranges: bool | None = None) -> DataFrame:
    """rec_id, frame_no, pts, bytes, cum_bytes, is_key in display order."""
    ranges = outgrown(packets, ["rec_id"]) if ranges is None else ranges
    one = Running(F.lit(1), "count", before=True)
    out = running(carry_null_bytes(packets, ranges), ["rec_id"], ["pts", "-ahead"], ranges, frame_no=one, cum_bytes=Running(F.col("bytes"), "sum"))
    return out.select("rec_id", "frame_no", "pts", "bytes", "cum_bytes", "is_key")


def keyframes(packets: DataFrame) -> DataFrame:
    """rec_id, pts of keyframes, each once."""
    return packets.where("is_key AND pts IS NOT NULL").select("rec_id", "pts").distinct()


def upper_median_gap(points: DataFrame, value: str = "pts", ranges: bool | None = None) -> DataFrame:
    """rec_id, gap: the element of rank n div 2 (from 0) of the sorted gaps between neighbours."""
    ranges = outgrown(points, ["rec_id"]) if ranges is None else ranges
    steps = running(points.select("rec_id", value), ["rec_id"], [value], ranges, earlier=Running(F.col(value), "last", before=True))
    gaps = steps.where("earlier IS NOT NULL").select("rec_id", (F.col(value) - F.col("earlier")).alias("gap"))
    return medians(gaps, ["rec_id"], "gap", ranges).select("rec_id", F.col("high").alias("gap"))


def nearest(points: DataFrame, probes: DataFrame, ranges: bool | None = None) -> DataFrame:
    """rec_id, id, frame_no: the frame nearest to each probe (rec_id, id, q), the earlier of two as near.

    Frames and probes of a recording are merged in one order, along which the last frame is carried from both ends.  Of frames
    with the same pts the first counts.
    """
    ranges = outgrown(points, ["rec_id"]) if ranges is None else ranges
    none = F.lit(None).cast("long")
    frames = points.groupBy("rec_id", F.col("pts").alias("at")).agg(F.min("frame_no").alias("frame_no")).select("rec_id", "at", "frame_no", none.alias("id"), F.lit(0).alias("kind"))
    asked = probes.select("rec_id", F.col("q").alias("at"), none.alias("frame_no"), "id", F.lit(1).alias("kind"))
    frame = F.when(F.col("kind") == 0, F.struct("at", "frame_no"))
    both = running(frames.unionByName(asked), ["rec_id"], ["at", "kind", "id"], ranges, b=Running(frame, "last"), a=Running(frame, "last", backward=True)).where("kind = 1")
    earlier = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("at") - F.col("b.at") <= F.col("a.at") - F.col("at")))
    chosen = F.when(earlier, F.col("b.frame_no")).otherwise(F.col("a.frame_no"))
    return both.select("rec_id", "id", chosen.alias("frame_no")).where("frame_no IS NOT NULL")


def snap(points: DataFrame, probes: DataFrame, ends: DataFrame | None = None, ranges: bool | None = None) -> DataFrame:
    """rec_id, id, down, up, near: the last pts at or before each probe (the first one if none is), the first at or after, the nearer.

    Where none follows, ``up`` is the recording's end (``ends``: rec_id, finish), or null, and ``near`` the last one.  Of two as
    near the earlier.
    """
    ranges = outgrown(points, ["rec_id"]) if ranges is None else ranges
    none = F.lit(None).cast("long")
    frames = points.select("rec_id", F.col("pts").alias("at"), none.alias("id"), F.lit(0).alias("kind"))
    asked = probes.select("rec_id", F.col("q").alias("at"), "id", F.lit(1).alias("kind"))
    pts = F.when(F.col("kind") == 0, F.col("at"))
    both = running(frames.unionByName(asked), ["rec_id"], ["at", "kind", "id"], ranges, before=Running(pts, "max"), after=Running(pts, "min", backward=True)).where("kind = 1")
    both = both.withColumn("up", F.when(F.col("before") == F.col("at"), F.col("at")).otherwise(F.col("after"))).withColumn("down", F.coalesce("before", "after"))
    near = F.when(F.col("before").isNull(), F.col("up")).when(F.col("up").isNull() | (F.col("at") - F.col("before") <= F.col("up") - F.col("at")), F.col("before")).otherwise(F.col("up"))
    out = both.where("down IS NOT NULL").select("rec_id", "id", "down", "up", near.alias("near"))
    if ends is None:
        return out
    return out.join(ends, "rec_id", "left").select("rec_id", "id", "down", F.coalesce("up", "finish").alias("up"), "near")


def seconds_to_ticks(seconds: Column, start: Column, num: int, den: int) -> Column:
    """start + seconds / (num / den), rounded half to even."""
    return start + F.bround(seconds * F.lit(den) / F.lit(num)).cast("long")


def range_bytes(index: DataFrame, spans: DataFrame) -> DataFrame:
    """rec_id, id, bytes of frames a..b (inclusive, each clamped to the index; 0 where b < a after that)."""
    last = index.groupBy("rec_id").agg(F.max("frame_no").alias("last"))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col("last"), F.col(c)))
    held = spans.join(last, "rec_id").select("rec_id", "id", clamp("a").alias("lo"), clamp("b").alias("hi"))
    at = index.select("rec_id", F.col("frame_no").alias("hi"), F.col("cum_bytes").alias("upto"))
    before = index.select("rec_id", (F.col("frame_no") + 1).alias("lo"), F.col("cum_bytes").alias("under"))
    summed = held.join(at, ["rec_id", "hi"], "left").join(before, ["rec_id", "lo"], "left")
    return summed.select("rec_id", "id", F.when(F.col("hi") < F.col("lo"), 0).otherwise(F.col("upto") - F.coalesce("under", F.lit(0))).alias("bytes"))


def size_estimate(index: DataFrame, spans: DataFrame, file_size: DataFrame) -> DataFrame:
    """rec_id, kept_frames, estimate: the kept frames' bytes plus their share of what isn't video (``file_size``: rec_id, size).

    Without any byte counts it is the kept frames' share of the file, and 0 without a size.
    """
    kept = spans.where("b >= a")
    counted = kept.groupBy("rec_id").agg(F.sum(F.col("b") - F.col("a") + 1).alias("kept_frames"))
    video = range_bytes(index, kept).groupBy("rec_id").agg(F.sum("bytes").alias("kept_bytes"))
    whole = index.groupBy("rec_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("video_bytes"), F.count("*").alias("frames"))
    joined = counted.join(video, "rec_id").join(whole, "rec_id").join(file_size, "rec_id")
    share = F.col("kept_frames") / F.col("frames")
    exact = F.col("kept_bytes") + F.greatest(F.lit(0), F.col("size") - F.col("video_bytes")) * share
    told = F.when(F.coalesce("size", F.lit(0)) <= 0, 0.0).when(F.col("video_bytes") <= 0, F.col("size") * share).otherwise(exact)
    return joined.select("rec_id", "kept_frames", F.round(told.cast("double"), 3).alias("estimate"))


def picture_groups(packets: DataFrame, ranges: bool | None = None) -> DataFrame:
    """rec_id, gop, start_pts, end_pts, packets, bytes: a group begins at each keyframe and at the first packet."""
    ranges = outgrown(packets, ["rec_id"]) if ranges is None else ranges
    rows = running(packets.where("pts IS NOT NULL"), ["rec_id"], ["seq"], ranges, keys=Running(F.col("is_key").cast("long"), "sum"))
    groups = rows.groupBy("rec_id", "keys").agg(F.min("pts").alias("start_pts"), F.max("pts").alias("end_pts"), F.count("*").alias("packets"), F.sum("size").alias("bytes"))
    # the first group has no keyframe in front of it, or begins with one
    first = groups.groupBy("rec_id").agg(F.min("keys").alias("first"))
    return groups.join(first, "rec_id").select("rec_id", (F.col("keys") - F.col("first")).alias("gop"), "start_pts", "end_pts", "packets", "bytes")


def clock_jumps(index: DataFrame, threshold: int, ranges: bool | None = None) -> DataFrame:
    """rec_id, split2, amount: steps above ``threshold``; split2 is twice the middle of the gap, amount the gap less the usual step.

    The usual step is the recording's median, cut to a whole number, and 1 at least.
    """
    ranges = outgrown(index, ["rec_id"]) if ranges is None else ranges
    ahead = running(index.select("rec_id", "pts", "frame_no"), ["rec_id"], ["pts", "frame_no"], ranges, ahead=Running(F.col("pts"), "last", backward=True, before=True))
    steps = ahead.where("ahead IS NOT NULL").withColumn("step", F.col("ahead") - F.col("pts"))
    middle = medians(steps, ["rec_id"], "step", ranges).where("n >= 2")
    usual = middle.select("rec_id", F.greatest(F.lit(1), F.floor((F.col("low") + F.col("high")) / 2)).cast("long").alias("usual"))
    leaps = steps.where(F.col("step") > threshold).join(usual, "rec_id")
    return leaps.select("rec_id", (F.col("pts") * 2 + F.col("step")).alias("split2"), (F.col("step") - F.least("usual", "step")).alias("amount"))


def jumped_lengths(spans: DataFrame, jumps: DataFrame) -> DataFrame:
    """rec_id, k, s, e, jumped, out_length, out_start: spans (rec_id, k, s, e) shortened by the jumps strictly inside, laid end to end."""
    from .segments import jumps_inside

    total = jumps_inside(spans, jumps).groupBy("rec_id", "k").agg(F.sum("amount").alias("jumped"))
    out = spans.join(total, ["rec_id", "k"], "left").withColumn("jumped", F.coalesce("jumped", F.lit(0)))
    out = out.withColumn("out_length", F.col("e") - F.col("s") - F.col("jumped"))
    before = F.sum("out_length").over(W.partitionBy("rec_id").orderBy("s", "k").rowsBetween(W.unboundedPreceding, -1))
    return out.select("rec_id", "k", "s", "e", "jumped", "out_length", F.coalesce(before, F.lit(0)).alias("out_start"))


def jump_before(probes: DataFrame, jumps: DataFrame, ranges: bool | None = None) -> DataFrame:
    """rec_id, id, q, jumped: amounts of the jumps at or before each probe, from running totals along both."""
    ranges = outgrown(probes, ["rec_id"]) if ranges is None else ranges
    marks = jumps.select("rec_id", F.col("split2").alias("at2"), "amount", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("q"), F.lit(0).alias("kind"))
    asked = probes.select("rec_id", (F.col("q") * 2).alias("at2"), F.lit(0).cast("long").alias("amount"), "id", "q", F.lit(1).alias("kind"))
    out = running(marks.unionByName(asked), ["rec_id"], ["at2", "kind", "id"], ranges, jumped=Running(F.col("amount"), "sum"))
    return out.where("kind = 1").select("rec_id", "id", "q", "jumped")


def collapse_field_pairs(index: DataFrame, nominal: int) -> DataFrame:
    """rec_id, pts, bytes, is_key after joining half pictures.

    A recording in which any step is over 0 and under three quarters of ``nominal`` is walked in order: a frame nearer than
    that to the last one kept is merged into it.  What is compared with the last frame kept can't be told from neighbours,
    but a step of the limit or more always begins a new frame: only the stretches between such steps are walked, as streams,
    and recordings without a short step aren't at all.
    """
    limit = nominal * 0.75
    w = W.partitionBy("rec_id").orderBy("pts", "frame_no")
    step = F.col("pts") - F.lag("pts").over(w)
    rows = index.select("rec_id", "frame_no", "pts", "bytes", "is_key").withColumn("step", step)
    short = F.max(((F.col("step") > 0) & (F.col("step") < limit)).cast("int")).over(W.partitionBy("rec_id"))
    new = F.when(F.col("step").isNull() | (F.col("step") >= limit), 1).otherwise(0)
    rows = rows.withColumn("gate", F.coalesce(short, F.lit(0))).withColumn("stretch", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        kept = None
        for pts, _, size, is_key in part:
            if kept is not None and pts - kept[1] < limit:
                kept[2] += size
                continue
            if kept is not None:
                yield tuple(kept)
            kept = [key[0], pts, size, is_key]
        if kept is not None:
            yield tuple(kept)

    gated = rows.where("gate = 1").select("rec_id", "stretch", "pts", "frame_no", "bytes", "is_key")
    joined = by_group(gated, ["rec_id", "stretch"], ["pts", "frame_no"], walk, "rec_id long, pts long, bytes long, is_key boolean")
    return rows.where("gate = 0").select("rec_id", "pts", "bytes", "is_key").unionByName(joined)


# Unit types of pictures that can be cut at, of open-group keyframes, and of pictures shown before them.
SAFE_UNITS = (16, 17, 18, 19, 20, 21, 32, 33, 34)
OPEN_UNIT = 21
LEADING_UNITS, SKIPPED_UNITS = (6, 7, 8, 9), (8, 9)


def decodable_groups(packets: DataFrame) -> DataFrame:
    """rec_id, gop, start_pts, start_dts, end_dts, packets, leading_end_dts, skipped of groups that can be cut at.

    ``packets`` has rec_id, seq, pts, dts, is_key, unit.  A group begins at the first keyframe, and at each one whose unit is a
    safe one (or isn't known); packets in front of the first belong to none.  ``end_dts`` is the last dts seen in it (else the
    last pts).  Behind an open group's keyframe leading pictures may follow: ``leading_end_dts`` is the dts of the first picture
    behind those, the last one's where none follows, and ``skipped`` says that some of them can't be decoded after a cut.
    """
    w = W.partitionBy("rec_id").orderBy("seq")
    sofar = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.sum(F.col("is_key").cast("int")).over(sofar) == 1
    opens = F.col("is_key") & (first | F.col("unit").isNull() | F.col("unit").isin(*SAFE_UNITS))
    rows = packets.withColumn("opens", opens).withColumn("gop", (F.sum(F.col("opens").cast("int")).over(sofar) - 1).cast("long")).where("gop >= 0")
    own = W.partitionBy("rec_id", "gop").orderBy("seq")
    leading = F.coalesce(F.col("unit").isin(*LEADING_UNITS), F.lit(False))
    plain = F.min(F.when(~leading & ~F.col("opens"), F.col("seq"))).over(W.partitionBy("rec_id", "gop"))
    rows = rows.withColumns({"plain": plain, "open": F.first(F.col("unit") == OPEN_UNIT).over(own), "seen": F.coalesce("dts", "pts")})
    ahead = F.coalesce(F.col("open"), F.lit(False)) & leading & ~F.col("opens") & (F.col("plain").isNull() | (F.col("seq") < F.col("plain")))
    rows = rows.withColumn("ahead", ahead)
    at = lambda cond, c: F.max(F.when(cond, F.col(c)))
    last = F.max(F.struct("seq", "seen"))["seen"]
    agg = rows.groupBy("rec_id", "gop").agg(
        at(F.col("opens"), "pts").alias("start_pts"), at(F.col("opens"), "dts").alias("start_dts"), last.alias("end_dts"), F.count("*").alias("packets"),
        at(F.col("seq") == F.col("plain"), "dts").alias("plain_dts"), F.count(F.when(F.col("ahead"), 1)).alias("n"), F.max("plain").alias("plain"),
        F.coalesce(F.bool_or(F.col("ahead") & F.col("unit").isin(*SKIPPED_UNITS)), F.lit(False)).alias("skipped"),
    )
    leading_end = F.when(F.col("n") > 0, F.when(F.col("plain").isNotNull(), F.col("plain_dts")).otherwise(F.col("end_dts")))
    return agg.select("rec_id", "gop", "start_pts", "start_dts", "end_dts", "packets", leading_end.alias("leading_end_dts"), "skipped")
