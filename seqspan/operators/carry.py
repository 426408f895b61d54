"""What is carried over a cut or a join: subtitles, grafted sound, frame numbers of half-picture recordings, display order."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames, intervals
from .segments import in_spans, jumps_inside, monotone
from .walks import by_group


def native_frames(index: DataFrame, native: DataFrame) -> DataFrame:
    """rec_id, frame_no, native_no, collapsed: each indexed frame's number among all coded pictures.

    The same number if a recording has as many frames as pictures; else the picture nearest in time, the earlier of two.
    """
    count = lambda rows, name: rows.groupBy("rec_id").agg(F.count("*").alias(name))
    sizes = count(index, "have").join(count(native, "coded"), "rec_id").select("rec_id", (F.col("have") != F.col("coded")).alias("collapsed"))
    near = frames.nearest(native, index.select("rec_id", F.col("frame_no").alias("id"), F.col("pts").alias("q"))).select("rec_id", F.col("id").alias("frame_no"), F.col("frame_no").alias("near"))
    out = index.select("rec_id", "frame_no").join(sizes, "rec_id").join(near, ["rec_id", "frame_no"])
    return out.select("rec_id", "frame_no", F.when(F.col("collapsed"), F.col("near")).otherwise(F.col("frame_no")).alias("native_no"), "collapsed")


def cut_seconds(keeps: DataFrame, index: DataFrame, rate: float) -> DataFrame:
    """rec_id, a, b: what is removed between the kept frames (rec_id, start_f, end_f), in seconds from the first frame.

    Ranges past the last frame keep nothing: what is removed ends with that.
    """
    ends = index.groupBy("rec_id").agg(F.count("*").alias("n"), F.min("pts").alias("start"))
    removed = intervals.complement(keeps, ends.select("rec_id", "n"))
    at = lambda f, name: index.select("rec_id", F.col("frame_no").alias(f), F.col("pts").alias(name))
    out = removed.join(at("start_f", "x"), ["rec_id", "start_f"]).join(at("end_f", "y"), ["rec_id", "end_f"]).join(ends, "rec_id")
    return out.select("rec_id", ((F.col("x") - F.col("start")) / rate).alias("a"), ((F.col("y") - F.col("start")) / rate).alias("b"))


def display_order(packets: DataFrame, depth: int = 15) -> DataFrame:
    """rec_id, seq, place, held: pictures that come in decoding order, by pts; ``held`` is how many later ones came before it.

    A buffer of ``depth`` pictures gives the same order as long as no more are held; nulls are left out.
    """
    rows = packets.where("pts IS NOT NULL")
    place = F.row_number().over(W.partitionBy("rec_id").orderBy("pts", "seq")) - 1
    came = F.row_number().over(W.partitionBy("rec_id").orderBy("seq")) - 1
    late = F.greatest(F.lit(0), F.col("came") - F.col("place"))
    out = rows.select("rec_id", "seq", place.cast("long").alias("place"), came.cast("long").alias("came"))
    return out.select("rec_id", "seq", "place", late.alias("held"), (late <= depth).alias("in_depth"))


#: What stands for a pts, or a decoding time, that isn't known.
_UNKNOWN = -1


class ReorderBuffer:
    """Pictures that come in decoding order and leave by pts, a bounded number of them held.

    While more than ``depth`` are held, the one with the lowest pts leaves if its pts isn't past the present decoding time
    (the last that was known).  A picture without pts counts as the lowest.  At the end the others leave in order, up to the
    first without pts.
    """

    def __init__(self, depth: int, held: Iterable[tuple] = (), now: int | None = None):
        self.depth, self.held, self.now = depth, [tuple(x) for x in held], now
        heapq.heapify(self.held)

    def push(self, seq: int, pts: int | None, dts: int | None) -> Iterator[tuple[int, int | None]]:
        """Takes in a picture; what leaves: (seq, pts)."""
        self.now = dts if dts is not None else _UNKNOWN if self.now is None else self.now
        heapq.heappush(self.held, (_UNKNOWN if pts is None else pts, seq, pts is not None))
        while len(self.held) > self.depth and self.held[0][0] <= self.now:
            yield self._pop()

    def flush(self) -> Iterator[tuple[int, int | None]]:
        while self.held and self.held[0][2]:
            yield self._pop()

    def _pop(self) -> tuple[int, int | None]:
        pts, seq, known = heapq.heappop(self.held)
        return seq, pts if known else None


def reordered(packets: DataFrame, depth: int = 15) -> DataFrame:
    """rec_id, place, seq, pts: pictures (rec_id, seq, pts, dts) as a :class:`ReorderBuffer` lets go of them.

    Recordings are walked as sorted streams; a task holds what the buffer holds.
    """

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        buffer, place = ReorderBuffer(depth), 0

        def out(left: Iterator[tuple[int, int | None]]) -> Iterator[tuple]:
            nonlocal place
            for seq, pts in left:
                yield key[0], place, seq, pts
                place += 1

        for seq, pts, dts in part:
            yield from out(buffer.push(seq, pts, dts))
        yield from out(buffer.flush())

    return by_group(packets.select("rec_id", "seq", "pts", "dts"), ["rec_id"], ["seq"], walk, "rec_id long, place long, seq long, pts long")


def moved(packets: DataFrame, spans: DataFrame, held: DataFrame, jumps: DataFrame, width: int) -> DataFrame:
    """rec_id, seq, k, out: packets in spans (``held``: what to look in), moved to the output; jumps inside a span are taken off."""
    inside = jumps_inside(spans, jumps)
    lost = inside.groupBy("rec_id", "k").agg(F.sum("amount").alias("lost"))
    w = W.partitionBy("rec_id").orderBy("s", "k").rowsBetween(W.unboundedPreceding, -1)
    length = F.col("e") - F.col("s") - F.coalesce("lost", F.lit(0))
    laid = spans.join(lost, ["rec_id", "k"], "left").withColumn("length", length).withColumn("begin", F.coalesce(F.sum("length").over(w), F.lit(0)))
    hit = in_spans(packets.where("pts IS NOT NULL"), held, "pts", width).select("rec_id", "seq", "pts", "k")
    marks = inside.select("rec_id", "k", F.col("split2").alias("at2"), "amount", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("kind"))
    asked = hit.select("rec_id", "k", (F.col("pts") * 2).alias("at2"), F.lit(0).cast("long").alias("amount"), "seq", F.lit(1).alias("kind"))
    upto = F.sum("amount").over(W.partitionBy("rec_id", "k").orderBy("at2", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = marks.unionByName(asked).withColumn("jumped", upto).where("kind = 1").select("rec_id", "k", "seq", "jumped")
    out = hit.join(before, ["rec_id", "k", "seq"]).join(laid.select("rec_id", "k", "s", "begin"), ["rec_id", "k"])
    return out.select("rec_id", "seq", "k", (F.col("pts") - F.col("s") - F.col("jumped") + F.col("begin")).alias("out"), "begin")


def sliced_subtitles(packets: DataFrame, spans: DataFrame, jumps: DataFrame, width: int) -> DataFrame:
    """rec_id, seq, k, out: subtitles (rec_id, seq, pts) that start in a kept span (rec_id, k, s, e), at their time in the output.

    Clock jumps inside a span at or before a subtitle are taken off, and from the span's own length.  A time below the one
    before it (by seq) becomes one more than that.
    """
    return rising(moved(packets, spans, spans, jumps, width))


def sliced_sound(packets: DataFrame, spans: DataFrame, jumps: DataFrame, width: int) -> DataFrame:
    """rec_id, seq, k, out: sound (rec_id, seq, pts) in kept spans (rec_id, k, s, e), at its time in the output.

    As for subtitles, but times rise by one at least, and a span from 0 or before takes all that lies in front of it.
    """
    first = packets.groupBy("rec_id").agg(F.min("pts").alias("lo"))
    held = spans.join(first, "rec_id").select("rec_id", "k", F.when(F.col("s") <= 0, F.least("s", "lo")).otherwise(F.col("s")).alias("s"), "e")
    return monotone(moved(packets, spans, held, jumps, width), "out", "seq").select("rec_id", "seq", "k", F.col("fixed").alias("out"))


def rising(rows: DataFrame) -> DataFrame:
    """``rows`` (rec_id, seq, k, out) with times that never fall: one below the time before it becomes that and 1."""

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for seq, k, out in part:
            last = last + 1 if last is not None and out < last else out
            yield key[0], seq, k, last

    return by_group(rows.select("rec_id", "seq", "k", "out"), ["rec_id"], ["seq", "k"], walk, "rec_id long, seq long, k long, out long")


def grafted(packets: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """rec_id, track, seq, out: each track's sound in the kept spans, all tracks from one origin.

    ``packets`` has rec_id, track, seq, pts; spans count from the recording's origin, which is where its first track starts,
    so that tracks that start at different times stay apart by as much.  Of spans that hold a packet the first counts.
    """
    from .segments import restamp

    first = packets.groupBy("rec_id").agg(F.min(F.struct("track", "seq"))["track"].alias("lead"))
    origin = packets.join(first, "rec_id").where("track = lead AND pts IS NOT NULL").groupBy("rec_id").agg(F.min("pts").alias("origin"))
    rows = packets.join(origin, "rec_id").select("rec_id", F.struct("track", "seq").alias("seq"), (F.col("pts") - F.col("origin")).alias("pts"))
    return restamp(rows, spans, width).select("rec_id", "seq.track", "seq.seq", "out")


def carried_subtitles(sets: DataFrame, scenes: DataFrame) -> DataFrame:
    """list_id, at, kind, id of subtitles in a join: each scene's sets (list_id, seq, id, rel) at the scene's offset.

    ``scenes`` has list_id, seq, length.  Sets before the scene or from its end on are left out; a scene that has any is
    cleared at its end.
    """
    w = W.partitionBy("list_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    laid = scenes.select("list_id", "seq", "length", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
    held = sets.join(laid, ["list_id", "seq"])
    shown = held.where("rel >= 0 AND rel < length").select("list_id", (F.col("offset") + F.col("rel")).alias("at"), F.lit("show").alias("kind"), "id")
    clear = held.select("list_id", "seq", (F.col("offset") + F.col("length")).alias("at")).distinct().select("list_id", "at", F.lit("clear").alias("kind"), F.lit(-1).cast("long").alias("id"))
    return shown.unionByName(clear)
