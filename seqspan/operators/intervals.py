"""Interval algebra on inclusive integer ranges of recordings: (rec_id, start_f, end_f)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .walks import by_group


def ordered(rows: DataFrame) -> DataFrame:
    """Reversed ranges turned round."""
    return rows.withColumns({"start_f": F.least("start_f", "end_f"), "end_f": F.greatest("start_f", "end_f")})


def union(rows: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Overlapping ranges, and those that touch (a gap of at most 1), become one: gaps and islands over one sort."""
    w = W.partitionBy(*keys).orderBy("start_f", "end_f")
    reach = F.max("end_f").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ordered(rows).withColumn("new", F.when(reach.isNull() | (F.col("start_f") > reach + 1), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*keys, "island").agg(F.min("start_f").alias("start_f"), F.max("end_f").alias("end_f")).drop("island")


def complement(removed: DataFrame, bounds: DataFrame, overflow: bool = False) -> DataFrame:
    """What is left of [0, n - 1] (``bounds``: rec_id, n) without the removed ranges, which may overlap.

    With ``overflow`` a removed range that starts past the end leaves a range up to it, as two of the project formats have it.
    """
    w = W.partitionBy("rec_id").orderBy("start_f", "end_f")
    inside = ordered(removed).join(bounds, "rec_id")
    if not overflow:
        inside = inside.where((F.col("end_f") >= 0) & (F.col("start_f") < F.col("n")))
    held = inside.withColumn("end_f", F.least(F.col("end_f"), F.col("n") - 1)).select("rec_id", "start_f", "end_f", "n")
    reach = F.greatest(F.lit(-1), F.coalesce(F.max("end_f").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    if overflow:
        starts = F.greatest(F.lit(-1), F.coalesce(F.max(F.greatest("start_f", F.col("end_f") + 1) - 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
        reach = F.greatest(reach, F.least(starts, F.col("n") - 1))
    gaps = held.select("rec_id", (reach + 1).alias("a"), (F.col("start_f") - 1).alias("b"))
    last = held.groupBy("rec_id").agg(F.max("end_f").alias("last"))
    tail = bounds.join(last, "rec_id", "left").select("rec_id", F.coalesce(F.col("last") + 1, F.lit(0)).alias("a"), (F.col("n") - 1).alias("b"))
    return gaps.unionByName(tail).where("b >= a").select("rec_id", F.col("a").alias("start_f"), F.col("b").alias("end_f"))


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    """Each range at every bucket of ``width`` that it touches."""
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_f") / width).cast("long"), F.floor(F.col("end_f") / width).cast("long"))))


def overlapping(left: DataFrame, right: DataFrame, width: int = 64, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of overlapping ranges: the columns of ``left`` and s, e (and ``more``) of ``right``, each once.

    An equality join on recording and bucket stands in for the range join; a pair counts in the bucket where it begins.
    """
    r = _pieces(right.select("rec_id", "start_f", "end_f", *more), width).select("rec_id", "bucket", F.col("start_f").alias("s"), F.col("end_f").alias("e"), *more)
    pairs = _pieces(left, width).join(r, ["rec_id", "bucket"]).where((F.col("s") <= F.col("end_f")) & (F.col("e") >= F.col("start_f")))
    return pairs.where(F.floor(F.greatest("start_f", "s") / width) == F.col("bucket")).drop("bucket")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """The common parts of two sets of disjoint ranges."""
    pairs = overlapping(left.select("rec_id", "start_f", "end_f"), right)
    return pairs.select("rec_id", F.greatest("start_f", "s").alias("start_f"), F.least("end_f", "e").alias("end_f"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """What is left of each disjoint range of ``left`` without those of ``right``, which are united first."""
    base = left.select("rec_id", "start_f", "end_f")
    cut = overlapping(base, union(right))
    w = W.partitionBy("rec_id", "start_f", "end_f").orderBy("s")
    after = cut.select("rec_id", "start_f", "end_f", (F.col("e") + 1).alias("a"), (F.coalesce(F.lead("s").over(w), F.col("end_f") + 1) - 1).alias("b"))
    first = cut.groupBy("rec_id", "start_f", "end_f").agg(F.min("s").alias("s")).select("rec_id", "start_f", "end_f", F.col("start_f").alias("a"), (F.col("s") - 1).alias("b"))
    whole = base.join(cut.select("rec_id", "start_f", "end_f").distinct(), ["rec_id", "start_f", "end_f"], "left_anti")
    pieces = after.unionByName(first).where("b >= a").select("rec_id", F.col("a").alias("start_f"), F.col("b").alias("end_f"))
    return pieces.unionByName(whole)


def commit(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds one span to each recording's disjoint ranges: it replaces all that it overlaps; else it joins those it touches."""
    span = ordered(spans).select("rec_id", F.col("start_f").alias("s"), F.col("end_f").alias("e"))
    hit = rows.join(span, "rec_id").where((F.col("start_f") <= F.col("e")) & (F.col("end_f") >= F.col("s")))
    replaced = hit.select("rec_id").distinct()
    kept = rows.join(hit.select("rec_id", "start_f", "end_f"), ["rec_id", "start_f", "end_f"], "left_anti")
    added = kept.select("rec_id", "start_f", "end_f").unionByName(ordered(spans).select("rec_id", "start_f", "end_f"))
    return added.join(replaced, "rec_id", "left_semi").unionByName(union(added.join(replaced, "rec_id", "left_anti")))


def replace_cuts(keeps: DataFrame, old_cuts: DataFrame, new_cuts: DataFrame) -> DataFrame:
    """Old cuts are given back to what is kept, then the new ones are taken away."""
    cols = ["rec_id", "start_f", "end_f"]
    return subtract(union(keeps.select(cols).unionByName(old_cuts.select(cols))), new_cuts)


def containing(points: DataFrame, rows: DataFrame, width: int = 64) -> DataFrame:
    """rec_id, id, range_no of the first range that holds each point (rec_id, id, at); ranges are numbered from 0."""
    numbered = rows.withColumn("range_no", (F.row_number().over(W.partitionBy("rec_id").orderBy("start_f", "end_f")) - 1).cast("long"))
    asked = points.withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
    hit = asked.join(_pieces(numbered, width), ["rec_id", "bucket"]).where((F.col("start_f") <= F.col("at")) & (F.col("at") <= F.col("end_f")))
    return hit.groupBy("rec_id", "id").agg(F.min("range_no").alias("range_no"))


def remove_numbered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Disjoint ranges without those of the given numbers (rec_id, range_no; repeats count once)."""
    numbered = rows.withColumn("range_no", (F.row_number().over(W.partitionBy("rec_id").orderBy("start_f", "end_f")) - 1).cast("long"))
    return numbered.join(numbers.distinct(), ["rec_id", "range_no"], "left_anti").select("rec_id", "start_f", "end_f")


def neighbours(markers: DataFrame, at: DataFrame) -> DataFrame:
    """rec_id, id, following, preceding: the next and the previous marker of each frame (rec_id, id, at), going round at the ends.

    A recording without markers gives the frame itself.
    """
    m = F.when(F.col("kind") == 0, F.col("at"))
    both = markers.select("rec_id", F.col("frame").alias("at"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("kind")).unionByName(at.select("rec_id", "at", "id", F.lit(1).alias("kind")))
    w = W.partitionBy("rec_id")
    before = F.max(m).over(w.orderBy("at").rangeBetween(W.unboundedPreceding, -1))
    after = F.min(m).over(w.orderBy("at").rangeBetween(1, W.unboundedFollowing))
    out = both.select("*", before.alias("before"), after.alias("after"), F.min(m).over(w).alias("lowest"), F.max(m).over(w).alias("highest")).where("kind = 1")
    return out.select("rec_id", "id", F.coalesce("after", "lowest", "at").alias("following"), F.coalesce("before", "highest", "at").alias("preceding"))


def mismatch(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """rec_id, verdict: whether cuts (rec_id, a, b) can belong to a recording of that duration.

    ``error`` where a cut ends over 1 past the end, ``warning`` where the recording is more than twice as long as the cuts
    reach, else ``fine``.
    """
    ends = cuts.groupBy("rec_id").agg(F.max("b").alias("last"), (F.max("b") - F.min("a")).alias("span"))
    verdict = F.when(F.col("last") > F.col("duration") + 1, "error").when((F.col("span") > 0) & (F.col("duration") > F.col("last") * 2), "warning").otherwise("fine")
    return ends.join(durations, "rec_id").select("rec_id", "last", "span", verdict.alias("verdict"))


def split_padding(cuts: DataFrame, durations: DataFrame, margin: int = 5) -> DataFrame:
    """The cuts with kind ``padding`` (at either end of the recording) or ``advert``."""
    longest = cuts.groupBy("rec_id").agg(F.max("b").alias("last"))
    known = cuts.join(longest, "rec_id").join(durations, "rec_id").withColumn("end", F.greatest("last", "duration"))
    edge = (F.col("a") <= margin) | (F.col("b") >= F.col("end") - margin)
    return known.select("rec_id", "id", "a", "b", F.when(edge, "padding").otherwise("advert").alias("kind"))


def learnable(split: DataFrame, durations: DataFrame, shortest: int, longest: int, most: float = 0.5) -> DataFrame:
    """rec_id, reason: why a recording's cuts are no good to learn from, the first that holds, or ``ok``."""
    length = F.col("b") - F.col("a")
    advert = F.col("kind") == "advert"
    facts = split.groupBy("rec_id").agg(
        F.count(F.when(advert, 1)).alias("adverts"),
        F.count(F.when(advert & ((length < shortest) | (length > longest)), 1)).alias("odd"),
        F.sum(F.when(advert, length).otherwise(0)).alias("removed"),
    )
    rows = durations.join(facts, "rec_id", "left")
    reason = (
        F.when(F.col("adverts").isNull(), "no cuts").when(F.col("adverts") == 0, "only padding").when(F.col("odd") > 0, "length")
        .when((F.col("duration") > 0) & (F.col("removed") > F.col("duration") * most), "too much").otherwise("ok")
    )
    return rows.select("rec_id", reason.alias("reason"))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length that [a, b] and [c, d] have in common, 0 or below if none."""
    return F.least(b, d) - F.greatest(a, c)


def edit_log(edits: DataFrame) -> DataFrame:
    """rec_id, ranges, undos, redos after an ordered log of edits: rec_id, seq, action (add, remove, undo, redo), start_f, end_f.

    A fold over each recording's log, read as a stream; a new edit forgets what could be redone, and one that changes nothing
    isn't noted.  What is held is the ranges as they are, and for each edit the ranges that it took away and put in.
    """

    def apply(ranges: list[tuple[int, int]], gone: list[tuple[int, int]], come: list[tuple[int, int]]) -> None:
        for r in gone:
            del ranges[bisect_left(ranges, r)]
        for r in come:
            insort(ranges, r)

    def change(ranges: list[tuple[int, int]], action: str, s: int, e: int) -> tuple[list, list]:
        near = 1 if action == "add" else 0
        at = bisect_left(ranges, (s - near,))
        if at and ranges[at - 1][1] >= s - near:
            at -= 1
        gone = []
        while at < len(ranges) and ranges[at][0] <= e + near:
            gone.append(ranges[at])
            at += 1
        if action == "add":
            come = [(min([s, *(a for a, _ in gone)]), max([e, *(b for _, b in gone)]))]
        else:
            come = [(a, s - 1) for a, _ in gone if a < s] + [(e + 1, b) for _, b in gone if b > e]
        return ([], []) if gone == come else (gone, come)

    def fold(key: tuple, log: Iterator[tuple]) -> Iterator[tuple]:
        now, undo, redo = [], [], []
        for _, action, start, end in log:
            if action == "undo":
                if undo:
                    gone, come = undo.pop()
                    apply(now, come, gone)
                    redo.append((gone, come))
            elif action == "redo":
                if redo:
                    step = redo.pop()
                    apply(now, *step)
                    undo.append(step)
            else:
                step = change(now, action, min(start, end), max(start, end))
                if step != ([], []):
                    apply(now, *step)
                    undo.append(step)
                    redo = []
        yield key[0], ",".join(f"{a}-{b}" for a, b in now), len(undo), len(redo)

    return by_group(edits.select("rec_id", "seq", "action", "start_f", "end_f"), ["rec_id"], ["seq"], fold, "rec_id long, ranges string, undos long, redos long")


def toggled(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """rec_id, frame: markers after each of the given frames (rec_id, frame) was switched: set where it was none, else taken away."""
    times = frames.groupBy("rec_id", "frame").agg(F.count("*").alias("n"))
    both = markers.select("rec_id", "frame").distinct().withColumn("set", F.lit(1)).join(times, ["rec_id", "frame"], "full_outer")
    return both.where((F.coalesce("set", F.lit(0)) + F.coalesce("n", F.lit(0))) % 2 == 1).select("rec_id", "frame")
