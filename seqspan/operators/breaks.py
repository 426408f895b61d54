"""Break detection: coincident signals, brackets, edge refinement, choice without overlap, and scoring."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .intervals import overlapping
from .walks import by_group, islands


def _near(left: DataFrame, right: DataFrame, lo: str, hi: str, window: int, width: int) -> DataFrame:
    """Keys of ``left`` (rec_id, id, lo, hi) that come within ``window`` of a row of ``right`` (rec_id, t0, t1): bucketed semi join."""
    pieces = lambda d, a, b: d.withColumn("bucket", F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))))
    l_ = pieces(left, F.col(lo) - window, F.col(hi) + window)
    r = pieces(right.select("rec_id", F.col("t0").alias("r0"), F.col("t1").alias("r1")), F.col("r0"), F.col("r1"))
    return l_.join(r, ["rec_id", "bucket"]).where((F.col("r0") <= F.col(hi) + window) & (F.col("r1") >= F.col(lo) - window)).select("rec_id", "id").distinct()


def black_events(signals: DataFrame, window: int, width: int = 1 << 20) -> DataFrame:
    """rec_id, id, mid2, score: black intervals score 1, with a silence close by 1 more, with a scene change 0.5 more.

    mid2 is twice the middle, so that times stay whole numbers.
    """
    of = lambda kind: signals.where(F.col("kind") == kind)
    black = of("black").select("rec_id", "id", (F.col("t0") + F.col("t1")).alias("mid2")).withColumns({"lo": F.floor(F.col("mid2") / 2).cast("long"), "hi": F.ceil(F.col("mid2") / 2).cast("long")})
    silent = _near(black, of("silence"), "lo", "hi", window, width).withColumn("silent", F.lit(True))
    scene = _near(black, of("scene").withColumn("t1", F.col("t0")), "lo", "hi", window, width).withColumn("cut", F.lit(True))
    out = black.join(silent, ["rec_id", "id"], "left").join(scene, ["rec_id", "id"], "left")
    score = 1.0 + F.when(F.col("silent"), 1.0).otherwise(0.0) + F.when(F.col("cut"), 0.5).otherwise(0.0)
    return out.select("rec_id", "id", "mid2", score.alias("score"))


def coincidences(signals: DataFrame, window: int) -> DataFrame:
    """rec_id, t2, score: all instants of evidence (t2 is twice the time).

    A silence stands by itself (0.6, with a scene change 1.0) if its middle is not within ``window`` of any event, silences
    taken before it among them.  That depends on the order of the silences, but only within a stretch in which neighbours are
    that near; each stretch is walked by itself.
    """
    black = black_events(signals, window).select("rec_id", F.col("mid2").alias("t2"), "score", F.lit(-1).cast("long").alias("t0"), F.lit(-1).cast("long").alias("id"))
    silence = signals.where("kind = 'silence'").select("rec_id", "id", (F.col("t0") + F.col("t1")).alias("mid2"), "t0")
    flagged = silence.withColumns({"lo": F.floor(F.col("mid2") / 2).cast("long"), "hi": F.ceil(F.col("mid2") / 2).cast("long")})
    scene = _near(flagged, signals.where("kind = 'scene'").withColumn("t1", F.col("t0")), "lo", "hi", window, 1 << 20).withColumn("cut", F.lit(True))
    alone = silence.join(scene, ["rec_id", "id"], "left").select("rec_id", F.col("mid2").alias("t2"), F.when(F.col("cut"), 1.0).otherwise(0.6).alias("score"), "t0", "id")
    rows = black.withColumn("kind", F.lit(0)).unionByName(alone.withColumn("kind", F.lit(1)))
    rows = islands(rows, ["rec_id"], ["t2", "kind"], lambda far: F.col("t2") - far > 2 * window, "t2").select("rec_id", "island", "kind", "t0", "id", "t2", "score")

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        taken: list[int] = []
        for kind, _, _, t2, score in part:
            at = bisect_left(taken, t2 - 2 * window)
            if kind and at < len(taken) and taken[at] <= t2 + 2 * window:
                continue
            insort(taken, t2)
            yield key[0], t2, score

    return by_group(rows, ["rec_id", "island"], ["kind", "t0", "id"], walk, "rec_id long, t2 long, score double")


def _in_reach(brackets: DataFrame, points: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """Brackets with the points (rec_id, t, score) in [lo, hi]: an equality join on recording and bucket."""
    spread = brackets.withColumns({"from": lo, "to": hi}).where("to >= from")
    spread = spread.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / width).cast("long"), F.floor(F.col("to") / width).cast("long"))))
    return spread.join(points.withColumn("bucket", F.floor(F.col("t") / width).cast("long")), ["rec_id", "bucket"]).where("t BETWEEN from AND to")


def refine_edges(brackets: DataFrame, events: DataFrame, search: int, slack: int, cost: float) -> DataFrame:
    """Adds a, sa, b, sb: each edge moved to the best event close by, looking inward, and its score (the edge itself and 0 if none).

    Brackets have rec_id, id, lo, hi; events rec_id, t, score.  An event's worth is its score less ``cost`` a unit of
    distance; of equals the earlier, then the weaker one.
    """

    def edge(at: str, back: int, ahead: int, time: str, score: str) -> DataFrame:
        lo, hi = F.greatest(F.col(at) - back, F.col("lo") - slack), F.least(F.col(at) + ahead, F.col("hi") + slack)
        seen = _in_reach(brackets.select("rec_id", "id", "lo", "hi"), events, lo, hi, max(1, back + ahead))
        worth = F.round(F.col("score") - F.abs(F.col("t") - F.col(at)) * cost, 9)
        best = F.min(F.struct((-worth).alias("w"), "t", "score"))
        return seen.groupBy("rec_id", "id").agg(best.alias("x")).select("rec_id", "id", F.col("x.t").alias(time), F.col("x.score").alias(score))

    out = brackets.join(edge("lo", slack, search, "a", "sa"), ["rec_id", "id"], "left").join(edge("hi", search, slack, "b", "sb"), ["rec_id", "id"], "left")
    return out.withColumns({"a": F.coalesce("a", "lo"), "sa": F.coalesce("sa", F.lit(0.0)), "b": F.coalesce("b", "hi"), "sb": F.coalesce("sb", F.lit(0.0))})


@dataclass(frozen=True)
class BreakRules:
    """What a break may be, in the unit of the times."""

    shortest: int
    shortest_sure: int
    longest: int
    edge: int
    most_of_recording: float = 0.5


def judged(refined: DataFrame, ends: DataFrame, rules: BreakRules) -> DataFrame:
    """Adds ``reason``: why a refined bracket is no break (the first that holds), or ``kept``.

    ``refined`` has rec_id, id, lo, hi, support, sure, a, sa, b, sb; ``ends`` rec_id, finish.
    """
    rows = refined.join(ends, "rec_id")
    floor = F.when(F.col("sure"), rules.shortest_sure).otherwise(rules.shortest)
    length = F.col("b") - F.col("a")
    at_start, at_end = F.col("lo") <= rules.edge, (F.col("finish") > 0) & (F.col("hi") >= F.col("finish") - rules.edge)
    starts, ends_ = (F.col("sa") > 0) | at_start, (F.col("sb") > 0) | at_end
    reason = (
        F.when(F.col("hi") - F.col("lo") < floor, "short")
        .when(length < floor, "short when refined")
        .when((at_start | at_end) & (F.col("finish") > 0) & (length > F.col("finish") * rules.most_of_recording), "most of the recording")
        .when((length > rules.longest) & ~(at_start | at_end), "long")
        .when(~starts & ~ends_, "no evidence")
        .when((length < rules.shortest) & ~(starts & ends_), "short with one edge")
        .otherwise("kept")
    )
    return rows.withColumn("reason", reason)


def choose(candidates: DataFrame) -> DataFrame:
    """rec_id, a, b: greedy choice without overlap by support, evidence, and then the later start and end.

    ``candidates`` has rec_id, support, evidence, a, b.  What is taken depends on what was taken before, but only among
    candidates that overlapping ones connect: each such stretch of a recording is walked by itself, and what is taken of it is
    kept in order.
    """
    rows = candidates.select("rec_id", "support", "evidence", "a", "b")
    rows = islands(rows, ["rec_id"], ["a", "b"], lambda far: F.col("a") >= far, "b")
    ranked = rows.select("rec_id", "island", (-F.col("support")).alias("s"), (-F.col("evidence")).alias("e"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        starts: list[int] = []
        ends: list[int] = []
        for _, _, x, y in part:
            a, b = -x, -y
            if b > a:
                at = bisect_left(starts, b)  # those before it start early enough to meet this one
                if at and ends[at - 1] > a:
                    continue
                starts.insert(at, a)
                ends.insert(at, b)
            yield key[0], a, b

    return by_group(ranked, ["rec_id", "island"], ["s", "e", "x", "y"], walk, "rec_id long, a long, b long")


def snap_to_ends(breaks: DataFrame, ends: DataFrame, slack: int) -> DataFrame:
    """A first break that begins within ``slack`` of the start begins there; a last one that ends so near the end ends at the duration.

    ``ends`` has rec_id, finish, duration.
    """
    w = W.partitionBy("rec_id")
    first = F.row_number().over(w.orderBy("a", "b")) == 1
    last = F.row_number().over(w.orderBy(F.desc("a"), F.desc("b"))) == 1
    marked = breaks.join(ends, "rec_id").withColumn("first", first).withColumn("last", last)
    a = F.when(F.col("first") & (F.col("a") <= slack), 0).otherwise(F.col("a"))
    b = F.when(F.col("last") & (F.col("finish") > 0) & (F.col("b") >= F.col("finish") - slack), F.greatest("duration", "finish")).otherwise(F.col("b"))
    return marked.select("rec_id", a.alias("a"), b.alias("b"))


def density_brackets(events: DataFrame, strong: float, shortest: int, longest: int, density: float) -> DataFrame:
    """rec_id, lo, hi, inside: pairs of strong events at a break's distance with enough evidence a unit of time between them.

    The evidence between two events is a difference of running totals; pairs are found by buckets of ``longest``.
    """
    w = W.partitionBy("rec_id").orderBy("t")
    upto, before = F.sum("score").over(w.rangeBetween(W.unboundedPreceding, W.currentRow)), F.sum("score").over(w.rangeBetween(W.unboundedPreceding, -1))
    tallied = events.withColumns({"upto": upto, "before": F.coalesce(before, F.lit(0.0)), "bucket": F.floor(F.col("t") / longest).cast("long")}).where(F.col("score") >= strong)
    lows = tallied.select("rec_id", F.col("t").alias("lo"), F.col("upto").alias("u"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket")).distinct()
    highs = tallied.select("rec_id", F.col("t").alias("hi"), F.col("before").alias("v"), "bucket").distinct()
    length = F.col("hi") - F.col("lo")
    pairs = lows.join(highs, ["rec_id", "bucket"]).where((length >= shortest) & (length <= longest))
    inside = F.round(F.col("v") - F.col("u"), 6)
    return pairs.where(inside / length >= density).select("rec_id", "lo", "hi", inside.alias("inside"))


def disagreements(brackets: DataFrame, marks: DataFrame, ends: DataFrame, threshold: float, edge: int, width: int = 64) -> DataFrame:
    """Adds ``covered`` and ``dropped``: whether marks (rec_id, t0, t1) cover more than ``threshold`` of a bracket away from the ends."""
    named = brackets.select("rec_id", "id", F.col("lo").alias("start_f"), F.col("hi").alias("end_f")).where("end_f > start_f")
    pairs = overlapping(named, marks.select("rec_id", F.col("t0").alias("start_f"), F.col("t1").alias("end_f")).where("end_f > start_f"), width)
    summed = pairs.groupBy("rec_id", "id").agg(F.sum(F.least("e", "end_f") - F.greatest("s", "start_f")).alias("covered"))
    rows = brackets.join(summed, ["rec_id", "id"], "left").join(ends, "rec_id").withColumn("covered", F.coalesce("covered", F.lit(0)))
    free = (F.col("hi") <= F.col("lo")) | (F.col("lo") <= edge) | (F.col("hi") >= F.col("finish") - edge)
    return rows.withColumn("dropped", ~free & (F.col("covered") > (F.col("hi") - F.col("lo")) * threshold))


def without_overlap(brackets: DataFrame, others: DataFrame, share: float = 0.0, width: int = 64) -> DataFrame:
    """Brackets that no row of ``others`` (rec_id, c, d) overlaps by more than ``share`` of the bracket."""
    named = brackets.select("rec_id", "id", F.col("lo").alias("start_f"), F.col("hi").alias("end_f")).where("end_f > start_f")
    pairs = overlapping(named, others.select("rec_id", F.col("c").alias("start_f"), F.col("d").alias("end_f")).where("end_f > start_f"), width)
    common = F.least("e", "end_f") - F.greatest("s", "start_f")
    hit = pairs.where((common > 0) & (common > (F.col("end_f") - F.col("start_f")) * share)).select("rec_id", "id").distinct()
    return brackets.join(hit, ["rec_id", "id"], "left_anti")


def sweep_tail(breaks: DataFrame, brackets: DataFrame, ends: DataFrame, tail: int, near: int) -> DataFrame:
    """Where the last break stops well short of the end, the first bracket that reaches the end decides.

    If it begins within ``near`` of the start of a break, that break runs to the duration and those behind it go.
    ``brackets`` has rec_id, order, lo, hi.
    """
    last = breaks.groupBy("rec_id").agg(F.max("b").alias("last"))
    short = ends.join(last, "rec_id").where(F.col("duration") - F.col("last") > tail)
    reach = brackets.join(short, "rec_id").where(F.col("hi") >= F.col("duration") - tail)
    met = reach.join(breaks.select("rec_id", F.col("a").alias("start")), "rec_id").where(F.abs(F.col("lo") - F.col("start")) <= near)
    pick = met.groupBy("rec_id").agg(F.min(F.struct("order", "start")).alias("x"), F.max("duration").alias("duration")).select("rec_id", F.col("x.start").alias("start"), "duration")
    joined = breaks.join(pick, "rec_id", "left").where("start IS NULL OR a <= start")
    return joined.select("rec_id", "a", F.when(F.col("a") == F.col("start"), F.col("duration")).otherwise(F.col("b")).alias("b"))


def matched(truth: DataFrame, found: DataFrame) -> DataFrame:
    """rec_id, a, b, c, d: each true break, in order, with the found one that overlaps it most (over half of it) and is still free.

    Of equals the first.  Without one, c and d are -1.  What is free depends on the matches before, but only among breaks that
    overlaps connect: each such stretch of a recording is walked by itself.
    """
    rows = truth.select("rec_id", "a", "b", F.lit(1).alias("kind")).unionByName(found.select("rec_id", "a", "b", F.lit(0).alias("kind")))
    rows = islands(rows, ["rec_id"], ["a", "b", "kind"], lambda far: F.col("a") >= far, "b").select("rec_id", "island", "kind", "a", "b")

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        free: list[tuple[int, int]] = []
        longest = 0
        for kind, a, b in part:
            if not kind:
                free.append((a, b))
                longest = max(longest, b - a)
                continue
            best, most = None, 0.5 * (b - a)
            # the found ones come in order: those that can meet this one begin between a - longest and b
            for at in range(bisect_left(free, (a - longest,)), len(free)):
                c, d = free[at]
                if c >= b:
                    break
                common = min(b, d) - max(a, c)
                if common > most:
                    best, most = at, common
            yield (key[0], a, b, *(free.pop(best) if best is not None else (-1, -1)))

    return by_group(rows, ["rec_id", "island"], ["kind", "a", "b"], walk, "rec_id long, a long, b long, c long, d long")


def countable(found: DataFrame, padding: DataFrame, slack: int, width: int = 64) -> DataFrame:
    """Found breaks (rec_id, a, b) but for those inside padding (rec_id, a, b), or out of it by ``slack`` at most: they count neither as right nor as wrong."""
    named = found.select("rec_id", F.xxhash64("a", "b").alias("id"), "a", "b", F.col("a").alias("start_f"), F.col("b").alias("end_f")).where("end_f >= start_f")
    wide = padding.select("rec_id", (F.col("a") - slack).alias("start_f"), (F.col("b") + slack).alias("end_f"))
    inside = overlapping(named, wide, width).where("s <= a AND b <= e").select("rec_id", "id").distinct()
    return found.withColumn("id", F.xxhash64("a", "b")).join(inside, ["rec_id", "id"], "left_anti").drop("id")


def score_summary(pairs: DataFrame, found: DataFrame, near: int) -> DataFrame:
    """rec_id, true_breaks, found, false_breaks, near_edges, error: sums over the matches of a recording."""
    hit = F.col("c") >= 0
    off = lambda x, y: F.abs(F.col(x) - F.col(y))
    per = pairs.groupBy("rec_id").agg(
        F.count("*").alias("true_breaks"), F.count(F.when(hit, 1)).alias("found"),
        F.sum(F.when(hit, (off("a", "c") <= near).cast("long") + (off("b", "d") <= near).cast("long")).otherwise(0)).alias("near_edges"),
        F.sum(F.when(hit, off("a", "c") + off("b", "d")).otherwise(0)).alias("error"),
    )
    total = found.groupBy("rec_id").agg(F.count("*").alias("n"))
    return per.join(total, "rec_id", "left").select("rec_id", "true_breaks", "found", (F.coalesce("n", F.lit(0)) - F.col("found")).alias("false_breaks"), "near_edges", "error")


def padding_edges(padding: DataFrame, found: DataFrame, ends: DataFrame, slack: int, width: int = 64) -> DataFrame:
    """rec_id, a, b, side, missed, error, unswept: how well the padding at a recording's ends (rec_id, a, b) was found.

    Only its inner edge counts: the latest end of the found breaks that overlap a head, the earliest start of those at a tail,
    less the true one.  ``missed`` where none overlaps; ``unswept`` is what of the found stretch no break covers, if that is
    more than ``slack``.  Padding that is all of the recording (``ends``: rec_id, duration) is left out.
    """
    head, tail = F.col("a") <= slack, F.col("b") >= F.col("duration") - slack
    rows = padding.join(ends.select("rec_id", "duration"), "rec_id").where(~(head & tail) & (head | tail)).withColumn("side", F.when(head, "head").otherwise("tail"))
    named = rows.select("rec_id", "a", "b", "side", F.col("a").alias("start_f"), F.col("b").alias("end_f"))
    over = overlapping(named, found.select("rec_id", F.col("a").alias("start_f"), F.col("b").alias("end_f")).where("end_f > start_f"), width).where(F.least("e", "b") > F.greatest("s", "a"))
    edge = over.groupBy("rec_id", "a", "b", "side").agg(F.max("e").alias("furthest"), F.min("s").alias("nearest"), F.collect_list(F.struct("s", "e")).alias("over"))
    edge = edge.withColumns({"lo": F.when(F.col("side") == "head", F.col("a")).otherwise(F.greatest("a", "nearest")), "hi": F.when(F.col("side") == "head", F.least("b", "furthest")).otherwise(F.col("b"))})
    covered = F.aggregate("over", F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.lit(0), F.least(x["e"], F.col("hi")) - F.greatest(x["s"], F.col("lo"))))
    left = F.greatest(F.lit(0), F.col("hi") - F.col("lo")) - covered
    error = F.when(F.col("side") == "head", F.col("furthest") - F.col("b")).otherwise(F.col("nearest") - F.col("a"))
    told = edge.select("rec_id", "a", "b", "side", error.alias("error"), F.when(left > slack, left).otherwise(0).alias("unswept"))
    out = rows.select("rec_id", "a", "b", "side").join(told, ["rec_id", "a", "b", "side"], "left")
    return out.select("rec_id", "a", "b", "side", F.col("error").isNull().alias("missed"), F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("unswept", F.lit(0)).alias("unswept"))
