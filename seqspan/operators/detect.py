"""Break detection as a whole: what each source proposes, what they may say of each other, and what is chosen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .breaks import BreakRules, choose, density_brackets, disagreements, judged, refine_edges, snap_to_ends, sweep_tail, without_overlap


@dataclass(frozen=True)
class Rules:
    """Bounds of detection, times in the unit of the tables."""

    breaks: BreakRules
    search: int  # how far an edge looks for an event inwards, and outwards
    slack: int
    cost: float  # what a unit of distance takes off an event's score
    strong: float  # events that may bound a break by themselves, and the evidence a unit of time that takes
    density: float
    end_slack: int
    tail: int
    near: int
    bucket: int
    mark_edge: int
    levels: int = 4  # support of brackets that aren't counted by levels
    persistent: float = 0.5
    fit: float = 0.25
    agree: float = 0.6
    self_agree: float = 0.5


def _named(brackets: DataFrame, source: str, support: Column) -> DataFrame:
    return brackets.select("rec_id", F.xxhash64(F.lit(source), "lo", "hi", support).alias("id"), "lo", "hi", support.cast("long").alias("support"))


def _free_of(brackets: DataFrame, others: DataFrame, rules: Rules) -> DataFrame:
    return without_overlap(brackets, others.select("rec_id", F.col("lo").alias("c"), F.col("hi").alias("d")), 0.0, rules.bucket)


def _agreeing(brackets: DataFrame, marks: DataFrame, ends: DataFrame, share: float, rules: Rules) -> DataFrame:
    return disagreements(brackets, marks, ends.select("rec_id", F.col("duration").alias("finish")), share, rules.mark_edge, rules.bucket).where("NOT dropped").select(*brackets.columns)


def fitting_marks(marks: DataFrame, ends: DataFrame, rules: Rules) -> DataFrame:
    """Marks of recordings of which they cover enough; where they cover less, what they stand for isn't that recording's."""
    covered = marks.groupBy("rec_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("covered"))
    fit = covered.join(ends, "rec_id").where((F.col("duration") > 0) & (F.col("covered") / F.col("duration") >= rules.fit)).select("rec_id")
    return marks.join(fit, "rec_id", "left_semi")


def leading_corner(corners: DataFrame, brackets: DataFrame, events: DataFrame, rules: Rules) -> DataFrame:
    """rec_id, corner: the corner that leads: one that is on for long, then one with most evidence at its brackets' edges.

    ``corners`` has rec_id, corner, share (of samples with its sign on), ``brackets`` rec_id, corner, lo, hi.  Of equals the
    first.
    """
    named = brackets.select("rec_id", F.xxhash64("corner", "lo", "hi").alias("id"), "corner", "lo", "hi")
    refined = refine_edges(named, events, rules.search, rules.slack, rules.cost)
    length = F.col("b") - F.col("a")
    told = refined.where((length >= rules.breaks.shortest) & (length <= rules.breaks.longest)).groupBy("rec_id", "corner").agg(F.sum(F.col("sa") + F.col("sb")).alias("evidence"))
    ranked = corners.join(told, ["rec_id", "corner"], "left").withColumn("evidence", F.round(F.coalesce("evidence", F.lit(0.0)), 6))
    tier = F.when(F.col("share") >= rules.persistent, 0).otherwise(1)
    return ranked.groupBy("rec_id").agg(F.min(F.struct(tier.alias("t"), (-F.col("evidence")).alias("e"), "corner"))["corner"].alias("corner"))


def _chosen(pool: DataFrame, events: DataFrame, ends: DataFrame, rules: Rules) -> DataFrame:
    refined = refine_edges(pool, events, rules.search, rules.slack, rules.cost)
    kept = judged(refined, ends.select("rec_id", "finish"), rules.breaks).where("reason = 'kept'")
    picked = choose(kept.select("rec_id", "support", (F.col("sa") + F.col("sb")).alias("evidence"), "a", "b"))
    return snap_to_ends(picked, ends, rules.end_slack)


def detect(events: DataFrame, shape: DataFrame, aspect: DataFrame, anchors: DataFrame, corners: DataFrame, corner_brackets: DataFrame, mask: DataFrame, marks: DataFrame, ends: DataFrame, rules: Rules) -> DataFrame:
    """rec_id, a, b: the breaks of each recording.

    Sources propose brackets (rec_id, lo, hi): the picture's shape, its aspect (asked only where the shape proposes
    nothing), gaps between anchors of the programme, the leading corner's sign (``corner_brackets``: rec_id, corner, lo, hi,
    support) and a remembered mask with its marks (rec_id, t0, t1), if these fit the recording.  Marks are heard only where
    the mask proposes brackets (one that comes and goes has none): the corner's brackets then go where the marks say that
    the sign is there; the mask's own ones count where nothing of the corner or the anchors
    overlaps them and its marks agree, and may be short; the shape's go where anchors explain them.  All compete
    (:func:`breaks.judged`, :func:`breaks.choose`); where nothing is left, pairs of strong events do too.  In the end a tail
    that shape or aspect sees changed is swept to the end.  ``events`` has rec_id, t, score, ``ends`` rec_id, finish, duration.
    Cards and then markers go over the result (:func:`cards.with_cards`, :func:`cards.with_markers`).
    """
    # what several steps read is written once: each is a table of brackets or events, far smaller than the samples
    events, shape, anchors, ends = (written(x, name) for x, name in ((events, "events"), (shape, "shape"), (anchors, "anchors"), (ends, "ends")))
    aspect = written(aspect.join(shape.select("rec_id").distinct(), "rec_id", "left_anti"), "aspect")
    marks = written(fitting_marks(marks, ends, rules), "marks")
    corner_brackets = written(corner_brackets, "corners")
    mask = written(mask.join(marks.select("rec_id").distinct(), "rec_id", "left_semi"), "mask")
    marks = written(marks.join(mask.select("rec_id").distinct(), "rec_id", "left_semi"), "marks")
    every = F.lit(rules.levels)
    lead = leading_corner(corners, corner_brackets, events, rules)
    logo = written(_agreeing(_named(corner_brackets.join(lead, ["rec_id", "corner"]), "corner", F.col("support")), marks, ends, rules.agree, rules), "logo")
    alone = _free_of(_free_of(_named(mask, "mask", every), logo, rules), anchors, rules)
    alone = written(_agreeing(alone, marks, ends, rules.self_agree, rules), "alone")
    pool = logo.unionByName(alone).unionByName(_free_of(_named(shape, "shape", every), anchors, rules))
    pool = pool.unionByName(_named(aspect, "aspect", every)).unionByName(_named(anchors, "anchors", every))
    pool = written(pool, "pool")
    short = alone.select("rec_id", "lo", "hi").distinct().withColumn("sure", F.lit(True))
    sure = pool.join(short, ["rec_id", "lo", "hi"], "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    found = written(_chosen(sure, events, ends, rules), "found")
    b = rules.breaks
    pairs = _named(density_brackets(events, rules.strong, b.shortest, b.longest, rules.density), "pairs", every)
    pairs = written(pairs.join(found.select("rec_id").distinct(), "rec_id", "left_anti"), "pairs")
    again = pool.join(pairs.select("rec_id").distinct(), "rec_id", "left_semi").unionByName(pairs).withColumn("sure", F.lit(False))
    found = written(found.unionByName(_chosen(again, events, ends, rules)), "found")
    order = lambda n: F.struct(F.lit(n).alias("n"), "lo", "hi").alias("order")
    reach = shape.select("rec_id", order(0), "lo", "hi").unionByName(aspect.select("rec_id", order(1), "lo", "hi"))
    return sweep_tail(found, reach, ends.select("rec_id", "duration"), rules.tail, rules.near)
