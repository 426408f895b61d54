"""Remembered masks: their pixels on a picture, their reading of frames, how they did, and which one is used."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .breaks import disagreements, without_overlap
from .learn import beats
from .runs import runs_of
from .segments import in_spans
from .walks import by_group


def on_picture(masks: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """rec_id, x, y: a mask's points (key, fx, fy; shares of the picture) on each recording's picture (rec_id, key, left, top, w, h).

    Rounded half to even; those outside the frame of ``width`` by ``height`` are left out.
    """
    at = lambda a, n, f: F.bround(F.col(a) + F.col(f) * F.col(n)).cast("long")
    rows = boxes.join(masks, "key").select("rec_id", at("left", "w", "fx").alias("x"), at("top", "h", "fy").alias("y"))
    return rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def readings(frames: DataFrame, masks: DataFrame, width: int, height: int, pad: int = 6, level: int = 18) -> DataFrame:
    """rec_id, i, edges, light: a mask's mean (rec_id, x, y) less that of what is round it, in each frame (rec_id, i, v).

    ``v`` holds a frame of ``width`` by ``height`` levels row by row.  ``edges`` counts places where the level changes by more
    than ``level`` to the right and downwards together, ``light`` compares the levels themselves.  Round it is the mask's box
    widened by ``pad``, without the mask; a mask without points or without surroundings reads nothing.
    """
    across, down = width - 1, height - 1
    places = masks.groupBy("rec_id").agg(F.collect_set((F.col("y") * across + F.col("x")).cast("long")).alias("mask"))
    rows = frames.select("rec_id", "i", "v").join(places, "rec_id")

    def weights(mask: Sequence[int]) -> np.ndarray | None:
        """What each place counts in the difference of the two means; None where one of them is of nothing."""
        inside = np.zeros((down, across), bool)
        inside.reshape(-1)[mask] = True
        ys, xs = np.nonzero(inside)
        ring = np.zeros_like(inside)
        ring[max(0, ys.min() - pad) : ys.max() + pad + 1, max(0, xs.min() - pad) : xs.max() + pad + 1] = True
        ring &= ~inside
        return (inside / inside.sum() - ring / ring.sum()).reshape(-1) if ring.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a recording's mask is laid out once a batch, and read in all its frames by one product
            held: dict[int, tuple[list[int], list[int], list[list[int]]]] = {}
            for rec, i, v, mask in zip(*(b.column(c).to_pylist() for c in ("rec_id", "i", "v", "mask")), strict=True):
                if v is not None and len(v) == width * height:
                    own = held.setdefault(rec, (mask, [], []))
                    own[1].append(i)
                    own[2].append(v)
            out: list[tuple] = []
            for rec, (mask, ids, frames_) in held.items():
                weight = weights(mask)
                if weight is not None:
                    a = np.array(frames_, np.int32).reshape(-1, height, width)
                    edge = np.abs(np.diff(a, axis=2))[:, :-1] + np.abs(np.diff(a, axis=1))[:, :, :-1] > level
                    read = [x.reshape(len(ids), -1) @ weight for x in (edge, a[:, :down, :across])]
                    out += zip([rec] * len(ids), ids, *(x.tolist() for x in read), strict=True)
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["rec_id", "i", "edges", "light"])

    return rows.mapInArrow(run, "rec_id long, i long, edges double, light double")


def scored(track: DataFrame, cuts: DataFrame, ends: DataFrame, on: float, gap: int, mark_len: int, away_gap: int, away_len: int, margin: int, edge: int, fit: float = 0.25, agree: float = 0.5, width: int = 1 << 28) -> DataFrame:
    """rec_id, prog, false, fitted: how a mask's reading (rec_id, i, t, v) agrees with corrected cuts (rec_id, a, b).

    ``prog`` is the share of the programme's samples (not in a cut or within ``margin`` of its ends) inside marks, the runs in
    which it reads the sign; ``false`` how many absences away from the ends it would make breaks of though no cut overlaps
    them; ``fitted`` whether its marks cover enough of the recording (``ends``: rec_id, duration).
    """
    rows = track.select("rec_id", "i", "t", (F.col("v") > on).alias("on"))
    marks = runs_of(rows, F.col("on"), gap, mark_len).select("rec_id", "t0", "t1")
    away = runs_of(rows, ~F.col("on"), away_gap, away_len)
    covered = marks.groupBy("rec_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("covered"))
    fitted = ends.join(covered, "rec_id", "left").select("rec_id", "duration", ((F.col("duration") > 0) & (F.coalesce("covered", F.lit(0)) / F.col("duration") >= fit)).alias("fitted"))
    spans = lambda d, s, e: d.select("rec_id", F.xxhash64(s, e).alias("k"), s.alias("s"), e.alias("e"))
    a, b = F.col("a"), F.col("b")
    inside = in_spans(rows, spans(cuts, a, b), "t", width).select("rec_id", "i")
    near = in_spans(rows, spans(cuts, a - margin, a + margin).unionByName(spans(cuts, b - margin, b + margin)), "t", width, closed=True).select("rec_id", "i")
    programme = rows.join(inside.unionByName(near).distinct(), ["rec_id", "i"], "left_anti")
    seen = in_spans(rows, spans(marks, F.col("t0"), F.col("t1")), "t", width).select("rec_id", "i").distinct().withColumn("seen", F.lit(1.0))
    prog = programme.join(seen, ["rec_id", "i"], "left").groupBy("rec_id").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("prog"))
    named = away.select("rec_id", F.xxhash64("t0", "t1").alias("id"), F.col("t0").alias("lo"), F.col("t1").alias("hi"))
    held = disagreements(named, marks, ends.select("rec_id", F.col("duration").alias("finish")), agree, edge, width).where("NOT dropped")
    held = held.where((F.col("lo") > edge) & (F.col("hi") < F.col("finish") - edge)).select("rec_id", "id", "lo", "hi")
    false = without_overlap(held, cuts.select("rec_id", a.alias("c"), b.alias("d")), 0.0, width).groupBy("rec_id").agg(F.count("*").alias("false"))
    out = fitted.join(prog, "rec_id", "left").join(false, "rec_id", "left")
    return out.select("rec_id", F.round(F.coalesce("prog", F.lit(0.0)), 6).alias("prog"), F.coalesce("false", F.lit(0)).alias("false"), "fitted")


def tiers(masks: DataFrame, records: DataFrame) -> DataFrame:
    """key, model, place, tier, projects: 2 for a mask that fitted any project, 1 for one never tried, 0 for one that fitted none.

    ``masks`` has key, model, place; ``records`` key, model, project, good, false, fit.
    """
    told = records.groupBy("key", "model").agg(F.max(F.coalesce("fit", F.lit(True)).cast("int")).alias("fit"), F.count_distinct("project").alias("projects"))
    tier = F.when(F.col("fit").isNull(), 1).when(F.col("fit") == 1, 2).otherwise(0)
    return masks.join(told, ["key", "model"], "left").select("key", "model", "place", tier.alias("tier"), F.coalesce("projects", F.lit(0)).alias("projects"))


def active(masks: DataFrame, records: DataFrame, most: int = 4) -> DataFrame:
    """key, model, place, used, kept: the mask of each key that is used, and those that are kept if there are more than ``most``.

    ``masks`` has key, model, place, current (the one in use).  In their order, a mask of a higher tier takes the place of
    the one in use, and one of the same tier that beats it on the projects both were tried on.  Of too many the worst go: of
    the lowest tier, with the fewest projects, the latest; never the one in use.  A key's masks are few, and are walked
    together.
    """
    ranked = tiers(masks, records).join(masks.select("key", "model", "current"), ["key", "model"])
    won = beats(records).groupBy("key", F.col("better").alias("model")).agg(F.collect_set("worse").alias("beaten"))
    rows = ranked.join(won, ["key", "model"], "left").select("key", "place", "model", "tier", "projects", "current", "beaten")

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        own = list(part)
        best = next((n for n, r in enumerate(own) if r[4]), 0)
        for n, (_, _, tier, _, _, beaten) in enumerate(own):
            if n != best and (tier > own[best][2] or tier == own[best][2] and own[best][1] in (beaten or ())):
                best = n
        worst = sorted((n for n in range(len(own)) if n != best), key=lambda n: (own[n][2], own[n][3], -n))
        gone = set(worst[: max(0, len(own) - most)])
        for n, r in enumerate(own):
            yield key[0], r[1], r[0], n == best, n not in gone

    return by_group(rows, ["key"], ["place"], walk, "key long, model long, place long, used boolean, kept boolean")


def recorded(records: DataFrame, results: DataFrame, keep: int = 8, masks: DataFrame | None = None) -> DataFrame:
    """key, model, project, good, false, fit, order: results noted with what was known; a project's latest one, the ``keep`` newest projects.

    Results without a project's name aren't kept, nor those of masks that aren't held (``masks``: key, model; where it isn't
    given all are).  A project that is tried again keeps its place.
    """
    from pyspark.sql import Window as W

    new = results.where("project <> ''")
    new = new if masks is None else new.join(masks.select("key", "model").distinct(), ["key", "model"], "left_semi")
    every = records.withColumn("fresh", F.lit(0)).unionByName(new.select(*records.columns).withColumn("fresh", F.lit(1)))
    one = every.groupBy("key", "model", "project").agg(F.max(F.struct("fresh", "order", "good", "false", "fit")).alias("x"), F.min(F.struct("fresh", "order")).alias("first"))
    rank = F.row_number().over(W.partitionBy("key", "model").orderBy(F.desc("first"), "project"))
    out = one.withColumn("rank", rank).where(F.col("rank") <= keep)
    return out.select("key", "model", "project", "x.good", "x.false", "x.fit", F.col("first.order").alias("order"))
