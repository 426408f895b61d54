"""Learning from examples: fingerprint distances, sightings, offsets, contrast masks, model records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scans import medians


def mean_l1(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of numbers."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return total / F.size(a)


#: Cards that are compared at once, and fingerprints that meet them in one task, about.
CARDS, PRINTS = 1024, 50_000
#: Cards of a block whose distances rule out others.
PIVOTS = 8
#: Slack for the rounding of sums.
_ROUNDING = 1e-9


class Reach:
    """Cards of one length, of which those in reach of a fingerprint are found by pivots.

    The mean absolute difference is a metric: two prints differ by as much at least as their distances to any third do.  Cards
    are sorted by their distance to the first pivot, so a fingerprint's own distance bounds a stretch of them; the others
    thin that out.  What is left is compared in full.
    """

    def __init__(self, ids: Sequence[int], prints: Sequence[Sequence[float]]):
        self.cards = np.array(prints, float)
        chosen, distance = [], np.full(len(ids), np.inf)
        away: list[np.ndarray] = []
        while len(chosen) < min(PIVOTS, len(ids)):
            # the next pivot is the card that is furthest from all before it
            chosen.append(0 if not chosen else int(distance.argmax()))
            away.append(self._means(self.cards, self.cards[chosen[-1]]))
            distance = np.minimum(distance, away[-1])
        order = np.argsort(away[0], kind="stable")
        self.ids, self.pivots = [ids[k] for k in order], self.cards[chosen]
        self.cards, self.away = self.cards[order], np.stack(away, axis=1)[order]
        self.compared = 0

    @staticmethod
    def _means(rows: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return np.abs(rows - print_).sum(axis=1) / rows.shape[1]

    def near(self, print_: Sequence[float], below: float) -> Iterator[tuple[int, float]]:
        """(id, distance) of the cards whose distance is below a bound."""
        own = np.array(print_, float)
        away = self._means(self.pivots, own)
        room = below + _ROUNDING
        lo, hi = np.searchsorted(self.away[:, 0], away[0] - room), np.searchsorted(self.away[:, 0], away[0] + room, side="right")
        left = lo + np.flatnonzero((np.abs(self.away[lo:hi] - away) <= room).all(axis=1))
        self.compared += len(self.pivots) + len(left)
        if len(left):
            mean = self._means(self.cards[left], own)
            for k in np.flatnonzero(mean < below):
                yield self.ids[left[k]], float(mean[k])


def sightings(fingerprints: DataFrame, cards: DataFrame, below: float) -> DataFrame:
    """id, card, distance of fingerprints (id, fp) whose mean absolute difference from a card (card, card_fp) is below a bound.

    Cards are the stated query set; they are dealt into blocks, and each block meets the fingerprints in parts: a task
    holds one block, of which it compares the cards in reach (:class:`Reach`), and streams its part.  A null fingerprint has
    no distance, nor have two of different lengths.
    """
    blocks, parts = max(1, -(-cards.count() // CARDS)), max(1, -(-fingerprints.count() // PRINTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = cards.select(dealt("card", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), F.col("card").alias("id"), F.col("card_fp").cast("array<double>").alias("fp"))
    asked = fingerprints.select(every(blocks).alias("block"), dealt("id", parts).alias("part"), F.lit(1).alias("kind"), "id", F.col("fp").cast("array<double>").alias("fp"))
    rows = held.unionByName(asked).where("fp IS NOT NULL").repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, table = None, [], None
        for b in batches:
            found: list[tuple] = []
            for block, part, kind, id_, fp in zip(*(b.column(c).to_pylist() for c in ("block", "part", "kind", "id", "fp")), strict=True):
                if (block, part) != at:
                    at, names, table = (block, part), [], None
                if kind == 0:
                    names.append((id_, fp))
                    continue
                if table is None:
                    table = {n: Reach([i for i, x in names if len(x) == n], [x for _, x in names if len(x) == n]) for n in {len(x) for _, x in names if x}}
                if len(fp) in table:
                    found += [(id_, card, mean) for card, mean in table[len(fp)].near(fp, below)]
            a, c, d = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["id", "card", "distance"])

    return rows.mapInArrow(run, "id long, card long, distance double").withColumn("distance", F.round("distance", 6))


def offsets(rows: DataFrame, ranges: bool | None = None) -> DataFrame:
    """key, offset, spread, n: median (interpolated), range and number of values, to three places."""
    middle = medians(rows, ["key"], "value", ranges)
    ends = rows.groupBy(F.col("key").alias("of")).agg(F.bround(F.max("value") - F.min("value"), 3).alias("spread"), F.count("*").alias("n"))
    met = ends.join(middle.drop("n"), F.col("of").eqNullSafe(F.col("key")), "left")
    return met.select(F.col("of").alias("key"), F.bround((F.col("low") + F.col("high")) / 2, 3).alias("offset"), "spread", "n")


def contrast_mask(pixels: DataFrame, threshold: float) -> DataFrame:
    """key, pixel, contrast above ``threshold``: how much likelier an edge is within the programme than outside.

    ``pixels`` has key, pixel, inside, edge.  What the whole picture gains (its median, if above 0) is taken off.
    """
    rate = lambda inside: F.avg(F.when(F.col("inside") == inside, F.col("edge").cast("double")))
    each = pixels.groupBy("key", "pixel").agg((rate(True) - rate(False)).alias("raw")).where("raw IS NOT NULL")
    usual = each.groupBy("key").agg(F.greatest(F.lit(0.0), F.median("raw")).alias("usual"))
    out = each.join(usual, "key").withColumn("contrast", F.round(F.col("raw") - F.col("usual"), 6))
    return out.where(F.col("contrast") >= threshold).select("key", "pixel", "contrast")


def compact(mask: DataFrame, boxes: DataFrame, border: int = 2, least: int = 4, most_span: float = 0.25, least_fill: float = 0.25) -> DataFrame:
    """key, pixels, verdict of masks (key, x, y) in pictures (``boxes``: key, left, top, w, h).

    Columns and rows within ``border`` of the picture's edges are taken off first.  ``few`` where less than ``least`` pixels
    are left, ``wide`` where they span more than ``most_span`` of the picture's width or height, ``sparse`` where they fill
    less than ``least_fill`` of their own box, else ``compact``.
    """
    near = lambda c, a, n: (F.abs(F.col(c) - F.col(a)) <= border) | (F.abs(F.col(c) - (F.col(a) + F.col(n) - 1)) <= border)
    inner = mask.select("key", "x", "y").distinct().join(boxes, "key").withColumn("inside", ~near("x", "left", "w") & ~near("y", "top", "h"))
    only = lambda c: F.when(F.col("inside"), F.col(c))
    box = inner.groupBy("key", "w", "h").agg(F.count(only("x")).alias("pixels"), (F.max(only("x")) - F.min(only("x")) + 1).alias("bw"), (F.max(only("y")) - F.min(only("y")) + 1).alias("bh"))
    wide = (F.col("bw") > F.col("w") * most_span) | (F.col("bh") > F.col("h") * most_span)
    verdict = F.when(F.col("pixels") < least, "few").when(wide, "wide").when(F.col("pixels") < F.col("bw") * F.col("bh") * least_fill, "sparse").otherwise("compact")
    return box.select("key", "pixels", verdict.alias("verdict"))


def correlated(series: DataFrame, least: float) -> DataFrame:
    """key, pixel, seed, r: pixels that correlate at ``least`` with the seed, the pixel with most such partners.

    ``series`` has key, t and v, an array with a value for each pixel.  Each task adds up its rows' products as one matrix a
    key; pixels are a bounded number (a corner of a small picture).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            for (key, n), (m, total, cross) in sums.items():
                square = np.diag(cross)
                out += [(key, i, j, cross[i, j], m, total[i], total[j], square[i], square[j]) for i in range(n) for j in range(n)]
            columns = zip(*out, strict=True) if out else ((),) * 9
            kinds = [pa.int64()] * 3 + [pa.float64(), pa.int64()] + [pa.float64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "pixel", "p2", "xy", "m", "sx", "sy", "xx", "yy"])

        for b in batches:
            rows: dict[tuple, list] = {}
            for key, v in zip(b.column("key").to_pylist(), b.column("v").to_pylist(), strict=True):
                if v and None not in v:
                    rows.setdefault((key, len(v)), []).append(v)
            for k, own in rows.items():
                x = np.array(own, float)
                m, total, cross = sums.get(k, (0, 0.0, 0.0))
                sums[k] = [m + len(x), total + x.sum(axis=0), cross + x.T @ x]
            if len(sums) > 64:
                yield flush()
                sums = {}
        yield flush()

    parts = series.select("key", "v").mapInArrow(run, "key long, pixel long, p2 long, xy double, m long, sx double, sy double, xx double, yy double")
    products = parts.groupBy("key", "pixel", "p2").agg(*[F.sum(c).alias(c) for c in ("xy", "m", "sx", "sy", "xx", "yy")])
    top, bottom = F.col("m") * F.col("xy") - F.col("sx") * F.col("sy"), (F.col("m") * F.col("xx") - F.col("sx") ** 2) * (F.col("m") * F.col("yy") - F.col("sy") ** 2)
    pairs = products.where(bottom > 0).select("key", "pixel", "p2", F.round(top / F.sqrt(bottom), 6).alias("r")).where(F.col("r") >= least)
    degree = pairs.groupBy("key", "pixel").agg(F.count("*").alias("degree"))
    seed = degree.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "pixel"))["pixel"].alias("pixel"))
    return pairs.join(seed, ["key", "pixel"]).select("key", F.col("p2").alias("pixel"), F.col("pixel").alias("seed"), "r")


def beats(records: DataFrame) -> DataFrame:
    """key, better, worse: models of a key of which one does better on the projects both were tried on.

    ``records`` has key, model, project, good, false.  Fewer false ones wins; with as many, a lead of over 0.01 a project.
    """
    other = records.select("key", "project", F.col("model").alias("other"), F.col("good").alias("good2"), F.col("false").alias("false2"))
    shared = records.join(other, ["key", "project"]).where("model <> other")
    total = shared.groupBy("key", "model", "other").agg(F.sum("false").alias("f1"), F.sum("false2").alias("f2"), F.sum("good").alias("g1"), F.sum("good2").alias("g2"), F.count("*").alias("n"))
    wins = (F.col("f1") < F.col("f2")) | ((F.col("f1") == F.col("f2")) & (F.round(F.col("g1") - F.col("g2"), 9) > F.round(F.col("n") * 0.01, 9)))
    return total.where(wins).select("key", F.col("model").alias("better"), F.col("other").alias("worse"), "n")


def newest(records: DataFrame, keys: Sequence[str], keep: int) -> DataFrame:
    """The ``keep`` rows of each key that were added last (order)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("order")))
    return records.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def by_alias(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """id, entry: the first store entry (entry, keys array) with any of the wanted aliases (id, keys array)."""
    have = store.select("entry", F.explode("keys").alias("alias"))
    asked = wanted.select("id", F.explode("keys").alias("alias"))
    return asked.join(have, "alias").groupBy("id").agg(F.min("entry").alias("entry"))


def not_in_store(cards: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``cards`` (card, keys array) of which no alias is in the store."""
    known = cards.select("card", F.explode("keys").alias("alias")).join(store.select(F.explode("keys").alias("alias")).distinct(), "alias", "left_semi").select("card").distinct()
    return cards.join(known, "card", "left_anti").select("card")


def upsert(store: DataFrame, updates: DataFrame) -> DataFrame:
    """key, value, version: updates replace entries of the same key and raise their version; other entries stay."""
    new = updates.select("key", F.col("value").alias("new_value"))
    merged = store.join(new, "key", "full_outer")
    version = F.when(F.col("new_value").isNull(), F.col("version")).otherwise(F.coalesce(F.col("version") + 1, F.lit(1)))
    return merged.select("key", F.coalesce("new_value", "value").alias("value"), version.alias("version"))


def best_lag(pairs: DataFrame, most: int) -> DataFrame:
    """key, lag, score: the shift of y against x (key, t, x, y; whole t) at which their mean-free product sum is largest.

    Of equals the least shift.  Every value meets ``2 * most + 1`` others.
    """
    means = pairs.groupBy("key").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    free = pairs.join(means, "key").select("key", "t", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    shifted = free.select("key", "x", F.col("t"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("t", F.col("t") + F.col("lag"))
    summed = shifted.join(free.select("key", "t", "y"), ["key", "t"]).groupBy("key", "lag").agg(F.round(F.sum(F.col("x") * F.col("y")), 3).alias("score"))
    best = summed.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "lag")).alias("b"))
    return best.select("key", F.col("b.lag").cast("long").alias("lag"), (-F.col("b.s")).alias("score"))


def learned_mask(contrast: DataFrame, threshold: float = 0.35, least: int = 4, small: int = 10, small_mean: float = 0.6) -> DataFrame:
    """key, kind, pixels, mean: the best of a key's trials (key, kind, pixel, contrast): that with the highest mean contrast.

    Pixels above the threshold count; a trial needs ``least`` of them, and one of fewer than ``small`` a mean of
    ``small_mean``.  Of equals the first kind.
    """
    each = contrast.where(F.col("contrast") > threshold).groupBy("key", "kind").agg(F.count("*").alias("pixels"), F.round(F.avg("contrast"), 6).alias("mean"))
    good = each.where((F.col("pixels") >= least) & ((F.col("pixels") >= small) | (F.col("mean") >= small_mean)))
    best = good.groupBy("key").agg(F.min(F.struct((-F.col("mean")).alias("m"), "kind", "pixels", "mean")).alias("x"))
    return best.select("key", "x.kind", "x.pixels", "x.mean")


def sign_clusters(clusters: DataFrame, readings: DataFrame, width: int, least: int = 10, thick: int = 2, longest: int = 10, on: tuple[float, float] = (0.3, 0.97)) -> DataFrame:
    """key, pixels, w, h, share, verdict: whether a cluster of pixels (key, pixel; row by row of ``width``) is a sign in a corner.

    ``readings`` has key, t and the mean of the cluster's pixels (v).  ``small`` with fewer than ``least`` pixels, ``line`` if it
    is thinner than ``thick`` or more than ``longest`` times as long as thick, ``share`` if it isn't on (over a half) in a
    share of the samples within ``on``, else ``sign``.
    """
    x, y = F.col("pixel") % width, F.floor(F.col("pixel") / width)
    box = clusters.groupBy("key").agg(F.count("*").alias("pixels"), (F.max(x) - F.min(x) + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"))
    told = box.join(readings.groupBy("key").agg(F.round(F.avg((F.col("v") > 0.5).cast("double")), 6).alias("share")), "key")
    thin, long = F.least("w", "h"), F.greatest("w", "h")
    verdict = F.when(F.col("pixels") < least, "small").when((thin < thick) | (long > thin * longest), "line").when(~F.col("share").between(*on), "share").otherwise("sign")
    return told.select("key", "pixels", "w", "h", "share", verdict.alias("verdict"))


def migrated(documents: DataFrame) -> DataFrame:
    """store, name, keys, entry: the entries of stores (store, document; JSON), whatever their version.

    Version 2 lists channels, each with its keys; blank keys go, and entries without any.  Older ones are a flat map, whose
    entries have one key each.  What isn't an entry is left out; ``name`` is the first key that is no number of a service.
    """
    fields = F.from_json("document", "map<string,string>")
    listed = F.from_json(F.try_element_at(fields, F.lit("channels")), "array<string>")
    rows = documents.select("store", fields.alias("fields"), listed.alias("listed"), (F.coalesce(F.try_element_at(fields, F.lit("version")), F.lit("")) == "2").alias("new"))
    new = rows.where("new AND listed IS NOT NULL").select("store", F.explode("listed").alias("entry"))
    keys = F.filter(F.from_json(F.get_json_object("entry", "$.keys"), "array<string>"), lambda k: F.trim(k) != "")
    new = new.withColumn("keys", keys).where("size(keys) > 0")
    old = rows.where("NOT (new AND listed IS NOT NULL)").select("store", F.explode("fields").alias("key", "entry")).where("key <> 'version' AND startswith(entry, '{')")
    every = new.select("store", "keys", "entry").unionByName(old.select("store", F.array("key").alias("keys"), "entry"))
    named = F.filter("keys", lambda k: ~k.startswith("sid:"))
    return every.select("store", F.coalesce(F.get(named, F.lit(0)), F.get("keys", F.lit(0))).alias("name"), "keys", "entry")


def filed(store: DataFrame, updates: DataFrame) -> DataFrame:
    """keys, value: a store (entry, keys, value) after values were filed under a key each (order, key, value).

    The first entry that has the key gets the value, the latest of several, and keeps all its keys; a key that no entry has
    makes an entry of its own.
    """
    latest = updates.groupBy("key").agg(F.max(F.struct("order", "value")).alias("x"))
    owner = store.select("entry", F.explode("keys").alias("key")).groupBy("key").agg(F.min("entry").alias("entry"))
    met = latest.join(owner, "key", "left")
    new = met.where("entry IS NULL").select(F.array("key").alias("keys"), F.col("x.value").alias("value"))
    given = met.where("entry IS NOT NULL").groupBy("entry").agg(F.max("x")["value"].alias("given"))
    return store.join(given, "entry", "left").select("keys", F.coalesce("given", "value").alias("value")).unionByName(new)
