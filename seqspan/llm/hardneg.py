"""Hard negatives by slots: positives' upper limits cut the scores into disjoint slots, whose best rows answer all windows.

The negatives of a positive lie in a window of scores below it, and the windows of an anchor's positives overlap.  Their upper
limits, in descending order, cut the scores into slots.  The first rows of a window are among the first rows of the slots
from its upper limit down, so that it is enough to keep a few rows a slot: in each block of rows, then over all blocks.  The
slots are merged from the lowest up, and each merge answers the windows that begin at its slot.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import written

#: Rows and anchors of a block at most, and the bytes of its vectors in double precision.
BLOCK_ROWS, BLOCK_ANCHORS = 32_768, 8_192
BLOCK_BYTES = 32 << 20
#: Rows of a block at least, as far as there are cores for more blocks.
LEAST_ROWS = 1_024
#: Anchors whose scores a task holds at a time.
CHUNK = 64
_MOST = (1 << 63) - 1
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x), short vectors filled up with zeros: doubles, or Python's whole numbers where doubles aren't exact."""
    flat = column.combine_chunks()
    size = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    wide = max(int(size.max(initial=0)), 1)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows, places = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    if not len(values) or np.abs(values).max() * scale < 1 << 40:
        out = np.zeros((len(size), wide))
        out[rows, places] = np.floor(scale * values)
    else:
        out = np.zeros((len(size), wide), dtype=object)
        out[rows, places] = [Fraction(x) * scale // 1 for x in values.tolist()]
    return out


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers; those beyond are the nearest such number."""
    wide = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :wide], rows[:, :wide]
    if _most(anchors) * _most(rows) * wide < 1 << 52:  # every partial sum is a whole number that a double holds
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    whole = lambda x: x if x.dtype == object else x.astype(np.int64).astype(object)
    return np.clip(whole(anchors) @ whole(rows).T, -_MOST, _MOST).astype(np.int64)


def _first(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of the greatest scores of each row in descending order, ties by column; those without a score come last."""
    n = scores.shape[1]
    bits = max(1, (n - 1).bit_length())
    usable = scores[scores != _NONE]
    if usable.size and int(np.abs(usable).max()) >= 1 << (62 - bits):
        return np.stack([np.lexsort((-np.maximum(r, -_MOST), r == _NONE))[:most] for r in scores])
    keys = np.where(scores == _NONE, _NONE, scores << bits) + (n - 1 - np.arange(n))
    if n > most:
        keys = np.partition(keys, n - most, axis=1)[:, n - most :]
    keys = np.sort(keys, axis=1)[:, ::-1]
    return n - 1 - (keys & ((1 << bits) - 1))


class _Block:
    """The rows of a block in the order of their ids, null ids last."""

    def __init__(self, rows: pa.Table, scale: int):
        rows = rows.sort_by([("vec_id", "ascending")])  # nulls go last
        self.ids, self.labels = rows.column("vec_id").combine_chunks(), rows.column("label").combine_chunks()
        self.vectors = _matrix(rows.column("embedding"), scale)
        self.known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.plain = self.ids.fill_null(0).to_numpy()


def _positives(most: int, scale: int):
    """In a pair of blocks, the first ``most`` other rows of an anchor's label."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for label in pc.unique(anchors.column("label")):
            own = anchors.filter(pc.equal(anchors.column("label"), label))
            block = _Block(rows.filter(pc.equal(rows.column("label"), label)), scale)
            if not len(block.ids):
                continue
            ids, number, vectors = own.column("vec_id").to_numpy(), own.column("anchor_no").to_numpy(), _matrix(own.column("embedding"), scale)
            for a in range(0, len(ids), CHUNK):
                scores = _scores(vectors[a : a + CHUNK], block.vectors)
                scores[(block.plain == ids[a : a + CHUNK, None]) & block.known] = _NONE
                best = _first(scores, most)
                score = np.take_along_axis(scores, best, axis=1)
                at, k = np.nonzero(score != _NONE)
                out.append((number[a : a + CHUNK][at], score[at, k], block.ids.take(pa.array(best[at, k]))))
        return _table(["anchor_no", "score", "vec_id"], out)

    return find


def _limits(scores: list[int], low: int, high: int) -> tuple[list[int], int]:
    """(different upper limits of the windows in descending order, the least lower limit)."""
    windows = [(high * p // 100, -(-low * p // 100)) for p in scores]
    windows = [w for w in windows if w[0] >= w[1]]
    return sorted({u for u, _ in windows}, reverse=True), min((x for _, x in windows), default=0)


def _negatives(most: int, low: int, high: int, scale: int):
    """In a pair of blocks, the first ``most`` rows of another label in each slot of an anchor."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out, block = [], _Block(rows, scale)
        codes = pa.concat_arrays([block.labels, anchors.column("label").combine_chunks()]).dictionary_encode().indices.to_numpy()
        code, mine = codes[: len(block.ids)], codes[len(block.ids) :]
        number, ids, vectors = anchors.column("anchor_no").to_numpy(), anchors.column("vec_id").to_numpy(), _matrix(anchors.column("embedding"), scale)
        limits = [_limits(x, low, high) for x in anchors.column("scores").to_pylist()]
        for a in range(0, len(number), CHUNK):
            part = limits[a : a + CHUNK]
            upper = np.full((len(part), max(1, max(len(u) for u, _ in part))), _NONE)
            for i, (u, _) in enumerate(part):
                upper[i, : len(u)] = u
            scores = _scores(vectors[a : a + CHUNK], block.vectors)
            fits = (scores <= upper[:, :1]) & (scores >= np.array([x for _, x in part])[:, None]) & (code != mine[a : a + CHUNK, None])
            fits &= (block.plain != ids[a : a + CHUNK, None]) | ~block.known
            at, row = np.nonzero(fits)
            score = scores[at, row]
            slot = (upper[at] >= score[:, None]).sum(axis=1) - 1
            order = np.lexsort((row, -score, slot, at))
            at, row, score, slot = at[order], row[order], score[order], slot[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (slot[1:] != slot[:-1])
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            keep = rank < most
            out.append((number[a : a + CHUNK][at[keep]], slot[keep], score[keep], block.ids.take(pa.array(row[keep]))))
        return _table(["anchor_no", "slot", "score", "vec_id"], out)

    return find


def _table(names: list[str], parts: list[tuple]) -> pa.Table:
    columns = [pa.concat_arrays([pa.array(x, pa.int64()) for x in c]) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(names)
    return pa.table(columns, names=names)


def _met(anchors: DataFrame, rows: DataFrame, parts: tuple[int, int], find, schema: str) -> DataFrame:
    """``find`` for each block of anchors with each block of rows, as a task of its own."""
    n_anchors, n_rows = parts
    # an int, as the other side's exploded number is: Spark deals an equal long to another partition
    block = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int")
    left = anchors.withColumns({"part": block("anchor_no", n_anchors), "other": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))})
    right = rows.withColumns({"other": block("row_no", n_rows), "part": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))})
    keys = ["part", "other"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, schema)


def _first_rows(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key over all blocks; Spark cuts each task's rows to as many before they are dealt."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id (long), embedding (array of numbers) and label; ``anchor`` says which rows are anchors.  A score is
    the inner product of the vectors' components as whole numbers, floor(``scale`` * x).  An anchor's positives are the first
    other rows of its label by score, ties by smaller vec_id.  A positive's negatives are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.  Positives without a negative give no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part.  Other rows are those of another
    vec_id; rows that repeat a vec_id all take part, each anchor row for itself.  A null vec_id is no anchor and comes after
    all others in ties.  Components that a vector lacks count as zero, so an empty vector scores 0.  Scores that 64 bits can't
    hold count as the nearest number that they can.  An empty table gives an empty result; other columns are ignored.
    """
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label"), (anchor & F.col("vec_id").isNotNull()).alias("anchor"))
    usable = usable.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", real))
    usable = written(usable.withColumn("row_no", F.monotonically_increasing_id()), "rows")
    n, n_anchors, wide = usable.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    fit = max(1, BLOCK_BYTES // (8 * max(1, wide)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = (max(1, ceil(n_anchors / min(BLOCK_ANCHORS, fit))), max(1, ceil(n / min(BLOCK_ROWS, fit)), min(2 * cores, ceil(n / LEAST_ROWS))))
    others = usable.select("vec_id", "embedding", "label", "row_no")
    anchors = usable.where("anchor").select("vec_id", "embedding", "label", F.col("row_no").alias("anchor_no"))

    near = _met(anchors, others, parts, _positives(positives, scale), "anchor_no long, score long, vec_id long")
    near = written(_first_rows(near, ["anchor_no"], positives), "positives")
    goals = anchors.join(near.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("near")), "anchor_no")
    goals = written(goals.withColumn("scores", F.col("near.score")), "anchors")

    asked = goals.select("anchor_no", "vec_id", "embedding", "label", "scores")
    slots = _first_rows(_met(asked, others, parts, _negatives(negatives, low, high, scale), "anchor_no long, slot long, score long, vec_id long"), ["anchor_no", "slot"], negatives)
    slots = slots.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "score", "vec_id"))).alias("slots"))
    each = goals.select("anchor_no", F.col("vec_id").alias("anchor_id"), F.explode("near").alias("positive")).join(slots, "anchor_no")
    wide_score = lambda x: x["score"].cast("decimal(20,0)")
    goal = wide_score(F.col("positive"))
    # slots begin at the upper limits and descend: those from a positive's limit on, merged, begin with its window's first rows
    suffix = F.slice(F.filter("slots", lambda x: wide_score(x) * 100 <= goal * high), 1, negatives)
    window = F.filter(suffix, lambda x: wide_score(x) * 100 >= goal * low)
    found = each.select("anchor_id", F.col("positive")["vec_id"].alias("positive_id"), F.col("positive")["score"].alias("positive_score"), F.posexplode(window).alias("at", "x"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x")["vec_id"].alias("negative_id"), "positive_score", F.col("x")["score"].alias("negative_score"))
