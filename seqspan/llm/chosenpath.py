"""Near-dedup by a chosen-path set similarity join over word shingles.

Documents are branched recursively by selected minwise tokens: a node of a tree picks a few of the minwise functions by a
hash of its name, and a document goes to one child for each, named by the function and the document's minimum under it.  Small nodes are compared
exhaustively.  In a large node that is tight, every document is compared with some pivots first; those that this connects
carry a common label from there on, and documents of one label need not be compared again.  Independent trees, as many as
the wanted recall takes, repeat this.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .store import discard, row_prints, small_enough, without_ids, without_rows, written
from .textbits import chunks, seeds, shingle_sets, shingles, strings, word_hashes, words

#: Children of a document at each node.
BRANCHES = 2
#: A large node that kept more than this share of its parent's documents is compared in blocks: two children that keep a
#: share s have 2 * s * s of its pairs, so that branching on makes more of them where s is above 0.71.
SHRINKING = 0.7
#: Minwise functions, a power of two.  Each tree's root has its own; each node below picks some by a hash of its name.
FUNCTIONS = 64
#: Trees at most.
TREES = FUNCTIONS // BRANCHES
#: Documents of a node that are compared at once.
SMALL = 512
#: Documents of a node that are compared exhaustively, as pairs of blocks; larger nodes branch on.
MEDIUM = 4096
#: Share of a large node's documents that seem close to its centre, from which on all are compared with pivots.
TIGHT = 0.2
#: Pivots of a tight node.
PIVOTS = 16
#: Pairs of a tight node's documents outside its main cluster with its others that are compared at once, in parts.
OUTSIDE_PAIRS = 3_000_000
PART = 128
#: Shingles of all full sets that a task compares at once (8 bytes each); nodes with more are cut into pairs of blocks.
MOST_SHINGLES = 16_000_000
#: Minima of two documents that agree if their similarity is just the threshold: fewer than this many standard deviations
#: below the expected number, and the pair isn't compared on full sets.
SURE = 4.75


def _missed(s: float) -> float:
    """Probability that a branching process dies out which has ``BRANCHES`` children, each alive with probability ``s``."""
    q = 0.0
    for _ in range(1000):
        q = (1 - s + s * q) ** BRANCHES
    return q


def trees_for(recall: float, threshold: float) -> int:
    """Trees until a pair just at the threshold is missed with probability 1 - recall at most, at any depth.

    Nodes pick their functions from a pool, in which the pair agrees on a binomial number; given that number, the nodes'
    picks are independent, and in one tree the pair is separated for good as a branching process dies out.  A pair that meets
    in a small node can still be lost to :data:`SURE`, about one in a million at the threshold; that isn't counted here.
    """
    n = FUNCTIONS
    odds = [(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k), _missed(k / n)) for k in range(n + 1)]
    return next((t for t in range(1, TREES + 1) if sum(p * q**t for p, q in odds) <= 1 - recall), TREES + 1)


def _features(k: int):
    factors = seeds(FUNCTIONS, 1234)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = strings(b.column("text"))
            size, prints = np.zeros(len(b), np.int64), [b""] * len(b)
            minima = np.zeros((len(b), FUNCTIONS), np.uint32)
            for i, j, part, ends in chunks(raw, at):
                start, end, first = words(part, ends)
                found, before = shingles(word_hashes(part, start, end), first, k)
                full = np.flatnonzero(np.diff(before))
                if len(full):
                    for f in range(FUNCTIONS):
                        with np.errstate(over="ignore"):
                            minima[i + full, f] = np.minimum.reduceat(found * factors[f], before[:-1][full]) >> np.uint64(32)
                for d in range(i, j):
                    own = np.unique(found[before[d - i] : before[d - i + 1]])
                    size[d], prints[d] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            signature = pa.array([m.tobytes() for m in minima], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(prints, pa.binary()), signature], ["doc_id", "n_shingles", "print", "minima"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for _, sets in shingle_sets(b.column("text"), k):
                out += [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(out, pa.binary())], ["rep", "shingles"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _least_agreeing(percent: int) -> int:
    s = percent / 100
    return max(1, math.floor(FUNCTIONS * s - SURE * math.sqrt(FUNCTIONS * s * (1 - s))))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = _shared(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _by_node(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]] | None]:
    """(node, its rows' columns) of rows that come sorted by node; None after each batch."""
    node, held = None, [[] for _ in columns]
    for b in batches:
        for key, *row in zip(b.column("node").to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
            if key != node:
                if len(held[0]) > 1:
                    yield node, held
                node, held = key, [[] for _ in columns]
            for column, value in zip(held, row, strict=True):
                column.append(value)
        yield None
    if len(held[0]) > 1:
        yield node, held
    yield None


def _sift(percent: int):
    """Documents of small nodes that seem linked with another one of another label there, by size and agreeing minima."""
    least = _least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], ...] = ([], [], [], [])
        for group in _by_node(batches, ("rep", "n_shingles", "minima", "label")):
            if group is None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "rep", "block", "n_shingles"])
                out = ([], [], [], [])
                continue
            node, (ids, sizes, blobs, label) = group
            sign, size, tag = np.frombuffer(b"".join(blobs), np.uint32).reshape(len(ids), FUNCTIONS), np.array(sizes), np.array(label)
            alive = np.zeros(len(ids), bool)
            for i in range(len(ids) - 1):
                fits = (tag[i] != tag[i + 1 :]) & (np.minimum(size[i], size[i + 1 :]) * 100 >= np.maximum(size[i], size[i + 1 :]) * percent)
                near = np.flatnonzero(fits)
                near = near[(sign[i + 1 + near] == sign[i]).sum(axis=1) >= least]
                if len(near):
                    alive[i] = True
                    alive[i + 1 + near] = True
            for i in np.flatnonzero(alive):
                for column, value in zip(out, (node, ids[i], label[i], sizes[i]), strict=True):
                    column.append(value)

    return run


def _shared_by_all(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections: products of indicator matrices, a stretch of the shingles at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    often = times[place] > 1
    row, place = row[often], rank[place[often]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((n, n), np.float64)  # a stretch's counts are exact in single precision, their sums need not be
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, (begin, begin + columns))
        held = np.zeros((n, min(columns, int(place[-1]) + 1 - begin)), np.float32)
        held[row[a:b], place[a:b] - begin] = 1
        out += held @ held.T
    return out


def _compare(percent: int):
    """Spanning links between each node's documents of different labels, from their full sets."""

    def links(ids: list[int], blobs: list[bytes], block: list[int]) -> list[tuple[int, int]]:
        n, sets = len(ids), [np.frombuffer(x, np.uint64) for x in blobs]
        first: dict[int, int] = {}
        root = [first.setdefault(x, i) for i, x in enumerate(block)]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if n <= 4:
            pairs = [(i, j) for i in range(n) for j in range(i) if _linked(sets[i], sets[j], percent)]
        else:
            shared, size = _shared_by_all(sets).astype(np.int64), np.array([len(x) for x in sets])
            fits = np.tril((100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0), -1)
            tag = np.array(block)
            pairs = zip(*(x.tolist() for x in np.nonzero(fits & (tag[:, None] != tag[None, :]))), strict=True)
        out = []
        for i, j in pairs:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _by_node(batches, ("rep", "shingles", "block")):
            if group is None:
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                found = []
            else:
                found += links(*group[1])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many minima each document agrees with its node's centre."""
    for b in batches:
        own, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(len(b), FUNCTIONS) for c in ("minima", "centre"))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("rep"), pa.array((own == other).sum(axis=1), pa.int64())], ["node", "rep", "agree"])


def _to_pivots(percent: int):
    """The pivots that each document is linked with, itself if it is one; a part's pivots (kind 0) come before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for b in batches:
            node, rep, linked = [], [], []
            for key, part, kind, id_, blob in zip(*(b.column(c).to_pylist() for c in ("node", "part", "kind", "rep", "shingles")), strict=True):
                if (key, part) != at:
                    at, pivots = (key, part), []
                own = np.frombuffer(blob, np.uint64)
                if kind == 0:
                    pivots.append((id_, own))
                else:
                    node.append(key)
                    rep.append(id_)
                    linked.append([p for p, other in pivots if p == id_ or _linked(own, other, percent)])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(rep, pa.int64()), pa.array(linked, pa.list_(pa.int64()))], ["node", "rep", "linked"])

    return run


def _minimum(f: int):
    """Minimum ``f`` of a row's signature."""
    return F.expr(f"substring(minima, {f * 4 + 1}, 4)")


_ROW = ("node", "rep", "n_shingles", "minima", "label")
#: What a large node's rows hold besides.
_NODE = (*_ROW, "copies", "members", "above")


def _roots(reps: DataFrame, trees: int) -> DataFrame:
    """Each document of ``reps`` (rep, n_shingles, minima, label) at the children of each tree's root."""
    parts = [F.xxhash64(F.lit(f), _minimum(f)) for f in range(trees * BRANCHES)]
    return reps.select(F.explode(F.array(*parts)).alias("node"), *_ROW[1:], F.lit(None).cast("long").alias("above"))


def _children(rows: DataFrame) -> DataFrame:
    """Each document of ``rows`` at the children of its node, whose functions a hash of the node picks; above has its members.

    A node that stands for several equal ones has the children of all; beyond the pool's size they would repeat.
    """
    start, step = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(FUNCTIONS)), F.pmod(F.xxhash64("node", F.lit(2)), F.lit(FUNCTIONS // 2)) * 2 + 1
    some = F.least(F.col("copies") * BRANCHES, F.lit(FUNCTIONS)) - 1
    picks = F.transform(F.sequence(F.lit(0).cast("long"), some), lambda j: (start + j * step) % FUNCTIONS)
    below = rows.select("*", F.explode(picks).alias("pick"))
    child = F.xxhash64("node", "pick", F.expr("substring(minima, cast(pick * 4 + 1 AS int), 4)"))
    return below.select(child.alias("node"), *_ROW[1:], F.col("members").alias("above"))


def _grown(rows: DataFrame, label: str = "label", above: Column | None = None) -> DataFrame:
    """Nodes of two documents or more that aren't of one label, each set of documents once: node, members, copies, above.

    ``copies`` is the number of nodes with this set, which branch on independently, and above the members of their largest
    parent (null at the roots).
    """
    above = F.lit(None).cast("long") if above is None else above
    seen = rows.groupBy("node").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep", label)).alias("x"), F.bit_xor(F.xxhash64("rep", label, F.lit(9))).alias("y"), F.min(label).alias("l"), F.max(label).alias("m"), F.max(above).alias("above"))
    alike = seen.where("members > 1 AND l <> m").groupBy("members", "x", "y").agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.max("above").alias("above"))
    return alike.select("node", "members", "copies", "above")


class _Sets:
    """Full sets of documents, made from their texts again for those that are asked for."""

    def __init__(self, docs: DataFrame, k: int):
        self.texts, self.k = docs.select(F.col("doc_id").alias("rep"), "text"), k

    def of(self, ids: DataFrame) -> DataFrame:
        """rep, shingles for the ids (one column, rep), which are broadcast if they are few enough."""
        wanted = written(ids.distinct(), "wanted")
        return written(self.texts.join(small_enough(wanted), "rep").mapInArrow(_sets(self.k), "rep long, shingles binary"), "sets")


def _within_bounds(rows: DataFrame) -> DataFrame:
    """``rows`` (node, rep, block, n_shingles) with nodes of too many shingles as pairs of blocks, which have half of that each.

    A block has one document at least: two very long ones are compared as they are.
    """
    half = MOST_SHINGLES // 2
    heavy = written(rows.groupBy("node").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > MOST_SHINGLES).select("node"), "heavy")
    if heavy.isEmpty():
        return rows
    # a node has SMALL documents or so
    upto = F.sum("n_shingles").over(W.partitionBy("node").orderBy("rep"))
    split = rows.join(heavy, "node", "left_semi").withColumn("own", F.floor((upto - 1) / half)).withColumn("blocks", F.max("own").over(W.partitionBy("node")) + 1)
    meets = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"), F.lit(11))).select(*rows.columns)
    return rows.join(heavy, "node", "left_anti").select(*rows.columns).unionByName(meets)


def _exhaust(rows: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links within the nodes of ``rows`` (node, rep, block, n_shingles), all of them small, between different blocks."""
    rows = written(_within_bounds(rows).select("node", "rep", "block"), "small")
    full = sets.of(rows.select("rep")).join(small_enough(rows), "rep")
    parts = full.select("node", "rep", "shingles", "block").repartition("node").sortWithinPartitions("node", "rep")
    return written(parts.mapInArrow(_compare(percent), "a long, b long"), "links")


def similar_links(docs: DataFrame, percent: int, k: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, links): the join itself; ids are not repeated.

    The first has doc_id, n_shingles and rep, the smallest doc_id with the same set (itself where the set is empty).
    The second has pairs a, b of such representatives with ``100 * shared >= percent * union`` on their full sets; enough of
    them to connect whatever the trees brought together.
    """
    trees = trees_for(recall, percent / 100)
    if trees > TREES:
        raise ValueError("more trees than there are minwise functions for")
    table = written(docs.select("doc_id", "text").mapInArrow(_features(k), "doc_id long, n_shingles long, print binary, minima binary"), "features")
    alike = table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "print").agg(F.min("doc_id").alias("rep"), F.min("minima").alias("minima"))
    reps = written(alike.withColumn("label", F.xxhash64("rep", F.lit(5))), "representatives")
    sets = _Sets(docs, k)
    links, sifted, large, before = [], [], None, None
    while True:
        level = _roots(reps, trees) if large is None else _children(large)
        rows = written(level.drop("above").join(_grown(level, above=F.col("above")), "node"), "rows")
        discard(before)
        before = rows
        pool = rows.where(F.col("members") <= SMALL).select(*_ROW)
        pool = pool.unionByName(_in_blocks(rows.where((F.col("members") > SMALL) & (F.col("members") <= MEDIUM))))
        large = rows.where(F.col("members") > MEDIUM)
        last = large.isEmpty()
        if not last:
            large, found, more = _settle(large, sets, percent)
            links += found
            pool = pool.unionByName(more) if more is not None else pool
            stuck = F.coalesce(F.col("members") > F.col("above") * SHRINKING, F.lit(False))
            pool = pool.unionByName(_in_blocks(large.where(stuck)))
            large = large.where(~stuck)
        small = pool.repartition("node").sortWithinPartitions("node", "rep")
        sifted.append(written(small.mapInArrow(_sift(percent), "node long, rep long, block long, n_shingles long"), "sifted"))
        if last:
            break
    discard(before)
    small = sifted[0]
    for x in sifted[1:]:
        small = small.unionByName(x)
    small = written(small.join(_grown(small, "block"), "node").select("node", "rep", "block", "n_shingles"), "small")
    discard(*sifted)
    links.append(_exhaust(small, sets, percent))
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    who = table.join(reps.select("n_shingles", "print", "rep").hint("shuffle_merge"), ["n_shingles", "print"], "left")
    return who.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), every


def _settle(large: DataFrame, sets: _Sets, percent: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(documents of large nodes that branch on, links with pivots, small nodes that stand for what is left of tight ones).

    A node's centre has the commonest minimum under each function.  Where many documents seem close to it, all are compared
    with each of some pivots, those nearest to it.  The main cluster is what the pivot with most links, or a pivot linked
    with that one, is linked with; its documents are connected and share a label.  The others are compared with the whole
    node in parts, or branch on along with it if they are most of it or that were too many pairs.
    """
    minima = F.posexplode(F.array(*[_minimum(f) for f in range(FUNCTIONS)])).alias("f", "m")
    common = large.select("node", minima).groupBy("node", "f", "m").agg(F.count("*").alias("n")).groupBy("node", "f").agg(F.max(F.struct("n", "m"))["m"].alias("m"))
    centres = common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("c")).select("node", F.concat(*[F.col("c")[f]["m"] for f in range(FUNCTIONS)]).alias("centre"))
    few = small_enough(written(centres, "centres"), 50_000)
    seen = large.join(few, "node").select("node", "rep", "minima", "centre").mapInArrow(_agreeing, "node long, rep long, agree long")
    seen = written(seen, "seen")
    share = F.avg((F.col("agree") >= _least_agreeing(percent)).cast("double"))
    tight = written(seen.groupBy("node").agg(share.alias("share")).where(F.col("share") >= TIGHT).select("node"), "tight")
    if tight.isEmpty():
        return large.select(*_NODE), [], None
    few = small_enough(tight, 50_000)
    loose, close = large.join(few, "node", "left_anti").select(*_NODE), written(large.join(few, "node", "left_semi"), "close")
    nearest = [F.max(F.when(F.pmod(F.xxhash64("rep", F.lit(8)), F.lit(PIVOTS)) == j, F.struct("agree", "rep"))).alias(f"p{j}") for j in range(PIVOTS)]
    pivots = seen.join(few, "node", "left_semi").groupBy("node").agg(F.count("*").alias("members"), *nearest)
    asked = written(pivots.select("node", "members", F.explode(F.array(*[F.col(f"p{j}.rep") for j in range(PIVOTS)])).alias("rep")).where("rep IS NOT NULL"), "asked")
    parts = F.ceil(F.col("members") / 512).cast("int")
    members = close.select("node", "rep", F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int").alias("part"), F.lit(1).alias("kind"))
    rows = members.unionByName(asked.select("node", "rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind")))
    full = sets.of(close.select("rep")).join(small_enough(written(rows, "asked")), "rep")
    dealt = full.repartition("node", "part").sortWithinPartitions("node", "part", "kind", "rep").select("node", "part", "kind", "rep", "shingles")
    measured = written(dealt.mapInArrow(_to_pivots(percent), "node long, rep long, linked array<bigint>"), "measured")
    by_pivot = measured.select("node", F.explode("linked").alias("pivot")).groupBy("node", "pivot").agg(F.count("*").alias("n"))
    best = by_pivot.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "pivot"))["pivot"].alias("rep"))
    anchors = small_enough(written(measured.join(best, ["node", "rep"]).select("node", F.col("linked").alias("anchors"), F.col("rep").alias("anchor")), "anchors"), 50_000)
    held = measured.join(anchors, "node").withColumn("main", F.arrays_overlap("linked", "anchors"))
    held = written(held.join(asked.select("node", "rep", F.lit(True).alias("pivot")).hint("shuffle_merge"), ["node", "rep"], "left"), "held")
    one = F.when(F.col("main") & F.col("pivot").isNull(), F.slice(F.array_intersect("linked", "anchors"), 1, 1)).otherwise(F.col("linked"))
    linked = held.select(F.col("rep").alias("a"), F.explode(one).alias("b")).where("a <> b")
    outside = held.groupBy("node").agg(F.count(F.when(~F.col("main"), 1)).alias("outside"), F.max("anchor").alias("anchor")).where("outside > 0")
    outside = small_enough(written(outside, "outside"), 50_000)
    left = close.join(held.select("node", "rep", "main").hint("shuffle_merge"), ["node", "rep"]).join(outside, "node")
    left = written(left.withColumn("label", F.when(F.col("main"), F.xxhash64("anchor", F.lit(6))).otherwise(F.col("label"))), "left")
    many = (F.col("outside") * F.col("members") > OUTSIDE_PAIRS) | (F.col("outside") * 2 > F.col("members"))
    on, few = left.where(many).select(*_NODE), left.where(~many)
    parts = F.ceil(F.col("members") / PART).cast("int")
    mine = F.array(F.pmod(F.xxhash64("rep", F.lit(4)), parts).cast("int"))
    spread = few.withColumn("part", F.explode(F.when(F.col("main"), mine).otherwise(F.sequence(F.lit(0), parts - 1))))
    spread = spread.withColumn("node", F.xxhash64("node", "part", F.lit(7))).select(*_ROW)
    return loose.unionByName(on), [linked], spread


def _in_blocks(large: DataFrame) -> DataFrame:
    """Every pair of documents of nodes that stayed large, as pairs of blocks of ``SMALL / 2`` documents or so."""
    blocks = F.ceil(F.col("members") / (SMALL // 2)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.withColumn("node", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))).select(*_ROW)


def _unique_ids(rows: DataFrame) -> bool:
    return rows.where("doc_id IS NULL").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def _numbered(docs: DataFrame) -> DataFrame:
    """key, doc_id, a, b: the distinct rows of ``docs`` by their prints, numbered in the order of doc_id, nulls last."""
    a, b = row_prints(docs)
    rows = docs.select("doc_id", a.alias("a"), b.alias("b")).distinct()
    return written(rows.orderBy(F.asc_nulls_last("doc_id"), "a", "b").withColumn("key", F.monotonically_increasing_id()), "numbered")


def _judged(rows: DataFrame, percent: int, k: int, recall: float) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of rows whose ids aren't repeated or null."""
    who, links = similar_links(rows, percent, k, recall)
    reach = components(links)
    out = who.join(reach.select(F.col("id").alias("rep"), "component").hint("shuffle_merge"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _by_row(docs: DataFrame, percent: int, k: int, recall: float) -> DataFrame:
    """a, b, doc_id, n_shingles, component_id, kept for each distinct row of ``docs``, by its prints."""
    known = _numbered(docs)
    a, b = row_prints(docs)
    texts = docs.select(a.alias("a"), b.alias("b"), "text").groupBy("a", "b").agg(F.first("text").alias("text"))
    keyed = written(texts.join(known.hint("shuffle_merge"), ["a", "b"]).select(F.col("key").alias("doc_id"), "text"), "keyed")
    told = _judged(keyed, percent, k, recall).withColumnsRenamed({"doc_id": "key", "component_id": "lowest"})
    ids = known.select(F.col("key").alias("lowest"), F.col("doc_id").alias("component_id"))
    # a component's smallest row may be the smallest of very many: Spark splits such a key of the merge join
    out = written(known.join(told.hint("shuffle_merge"), "key"), "told").join(ids.hint("merge"), "lowest")
    return out.select("a", "b", "doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, percent: int = 80, k: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its distinct ``k``-word shingles, or
    its whole sequence where it has fewer words.  A document without words (null and empty texts) has the empty set and
    is linked with nothing.  Very long texts are taken whole.  Where ids are repeated or null, every row counts by its own
    text: rows equal in id and text are one document, whose result each of them gets; of a group's rows with the smallest id
    the one with the least hash stays, and null ids come last (a group of such has a null component).  An empty table gives
    an empty result.
    """
    rows = docs.select("doc_id", "text")
    if _unique_ids(rows):
        return _judged(rows, percent, k, recall)
    told = written(_by_row(rows, percent, k, recall), "told")
    a, b = row_prints(rows)
    return rows.select(a.alias("a"), b.alias("b")).join(told.hint("merge"), ["a", "b"]).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; the columns stay as they are.

    The defaults, five-word shingles and a similarity of 0.8, are those of all stages on word shingles; the query ``op3``
    has its own by its contract.  Rows are judged by their own texts: with repeated or null ids every distinct row is a
    document, null ids come last, and of rows equal in all columns one stays.  Documents without words are linked with
    nothing and stay, except for such equal rows.  An empty table stays empty.
    """
    if _unique_ids(docs.select("doc_id")):
        lost = written(near_dedup(docs, percent, k).where("NOT kept").select("doc_id"), "copies")
        return without_ids(docs, lost, "doc_id")
    told = written(_by_row(docs, percent, k, 0.999).select("a", "b", "kept"), "told")
    a, b = row_prints(docs)
    repeated = docs.select(a.alias("a"), b.alias("b")).groupBy("a", "b").count().where("count > 1").select("a", "b")
    return without_rows(docs, told.where("NOT kept").select("a", "b"), written(repeated, "repeated"))
