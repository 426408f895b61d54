"""Embedding near-dedup by p-stable hashing: quantised random projections in several tables, then exact cosines.

What is shuffled by bucket is a sketch of 128 signs of further projections; vectors follow for those alone that have another
one with a near sketch in their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import discard, small_enough, written
from .textbits import mix

#: Quantisation width of a projection of unit vectors.
WIDTH = 2.0
#: Expected recall of pairs just at the threshold; closer pairs are found almost surely.
RECALL = 0.97
#: Unrelated vectors that a bucket holds, about.  Sketches are cheap to compare, and larger buckets take fewer tables.
MEMBERS = 128
#: Words of 64 signs of a sketch.
SKETCH_WORDS = 2
#: Signs of two vectors at the wanted cosine differ in a binomial number of places; a pair that differs in more than this many
#: standard deviations above the mean isn't compared (about one in 200,000 of the pairs just at the threshold).
SURE = 4.75
#: Members of a bucket that are compared at once; larger ones are compared as pairs of blocks.
BLOCK = 1024
#: One vector in so many tells which buckets are large.  That only decides how a bucket is dealt over tasks.
SAMPLED = 64
_SHIFTS = 24


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance share a quantised Gaussian projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for ``n`` vectors: ``MEMBERS`` unrelated vectors, at right angles, share a bucket."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n / MEMBERS, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def most_apart(cosine: float) -> int:
    """Signs in which the sketches of a pair at the threshold may differ."""
    n, p = 64 * SKETCH_WORDS, math.acos(min(1.0, cosine)) / math.pi
    return math.floor(n * p + SURE * math.sqrt(n * p * (1 - p)))


def _buckets(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket keys, a column for each table."""
    dim = unit.shape[1]
    made = np.random.default_rng(dim)
    lines, shift = made.standard_normal((dim, tables * k)), made.uniform(0, WIDTH, tables * k)
    cell = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(tables, dtype=np.uint64)[None, :] + np.uint64(dim << 20), len(unit), axis=0)
        for j in range(k):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
    return key.view(np.int64)


def _sketches(unit: np.ndarray) -> np.ndarray:
    lines = np.random.default_rng(unit.shape[1] + (1 << 32)).standard_normal((unit.shape[1], 64 * SKETCH_WORDS))
    return np.packbits(unit @ lines > 0, axis=1).view(np.int64)


def _units(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(blobs: list[bytes]) -> Iterator[np.ndarray]:
    length = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for n in np.unique(length):
        yield np.flatnonzero(length == n)


def _checked(kind: str):
    """vec_id and the vector's bytes; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("embedding"):
                values = v.values if v.is_valid else None
                ok = values is not None and len(values) and not values.null_count
                x = np.asarray(values.to_numpy(zero_copy_only=False), kind) if ok else None
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return run


def _hashed(kind: str, k: int, tables: int):
    """A row for each vector and table: key, table, the vector's key in the first table, rep, sketch."""
    names = ["key", "table", "key0", "rep", *(f"s{w}" for w in range(SKETCH_WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, rep = b.column("vector").to_pylist(), b.column("rep").to_numpy()
            for rows in _by_length(blobs):
                unit = _units([blobs[i] for i in rows], kind)
                keys, sketch = _buckets(unit, k, tables), _sketches(unit)
                for t in range(tables):
                    columns = [keys[:, t], np.full(len(rows), t, np.int32), keys[:, 0], rep[rows], *sketch.T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return run


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes of rows that come sorted by node; each row is looked at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        key = b.column("node").to_numpy()
        if held and held[-1].column("node")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        other = np.flatnonzero(key != key[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stretches(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each node, its size, the end of each row's node)."""
    begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(node)]]))
    return begins, sizes, np.repeat(begins + sizes, sizes)


def _sifted(apart: int):
    """Rows of nodes that have another one with a near sketch, not yet met in the first table."""

    def alive(t: pa.Table) -> np.ndarray:
        node, first, block = t["node"].to_numpy(), t["key0"].to_numpy(), t["block"].to_numpy()
        again, both = t["table"].to_numpy() > 0, t["both"].to_numpy().astype(bool)
        sketch = np.stack([t[f"s{w}"].to_numpy() for w in range(SKETCH_WORDS)], axis=1).view(np.uint64)
        begins, sizes, last = _stretches(node)
        out = np.zeros(len(node), bool)
        small = np.repeat(sizes <= _SHIFTS, sizes)
        fresh = lambda a, b: (~again[a] | (first[a] != first[b])) & (~both[a] | (block[a] != block[b]))
        for s in range(1, _SHIFTS):
            a = np.flatnonzero(small & (np.arange(len(node)) + s < last))
            if not len(a):
                break
            near = (np.bitwise_count(sketch[a] ^ sketch[a + s]).sum(axis=1) <= apart) & fresh(a, a + s)
            out[a[near]] = out[a[near] + s] = True
        for begin, size in zip(begins[sizes > _SHIFTS], sizes[sizes > _SHIFTS], strict=True):
            end = begin + size
            for at in range(begin, end, 256):
                a, b = np.arange(at, min(at + 256, end)), np.arange(at, end)
                differ = np.zeros((len(a), len(b)), np.uint8)
                for w in range(SKETCH_WORDS):
                    differ += np.bitwise_count(sketch[a, w][:, None] ^ sketch[b, w][None, :])
                i, j = np.nonzero(differ <= apart)
                i, j = a[i], b[j]
                ok = (i < j) & fresh(i, j)
                out[i[ok]] = out[j[ok]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "table", "key0", "rep", "block", "both"]
        for t in _whole_nodes(batches):
            for b in t.filter(pa.array(alive(t))).select(names).to_batches():
                yield b

    return run


def _linked(kind: str, cosine: float, k: int, tables: int):
    """For each bucket's vectors, how many rows each is linked with, and the smallest id that the links lead to.

    A pair counts in the first table in which it shares a bucket only; pairs of the first table aren't computed again.
    """

    def pairs(unit: np.ndarray, node: np.ndarray, fresh) -> tuple[np.ndarray, np.ndarray]:
        n, found = len(node), []
        begins, sizes, last = _stretches(node)
        small = np.repeat(sizes <= _SHIFTS, sizes)
        for s in range(1, _SHIFTS):
            a = np.flatnonzero(small & (np.arange(n) + s < last))
            if not len(a):
                break
            a = a[fresh(a, a + s)]
            dot = np.einsum("ij,ij->i", unit[a], unit[a + s])
            found.append((a[dot >= cosine], a[dot >= cosine] + s))
        for begin, size in zip(begins[sizes > _SHIFTS], sizes[sizes > _SHIFTS], strict=True):
            end = begin + size
            for at in range(begin, end, 256):
                a, b = np.arange(at, min(at + 256, end)), np.arange(at, end)
                i, j = np.nonzero(unit[a] @ unit[b].T >= cosine - 1e-9)
                i, j = a[i], b[j]
                i, j = i[i < j], j[i < j]
                ok = fresh(i, j)
                i, j = i[ok], j[ok]
                exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                found.append((i[exact], j[exact]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b

    def links(t: pa.Table) -> pa.RecordBatch:
        rep, weight, blobs, node = t["rep"].to_numpy(), t["size"].to_numpy().astype(float), t["vector"].to_pylist(), t["node"].to_numpy()
        table, first, block, both = t["table"].to_numpy(), t["key0"].to_numpy(), t["block"].to_numpy(), t["both"].to_numpy().astype(bool)
        parts = []
        for rows in _by_length(blobs):
            unit = _units([blobs[i] for i in rows], kind)
            own, key, part, cross = table[rows], first[rows], block[rows], both[rows]
            a, b = pairs(unit, node[rows], lambda i, j, own=own, key=key, part=part, cross=cross: ((own[i] == 0) | (key[i] != key[j])) & (~cross[i] | (part[i] != part[j])))
            if not len(a):
                continue
            met = np.unique(np.concatenate([a, b]))
            bucket = np.zeros((len(rows), tables), np.int64)
            bucket[met] = _buckets(unit[met], k, tables)
            earliest = np.empty(len(a), np.int64)
            for i in range(0, len(a), 1 << 16):
                earliest[i : i + (1 << 16)] = (bucket[a[i : i + (1 << 16)]] == bucket[b[i : i + (1 << 16)]]).argmax(axis=1)
            mine = earliest == own[a]
            if mine.any():
                parts.append((rows[a[mine]], rows[b[mine]]))
        n = len(rep)
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["rep", "n", "lowest"])
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        count = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        lowest = rep.copy()
        while True:
            low = lowest.copy()
            np.minimum.at(low, a, lowest[b])
            np.minimum.at(low, b, lowest[a])
            if (low == lowest).all():
                break
            lowest = low
        got = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(count[got].astype(np.int64)), pa.array(lowest[got])], ["rep", "n", "lowest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_nodes(batches):
            yield links(t)

    return run


def _links(classes: DataFrame, kind: str, n: int, cosine: float, recall: float) -> DataFrame:
    """rep, n, lowest for classes (rep, size, vector): how many rows a class is linked with in a bucket, and where links lead."""
    k, tables = plan(n, cosine, recall)
    schema = "key long, table int, key0 long, rep long, " + ", ".join(f"s{w} long" for w in range(SKETCH_WORDS))
    sketch = [f"s{w}" for w in range(SKETCH_WORDS)]
    places = lambda some: some.select("rep", "vector").mapInArrow(_hashed(kind, k, tables), schema)
    probe = places(classes.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(SAMPLED)) == 0)).groupBy("key").agg((F.count("*") * SAMPLED).alias("members"))
    large = written(probe.where(F.col("members") > BLOCK).select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "large")
    met = places(classes).join(small_enough(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = met.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    node = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    dealt = dealt.select(node.alias("node"), "table", "key0", "rep", "block", (low != high).alias("both"), *sketch)
    sifted = dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_sifted(most_apart(cosine)), "node long, table int, key0 long, rep long, block int, both boolean")
    sifted = written(sifted, "sifted")
    full = sifted.join(classes.hint("shuffle_merge"), "rep").repartition("node").sortWithinPartitions("node")
    links = written(full.mapInArrow(_linked(kind, cosine, k, tables), "rep long, n long, lowest long"), "links")
    discard(sifted, large)
    return links


def near_vectors(rows: DataFrame, cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, embedding; other columns are ignored).

    A vector that is null, empty, zero, or holds a null or a component that isn't finite is linked with nothing, and so is
    one with a null vec_id; vectors of different lengths aren't linked.  Cosines are computed in double precision from the
    values as they are.  Equal vectors form one class, which is hashed once and whose rows are all linked with each other and
    with what the class is linked with; rows that repeat vec_id and vector count once as partners, and a vec_id that comes
    with several vectors is one vector with all their links.  An empty table gives an empty result.
    """
    kind = "f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    values = F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>")
    checked = written(rows.select("vec_id", values.alias("embedding")).mapInArrow(_checked(kind), "vec_id long, vector binary"), "vectors")
    sound = checked.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("vector", "vec_id").agg(F.lit(1).alias("one"))
    classes = written(sound.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    links = _links(classes, kind, classes.count(), cosine, recall)
    reach = components(links.select(F.col("rep").alias("a"), F.col("lowest").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    of_class = classes.join(counted.hint("shuffle_merge"), "rep", "left").join(reach.withColumnRenamed("id", "rep").hint("shuffle_merge"), "rep", "left")
    of_class = written(of_class.select("vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "of_class")
    out = checked.join(of_class.hint("merge"), "vector", "left")
    id_ = F.col("vec_id")
    return out.select(
        id_,
        F.when(id_.isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(id_.isNotNull(), F.coalesce("component", id_)).alias("component_id"),
    ).withColumn("kept", id_.eqNullSafe(F.col("component_id")))
