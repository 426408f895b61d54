"""Variable-capacity best fit: sequences of several permitted lengths, whose choice looks at what is still to be packed."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Cost of a sequence of a length: a fixed part for each sequence, one for each place, and one for each pair of places.
FIXED, PAIRS = 64.0, 1 / 16384


def cost_of(length: int) -> float:
    return FIXED + length + PAIRS * length * length


#: (length, cost): with these costs 1,024 is the cheapest a token when full, but wider ones waste less on long pieces.
CAPACITIES = tuple((c, cost_of(c)) for c in (512, 1024, 2048, 4096))
#: Pieces that are packed together, on average; the number of such shards grows with the input.
SHARD_PIECES = 20_000


class _Open:
    """Open bins by the room left, and by age among equals."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def put(self, room: int, bin_: int) -> None:
        if room <= 0:
            return
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(bin_)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin with room for ``size``."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        own = self.bins[room]
        bin_ = own.pop()
        if not own:
            del self.bins[room], self.rooms[at]
        return room, bin_


class _Waiting:
    """How many pieces of each size are still to be packed; bit ``s`` of ``present`` says whether there are any of size s."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count = Counter(sizes)
        self.present = sum(1 << s for s in self.count)

    def drop(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.present ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that would fill ``room``: the largest piece that fits, again and again."""
        full, limit = 0, room
        while room > 0:
            size = (self.present & ((2 << min(room, limit)) - 1)).bit_length() - 1
            if size <= 0:
                break
            times = min(self.count[size], room // size)
            full += times * size
            room -= times * size
            limit = size - 1
        return full


def _fitted(lengths: Sequence[tuple[int, float]], used: int) -> tuple[int, float]:
    return next(x for x in lengths if x[0] >= used)


def _packed(sizes: Sequence[int], order: Sequence[int], lengths: Sequence[tuple[int, float]]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, tokens of each bin) of one pass over the pieces in order."""
    room_of, waiting, used = _Open(), _Waiting(sizes), []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        found = room_of.take(size)
        waiting.drop(size)
        if found is None:
            best = None
            for length, _ in lengths:
                if length >= size:
                    filled = size + waiting.fill(length - size)
                    rate = _fitted(lengths, filled)[1] / filled, length
                    best = rate if best is None else min(best, rate)
            found = best[1], len(used)
            used.append(0)
        room, bin_ = found
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += size
        room_of.put(room - size, bin_)
    return bins, offsets, used


def pack(sizes: Sequence[int], capacities: Sequence[tuple[int, float]] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece and the length of each bin; sizes are above 0 and no more than the longest length.

    Pieces go in order of falling size, each into the open bin it fits most tightly.  Where none has room, a bin opens of
    the permitted length that costs least a token: for each length the pieces still to come are tried as its filling, the
    largest that fits first, and the cost is that of the least length that would hold the result.  In the end each bin
    shrinks to the least permitted length that holds its contents.  The plan that opens all lengths side by side competes
    with those that open one length alone, and the cheapest is taken, so that the choice is never worse than a single one.
    """
    lengths = sorted(capacities)
    if not sizes:
        return [], [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    largest = sizes[order[0]]
    choices = [lengths, *([x] for x in lengths if x[0] >= largest and len(lengths) > 1)]
    plans = [_packed(sizes, order, some) for some in choices]
    bins, offsets, used = min(plans, key=lambda p: sum(_fitted(lengths, u)[1] for u in p[2]))
    return bins, offsets, [_fitted(lengths, u)[0] for u in used]


def words_of(text: Column) -> Column:
    """Length of a text in words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def best_fit(docs: DataFrame, length: Column | None = None, capacities: Sequence[tuple[int, float]] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs the documents of ``docs`` (doc_id, text; other columns are ignored) into sequences.

    Returns a row for each piece of a document: doc_id, piece, piece_start, piece_length, bin, bin_offset, bin_capacity,
    bin_used.  ``length`` is a document's length in tokens (words by default); one that is longer than the longest permitted
    sequence is cut into pieces of that length and a rest.  A document without tokens (null and empty texts) has one piece
    of length 0, in no bin (null).  Rows that repeat a doc_id are packed each; null ids are packed like others.  Pieces of
    equal size are packed in the order of their rows.  An empty table gives an empty result.

    Every piece has a number of its own, made once and written; shards take turns by its hash, as many as the input asks
    for, so that no value gathers in one.  The numbers follow the way the input is split into tasks: another split gives
    another plan, with the same pieces and as good.  Every shard is packed on its own, with its sizes alone in memory: only its last
    bins stay partly empty.
    """
    capacities = sorted((int(c), float(cost)) for c, cost in capacities)
    longest = capacities[-1][0]
    sized = docs.select("doc_id", (words_of(F.col("text")) if length is None else F.coalesce(length, F.lit(0))).cast("long").alias("tokens"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / longest).cast("int") - 1))))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "piece", start.alias("piece_start"), F.least(F.lit(longest), F.col("tokens") - start).alias("piece_length"), F.monotonically_increasing_id().alias("row"))
    pieces = written(pieces, "pieces")
    shards = max(1, round(pieces.where("piece_length > 0").count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece int, piece_start long, piece_length long, bin string, bin_offset long, bin_capacity int, bin_used long"
    return dealt.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(_pack_shards(capacities), schema)


def _pack_shards(capacities: Sequence[tuple[int, float]]):
    """Packs rows that come sorted by shard, one shard in memory at a time."""

    def packed(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        size = rows["piece_length"].to_pylist()
        full = [i for i, n in enumerate(size) if n > 0]
        bins, offsets, fitted = pack([size[i] for i in full], capacities)
        used = [0] * len(fitted)
        for i, b in zip(full, bins, strict=True):
            used[b] += size[i]
        names, at, capacity, held = ([None] * len(size) for _ in range(4))
        for i, b, o in zip(full, bins, offsets, strict=True):
            names[i], at[i], capacity[i], held[i] = f"{shard}-{b}", o, fitted[b], used[b]
        told = {"bin": pa.array(names, pa.string()), "bin_offset": pa.array(at, pa.int64()), "bin_capacity": pa.array(capacity, pa.int32()), "bin_used": pa.array(held, pa.int64())}
        yield from pa.table({c: rows[c] for c in ("doc_id", "piece", "piece_start", "piece_length")} | told).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            shard = b.column("shard").to_numpy()
            begins = [0, *(i for i in range(1, len(shard)) if shard[i] != shard[i - 1])] if len(shard) else []
            for begin, end in zip(begins, [*begins[1:], len(shard)], strict=True):
                if held and shard[begin] != at:
                    yield from packed(at, held)
                    held = []
                at = int(shard[begin])
                held.append(b.slice(begin, end - begin))
        if held:
            yield from packed(at, held)

    return run
