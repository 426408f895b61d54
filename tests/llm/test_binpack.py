import random

from seqspan.llm import binpack

CAPS = ((8, 8.4), (16, 16.2), (32, 32.0))


def check(rows, sizes):
    """Every piece once, whole texts covered, bins not overfull, pieces not overlapping, each bin as short as may be."""
    spans, bins = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.piece_start, r.piece_length))
        if r.bin is None:
            assert r.piece_length == 0
        else:
            bins.setdefault(r.bin, []).append(r)
    for doc, n in sizes.items():
        at = 0
        for start, length in sorted(spans[doc]):
            assert start == at
            at += length
        assert at == n
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.piece_length
        fitted = min(c for c, _ in CAPS if c >= at)
        assert {(r.bin_used, r.bin_capacity) for r in own} == {(at, fitted)}
    return bins


def test_every_piece_is_packed(docs_of):
    random.seed(12)
    sizes = {i: random.choice([0, 1, 3, 7, 8, 9, 15, 33, 70, 200]) for i in range(400)}
    docs = docs_of([(i, " ".join(["w"] * n)) for i, n in sizes.items()])
    for shard in (10_000, 50):
        bins = check(binpack.best_fit(docs, capacities=CAPS, shard_pieces=shard).collect(), sizes)
        used, room = sum(sizes.values()), sum(own[0].bin_capacity for own in bins.values())
        assert used / room > 0.95


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fitted = binpack.pack([5, 3, 2, 6], [(8, 8.0)])
    assert bins[3] == bins[2] and bins[0] == bins[1] and fitted == [8, 8] and offsets == [0, 5, 6, 0]


def cost(bins, fitted, capacities):
    price = dict(capacities)
    return sum(price[c] for c in fitted)


def plain(sizes, capacities):
    """The same rules with no index: every choice by a look at everything."""

    def one(lengths):
        left, bins, of = sorted(sizes, reverse=True), [], []
        for n, size in enumerate(left):
            fits = [b for b in bins if b["room"] >= size]
            if not fits:
                def rate(c):
                    full = size
                    for other in left[n + 1 :]:
                        full += other if full + other <= c else 0
                    return min(x for x in lengths if x[0] >= full)[1] / full, c
                c = min(rate(c) for c, _ in lengths if c >= size)[1]
                fits = [{"room": c, "used": 0}]
                bins.append(fits[0])
            low = min(b["room"] for b in fits)
            best = [b for b in fits if b["room"] == low][-1]
            best["room"] -= size
            best["used"] += size
        return sum(min(x for x in lengths if x[0] >= b["used"])[1] for b in bins), [min(x for x in capacities if x[0] >= b["used"])[1] for b in bins]

    choices = [sorted(capacities), *([x] for x in sorted(capacities) if x[0] >= max(sizes))]
    return min((sum(one(c)[1]) for c in choices))


def least(sizes, capacities):
    """The least cost of any packing, by trying all."""
    price = lambda used: min(x for x in capacities if x[0] >= used)[1]
    longest = max(c for c, _ in capacities)

    def best(left, bins):
        if not left:
            return sum(price(b) for b in bins)
        head, rest = left[0], left[1:]
        tried = [best(rest, [*bins, head])]
        for i in range(len(bins)):
            if bins[i] + head <= longest:
                tried.append(best(rest, [*bins[:i], bins[i] + head, *bins[i + 1 :]]))
        return min(tried)

    return best(list(sizes), [])


BENT = ((8, 10.0), (16, 18.0), (32, 44.0))


def test_against_brute_force_and_the_optimum():
    random.seed(5)
    for _ in range(60):
        sizes = [random.choice([1, 2, 3, 5, 8, 9, 13, 16, 20, 31]) for _ in range(random.randint(1, 7))]
        bins, _, fitted = binpack.pack(sizes, BENT)
        got = cost(bins, fitted, BENT)
        assert abs(got - plain(sizes, BENT)) < 1e-9
        assert least(sizes, BENT) - 1e-9 <= got <= 1.35 * least(sizes, BENT)


def test_lengths_compete_and_beat_every_single_one():
    random.seed(6)
    sizes = [random.choice([40, 90, 300, 480, 505, 700, 900, 1500, 2000, 3900]) for _ in range(3000)]
    bins, _, fitted = binpack.pack(sizes)
    opened = {c: fitted.count(c) for c in set(fitted)}
    assert len([c for c, n in opened.items() if n > 20]) >= 3
    _, _, alone = binpack.pack(sizes, binpack.CAPACITIES[-1:])
    assert cost(bins, fitted, binpack.CAPACITIES) < 0.99 * sum(binpack.CAPACITIES[-1][1] for _ in alone)
    small = [random.choice([330, 400, 505]) for _ in range(3000)]
    got = binpack.pack(small)
    for single in binpack.CAPACITIES:
        other = binpack.pack(small, [single])
        assert cost(got[0], got[2], binpack.CAPACITIES) < len(other[2]) * single[1]


def test_sizes_are_chosen_by_cost_and_cut_down():
    assert binpack.pack([4], [(8, 8.4), (32, 32.0)])[2] == [8]
    assert binpack.pack([20, 12], [(8, 8.4), (32, 32.0)])[2] == [32]
    assert binpack.pack([20], [(8, 1.0), (24, 40.0), (32, 30.0)])[2] == [24]
    assert binpack.pack([], CAPS) == ([], [], [])


def test_null_and_repeated_ids_are_spread(spark):
    docs = spark.range(60_000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text").unionByName(spark.range(100).selectExpr("id AS doc_id", "'a b' AS text"))
    out = binpack.best_fit(docs, capacities=CAPS, shard_pieces=20_000)
    counts = [r["count"] for r in out.where("doc_id IS NULL").selectExpr("split(bin, '-')[0] AS shard").groupBy("shard").count().collect()]
    assert len(counts) == 3 and max(counts) < 22_000


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b c"), (3, "a b c"), (4, "w " * 100_000)]
    out = binpack.best_fit(docs_of(rows), capacities=CAPS).collect()
    assert len([r for r in out if r.doc_id == 4]) == 3125
    assert sorted((r.doc_id, r.piece_length) for r in out if r.doc_id in (1, 2)) == [(1, 0), (2, 0)]
    assert len([r for r in out if r.doc_id == 3]) == 2 and len([r for r in out if r.doc_id is None]) == 1
    assert binpack.best_fit(docs_of(rows).limit(0)).collect() == []
