import itertools
import random
import re

import pytest

from seqspan.llm import chosenpath
from seqspan.llm.components import components


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, percent, k):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, groups, size, words=60):
    random.seed(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(25))
    for g in range(groups):
        base = [f"g{g}w{random.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(random.randint(1, size)):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = f"n{random.randint(0, 10**9)}"
            rows.append((len(rows) * 3, " ".join(own) + (" " + passage if g % 2 else "")))
    return rows


EDGES = [(100_001, None), (100_002, ""), (100_003, " \n "), (100_004, "One two"), (100_005, "one\ttwo"), (100_006, "one"), (None, "one two"), (100_007, "x " * 3000), (100_008, "X " * 2999)]


@pytest.mark.parametrize("percent,k,small,medium,pairs", [(80, 5, 512, 4096, 2_000_000), (85, 3, 6, 4096, 2_000_000), (85, 3, 6, 6, 2_000_000), (85, 3, 6, 6, 20)])
def test_against_brute_force(docs_of, monkeypatch, percent, k, small, medium, pairs):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "MEDIUM", medium)
    monkeypatch.setattr(chosenpath, "SHRINKING", 0.1 if medium == 6 else chosenpath.SHRINKING)
    monkeypatch.setattr(chosenpath, "OUTSIDE_PAIRS", pairs)
    monkeypatch.setattr(chosenpath, "PART", 4 if small < 512 else 128)
    rows = corpus(small + k, 8, 24) + EDGES
    got = chosenpath.near_dedup(docs_of(rows), percent, k, recall=0.9999).collect()
    assert len(got) == len(rows)
    want = brute(rows, percent, k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_ids_and_empty_table(docs_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "z"), (3, "zz y")]
    got = chosenpath.near_dedup(docs_of(rows), 85, 3).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert {r.n_shingles for r in got if r.doc_id == 3} == {1}
    assert chosenpath.near_dedup(docs_of(rows).limit(0), 85, 3).collect() == []


def test_stage_keeps_the_columns(docs_of):
    docs = docs_of([(4, "a b c d e f g"), (2, "a b c d e f g"), (9, None)])
    kept = chosenpath.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_more_trees_for_more_recall():
    assert chosenpath.trees_for(0.9, 0.85) <= chosenpath.trees_for(0.9999, 0.85)


def test_components_of_paths_stars_and_repeats(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    random.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {201: 200}
    assert {k: v for k, v in got.items() if k != v} == want


def test_threshold_pairs_in_deep_loose_nodes(docs_of, monkeypatch):
    """Documents of eight blocks in four variants each: nodes stay large over several levels without being tight."""
    monkeypatch.setattr(chosenpath, "SMALL", 8)
    monkeypatch.setattr(chosenpath, "MEDIUM", 8)
    random.seed(12)
    rows, pairs = [], []
    for g in range(600):
        base = [f"b{b}v{random.randrange(4)}w{w}" for b in range(8) for w in range(12)]
        for _ in range(2):
            rows.append((len(rows), " ".join([*base, *(f"d{len(rows)}w{w}" for w in range(8))])))
        a, b = (shingle_set(t, 1) for _, t in rows[-2:])
        assert 85 <= 100 * len(a & b) / len(a | b) < 86
        pairs.append((2 * g, 2 * g + 1))
    got = {r.doc_id: r.component_id for r in chosenpath.near_dedup(docs_of(rows), 85, 1).collect()}
    assert sum(got[a] != got[b] for a, b in pairs) <= 3
    want = brute(rows, 85, 1)
    assert all(want[i][1] == want[c][1] for i, c in got.items())


def test_stage_keeps_one_row_of_each_group(docs_of):
    base = " ".join(f"w{i}" for i in range(200))
    near, other = base.replace("w7 ", "v7 "), " ".join(f"z{i}" for i in range(90))
    rows = [(4, base), (5, near), (5, other), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, base + " end"), (None, "lone words of a null id here"), (None, None), (9, "")]
    kept = chosenpath.drop_near_copies(docs_of(rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, base), (5, other), (7, rows[3][1]), (None, rows[6][1]), (None, None), (9, "")], key=str)
    out = chosenpath.near_dedup(docs_of(rows)).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == 7
    assert chosenpath.drop_near_copies(docs_of(rows).limit(0)).collect() == []


def test_nodes_with_very_long_documents_are_cut(docs_of, monkeypatch):
    monkeypatch.setattr(chosenpath, "MOST_SHINGLES", 150)
    random.seed(14)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if random.random() > 0.01 else f"x{random.randrange(10**6)}" for w in base)) for i in range(40)]
    rows += [(100 + i, " ".join(f"y{i}z{j}" for j in range(300))) for i in range(3)] + [(200, rows[-1][1] + " more")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_dedup(docs_of(rows), 85, 3).collect()}
    assert got == brute(rows, 85, 3)


def test_documents_just_below_the_threshold_go_to_blocks(docs_of, monkeypatch):
    """A frame that all share keeps a node's documents together: it is compared in blocks, not branched on without end."""
    monkeypatch.setattr(chosenpath, "SMALL", 16)
    monkeypatch.setattr(chosenpath, "MEDIUM", 16)
    random.seed(15)
    frame = [f"f{i}" for i in range(84)]
    rows = [(i, " ".join([*frame, *(f"o{i}w{w}" for w in range(8))])) for i in range(120)] + [(500, " ".join([*frame, *(f"o7w{w}" for w in range(8)), "end"]))]
    calls = []
    monkeypatch.setattr(chosenpath, "_children", lambda rows, f=chosenpath._children: calls.append(1) or f(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_dedup(docs_of(rows), 85, 1).collect()}
    assert got == brute(rows, 85, 1) and got[500][1] == 7
    assert len(calls) <= 3
