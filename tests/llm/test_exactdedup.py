import hashlib
import random
import re

from seqspan.llm import exactdedup

WHITE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(own), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i, _ in own]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(docs_of):
    random.seed(1)
    texts = [None, "", " ", "\u00a0", "a b", "ab", "a  b", "a\tb", "é b", "x" * 50_000, "y z"]
    rows = [(i, random.choice(texts)) for i in range(300)] + [(None, "a b"), (None, "only null id")]
    assert got(exactdedup.exact_dedup(docs_of(rows).repartition(7))) == brute(rows)


def test_repeated_rows_and_ties(docs_of):
    rows = [(5, "a b"), (5, "a b"), (3, "ab "), (9, "a b")]
    assert got(exactdedup.exact_dedup(docs_of(rows))) == brute(rows)
    assert {r.doc_id for r in exactdedup.drop_exact_copies(docs_of(rows)).collect()} == {3}


def test_empty_table_and_columns(docs_of):
    none = docs_of([(1, "a")]).limit(0)
    assert exactdedup.exact_dedup(none).collect() == []
    kept = exactdedup.drop_exact_copies(docs_of([(1, "a"), (2, " a")]))
    assert kept.columns == none.columns and [r.doc_id for r in kept.collect()] == [2]


def test_small_windows_give_the_same(docs_of, monkeypatch):
    rows = [(i, f"text {i % 5}" * (i % 3 + 1)) for i in range(60)]
    monkeypatch.setattr(exactdedup, "WINDOW_BYTES", 16)
    assert got(exactdedup.exact_dedup(docs_of(rows))) == brute(rows)


def test_stage_keeps_one_row_of_each_text(docs_of):
    rows = [(1, "same text here"), (5, "same text here"), (5, "a wholly different text"), (7, "dup"), (7, "dup"), (None, "dup"), (None, "alone"), (None, "alone"), (8, None), (9, "  "), (-(1 << 63), "low"), (2, "low")]
    kept = exactdedup.drop_exact_copies(docs_of(rows).repartition(5))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "same text here"), (5, "a wholly different text"), (7, "dup"), (None, "alone"), (9, "  "), (-(1 << 63), "low")], key=str)
    assert exactdedup.drop_exact_copies(docs_of(rows).limit(0)).collect() == []


def test_stage_tells_rows_with_one_id_apart(docs_of, spark):
    rows = docs_of([(3, "a b"), (3, "a\tb"), (3, "a b")], lang="en").unionByName(docs_of([(3, "a b")], lang="de"))
    assert exactdedup.drop_exact_copies(rows).count() == 1
    maps = rows.selectExpr("doc_id", "text", "map('k', lang) AS print_a", "1 AS print_b")
    kept = exactdedup.drop_exact_copies(maps)
    assert kept.columns == maps.columns and kept.count() == 1
