import hashlib
import random
import zlib

from pyspark.sql import functions as F

from seqspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, at long, total int, `a.b` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([sha("".join(n[i : i + 8])) for i in range(0, len(n), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def brute(rows, tampered):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: climb([leaf(r) for r in langs[x]]) for x in order}
    top = climb([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(langs[lang]):
            way = siblings(trees[lang], i) + siblings(top, k)
            h = leaf((*r[:4], lower(r[4]))) if tampered(r[0]) else leaf(r)
            for a, b in way:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), h, h == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "g", 1, 2, 3) for r in rows], SCHEMA).repartition(6)
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = merkle.manifest(docs, seen)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def third(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def test_against_brute_force(spark):
    random.seed(1)
    sizes = {"en": 1500, "de": 513, "fr": 512, "é": 65, None: 64, "": 9, "z": 8, "Zz": 1}
    rows = [(random.randint(-9, 9999), f"s{i % 3}", lang, i, f"Text É {i}" if i % 4 else "lower") for lang, n in sizes.items() for i in range(n)]
    want = brute(rows, third)
    assert run(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}


def test_more_than_two_blocks_of_blocks(spark, monkeypatch):
    for name, value in (("LEVELS", 1), ("BLOCK", 8)):
        monkeypatch.setattr(merkle, name, value)
    rows = [(i, "s", f"l{i % 70}" if i % 3 else "en", None, "A") for i in range(1200)]
    assert run(spark, rows) == brute(rows, third)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (3, "1:a", "en", 1, "B" * 200_000), (3, "1:a", "en", 1, "b"), (3, "1:a", "en", 1, "b"), (4, "-", None, None, "-")]
    assert run(spark, rows) == brute(rows, third)
    assert run(spark, []) == []
    alone = run(spark, [(5, "s", "en", 1, "x")])
    assert alone[0][1] == alone[0][2] == alone[0][3] and alone[0][4] == sha("")


def test_rows_that_are_all_alike(spark):
    rows = [(3, "s", "en", 1, "Same")] * 700 + [(i, "s", "en", 1, "x") for i in range(300)]
    assert run(spark, rows) == brute(rows, third)


def test_without_seen_texts_all_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "Ab") for i in range(30)], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(docs).where("verified").count() == 30
