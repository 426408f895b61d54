import random

import pytest

from seqspan.operators import library


def listed(name, pattern, anywhere):
    text = pattern.strip(" ")
    star = text.startswith("*")
    piece = (text[1:].strip(" ") if star else text).lower()
    if not piece or text.startswith("#"):
        return False
    last = name.rsplit("/", 1)[-1].lower()
    return piece in last if star or anywhere else last.startswith(piece)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(3)
    word = lambda n: "".join(random.choice("abAB -é") for _ in range(n))
    names = [(i, f"/tv/{word(4)}/{word(random.randint(0, 9))}") for i in range(300)] + [(900, None), (901, "")]
    patterns = sorted({random.choice(["", "*", " *  ", "#", "  "]) + word(random.randint(0, 4)) for _ in range(80)})
    return names, patterns, spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(p,) for p in patterns] * 2, "pattern string")


@pytest.mark.parametrize("anywhere", [False, True])
@pytest.mark.parametrize("most", [50_000, 7])
def test_ignored_against_plain_code(tables, monkeypatch, anywhere, most):
    monkeypatch.setattr(library, "PATTERNS", most)
    monkeypatch.setattr(library, "NAMES", 100)
    names, patterns, files, listed_ = tables
    got = sorted((r.id, r.pattern) for r in library.ignored(files, listed_, anywhere).collect())
    assert got == sorted((i, p) for i, n in names for p in patterns if n is not None and listed(n, p, anywhere))


@pytest.mark.parametrize("most", [50_000, 3])
def test_longest_setting_against_plain_code(spark, tables, monkeypatch, most):
    monkeypatch.setattr(library, "PATTERNS", most)
    names, _, files, _ = tables
    settings = [("a", 5), ("AB", 3), ("bA", 2), ("b-", 9), ("", 0), ("a", 1), ("zz", 4), (" é", 8)]
    got = {r.id: r.setting for r in library.longest_name_held(files, spark.createDataFrame(settings, "setting string, order long"), "none").collect()}
    for i, n in names:
        held = [(-len(s), o, s) for s, o in settings if s and n and s.lower() in n.lower()]
        assert got[i] == (min(held)[2] if held else "none")


def test_no_patterns(spark, tables):
    none = spark.createDataFrame([], "pattern string")
    assert library.ignored(tables[2], none).collect() == []
