import random
import re

import pytest

from seqspan.llm import linetree


def rows(seed=11):
    random.seed(seed)
    out = []
    for i in range(40):
        lines = [" ".join(f"u{random.randint(0, 10**6)}w" .translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(9)) for _ in range(3)]
        if i % 2 == 0:
            lines.insert(1, f"Visited by user {i} on day {i * 7} of the year")
        if i % 4 == 0:
            lines.append("All rights are reserved by the " + random.choice(["owner", "author"]) + " of it")
        if i % 4 == 1:
            lines.append("short line")
        out.append((i, "\n".join(lines)))
    return out


def test_planted_templates_go_and_the_rest_stays(docs_of):
    docs = rows()
    got = {r.doc_id: r for r in linetree.line_dedup(docs_of(docs), recurrent=10).collect()}
    for i, text in docs:
        want = [x for x in text.split("\n") if not x.startswith(("Visited by", "All rights", "short line"))]
        assert got[i].kept_text == "\n".join(want)
        assert got[i].n_lines - got[i].n_dropped == len(want)


def test_patterns_and_threshold(docs_of):
    _, recurring = linetree.templates(docs_of(rows()), recurrent=10)
    patterns = {r.pattern for r in recurring.collect()}
    assert patterns == {"Visited by user <*> on day <*> of the year", "All rights are reserved by the <*> of it", "short line"}
    assert linetree.templates(docs_of(rows()), recurrent=21)[1].count() == 0


def test_equal_texts_count_once(docs_of):
    same = [(i, "a line with five tokens here\nand one more of these lines") for i in range(30)]
    assert {r.n_dropped for r in linetree.line_dedup(docs_of(same), recurrent=2).collect()} == {0}


def test_odd_rows(docs_of):
    docs = [(1, None), (2, ""), (3, "\n\n"), (None, "x"), (4, "w " * 50_000), (4, "w " * 50_000)] + [(10 + i, f"one two three four five{i}x") for i in range(3)]
    out = linetree.line_dedup(docs_of(docs), recurrent=3).collect()
    told = {r.doc_id: (r.n_lines, r.n_dropped) for r in out}
    assert len(out) == len(docs)
    assert told == {1: (1, 0), 2: (1, 0), 3: (3, 0), None: (1, 0), 4: (1, 0), 10: (1, 1), 11: (1, 1), 12: (1, 1)}
    assert linetree.line_dedup(docs_of(docs).limit(0)).collect() == []


def brute(docs, recurrent, leading=3, agree=0.7):
    """Lines dropped of each document by the template rule alone, over plain dictionaries."""
    lines = {}
    for _, text in docs:
        for raw in (text or "").split("\n"):
            words = tuple("<*>" if re.search(r"\d", t) else t for t in raw.split())
            if re.search(r"[^\W\d_]", raw):
                lines.setdefault(words, set()).add(text)
    leaf = lambda w: (len(w), w[:leading])
    in_leaf, weight = {}, {}
    for w, texts in lines.items():
        in_leaf.setdefault(leaf(w), set()).update(texts)
    lines = {w: texts for w, texts in lines.items() if len(in_leaf[leaf(w)]) >= recurrent}
    for w, texts in lines.items():
        for i, t in enumerate(w[leading:]):
            if t != "<*>":
                weight[leaf(w), i, t] = weight.get((leaf(w), i, t), 0) + len(texts)
    holders, chain_of = {}, {}
    for w, texts in lines.items():
        own = [weight.get((leaf(w), i, t), 0) if t != "<*>" else None for i, t in enumerate(w[leading:])]
        for bound in sorted({recurrent - 1} | {x for x in own if x is not None and x >= recurrent}):
            form = w[:leading] + tuple("<*>" if x is not None and x <= bound else t for x, t in zip(own, w[leading:]))
            made = sum(a != b for a, b in zip(form, w))
            solid = sum(t != "<*>" for t in form)
            if len(w) - made >= agree * len(w) and solid * 2 >= agree * len(w):
                holders.setdefault(form, set()).update(texts)
                chain_of.setdefault(w, []).append(form)
    gone = {w for w, forms in chain_of.items() if any(len(holders[f]) >= recurrent for f in forms)}
    word = lambda raw: tuple("<*>" if re.search(r"\d", t) else t for t in raw.split())
    return {i: [raw for raw in text.split("\n") if word(raw) not in gone] for i, text in docs}


def made_docs(seed):
    random.seed(seed)
    word = lambda n: "".join(random.choice("abcdefg") for _ in range(n))
    shapes = [["posted", "in", "our", None, "by", 0, "on", "a", 1, "day"], ["posted", "in", "our", "own", "by", 0, "at", "the", 1, "hour"], ["see", "all", "of", 0, "here", "and", "now"]]
    names = [word(3) for _ in range(12)]
    docs = []
    for i in range(90):
        lines = []
        for _ in range(random.randint(0, 4)):
            shape = random.choice(shapes)
            lines.append(" ".join(random.choice(names) if x == 0 else word(5) if x == 1 else str(random.randint(1, 99)) if x is None else x for x in shape))
        lines.append(" ".join(word(6) for _ in range(random.randint(5, 9))))
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("recurrent", [4, 10, 25])
def test_against_brute_force(docs_of, recurrent):
    docs = made_docs(recurrent)
    got = {r.doc_id: r.kept_text for r in linetree.line_dedup(docs_of(docs), recurrent=recurrent).collect()}
    want = {i: "\n".join(x) for i, x in brute(docs, recurrent).items()}
    assert got == want and any(got[i] != text for i, text in docs)


def test_bounds_change_nothing(docs_of, monkeypatch):
    docs = made_docs(5)
    want = sorted(tuple(r) for r in linetree.line_dedup(docs_of(docs), recurrent=8).collect())
    monkeypatch.setattr(linetree, "BROADCAST_IDS", 0)
    assert sorted(tuple(r) for r in linetree.line_dedup(docs_of(docs).repartition(9), recurrent=8).collect()) == want


def test_many_names_in_a_crowded_leaf(docs_of):
    letters = str.maketrans("0123456789", "abcdefghij")
    forum = [f"Posted in our forum by n{i}x yesterday evening".translate(letters) for i in range(3000)]
    other = [f"Posted in our q{i}a q{i}b q{i}c q{i}d q{i}e".translate(letters) for i in range(3000)]
    docs = docs_of(list(enumerate(forum + other)))
    got = {r.doc_id: r.n_dropped for r in linetree.line_dedup(docs, recurrent=10).collect()}
    assert got == {i: int(i < 3000) for i in range(6000)}


def test_passages_and_short_lines_go_through_the_tree(docs_of):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda k, n: " ".join(f"u{k}x{i}w".translate(letters) for i in range(n))
    passage, twice, brief = own("p", 51), own("q", 51), own("r", 50)
    docs = [(i, "\n".join([own(i, 60), *[passage] * (i < 3), *[twice] * (i < 2), *[brief] * (i < 9), *["All rights reserved."] * (i < 10), *["Page one"] * (i < 9), f"Page {i}", "", "}", "* * *", "7 8"])) for i in range(30)]
    kept = lambda gone: {i: "\n".join(x for x in text.split("\n") if not x.startswith(gone)) for i, text in docs}
    pages = tuple(f"Page {k}" for k in range(10))
    got = {r.doc_id: r.kept_text for r in linetree.line_dedup(docs_of(docs)).collect()}
    assert got == kept((passage, "All rights reserved.", *pages))
    got = {r.doc_id: r.kept_text for r in linetree.line_dedup(docs_of(docs), long_recurrent=None).collect()}
    assert got == kept(("All rights reserved.", *pages))


def test_hot_lines_are_joined_apart(docs_of, monkeypatch):
    docs = [(i, f"the same line in all\nline number {i // 12} of twelve") for i in range(120)] + [(200 + i, "something else here") for i in range(3)]
    want = sorted(tuple(r) for r in linetree.line_dedup(docs_of(docs), recurrent=8).collect())
    monkeypatch.setattr(linetree, "BROADCAST_IDS", 0)
    monkeypatch.setattr(linetree, "HOT", 3)
    assert sorted(tuple(r) for r in linetree.line_dedup(docs_of(docs).repartition(9), recurrent=8).collect()) == want
    assert {r[2] for r in want} == {0, 2}
