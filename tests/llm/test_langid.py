import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqspan.llm import langid, store

SOUNDS = {"en": ["the", "ing", "th", "ou", "ea"], "de": ["der", "ung", "sch", "ü", "ei"], "fr": ["les", "eau", "é", "oi", "ç"], "es": ["los", "ción", "ñ", "ar", "ado"], "xx": ["qq", "zz", "kx", "vw", "qx"]}


def text(lang, n):
    return " ".join("".join(random.choice(SOUNDS[lang]) for _ in range(random.randint(1, 3))) for _ in range(n))


def labelled(spark, per=60):
    random.seed(6)
    rows = [(i, text(lang, random.randint(5, 60)), lang) for i, lang in enumerate(x for x in SOUNDS for _ in range(per))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_split(spark):
    docs = labelled(spark)
    out = langid.identify(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    row = langid.held_out_accuracy(out, docs).first()
    assert row.n > 40 and row.accuracy > 0.95
    assert out.where("held_out").count() == docs.where("crc32(cast(doc_id AS string)) % 4 = 2").count()
    assert out.where("score < 0 OR score > 1").count() == 0


def test_labels_and_ids_are_no_inputs(spark):
    docs = labelled(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    swapped = docs.select("doc_id", "text", F.lit("none").alias("lang"), F.lit(1.5).alias("score"), F.lit("k").alias("lang_pred"))
    two = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(swapped, model).collect()}
    assert one == two


def test_undetermined_texts(spark):
    docs = labelled(spark)
    odd = spark.createDataFrame([(9001, None, None), (9002, "", "en"), (9003, " 12 !!\n", None), (None, "der ungsch", None), (9004, "the thing " * 20_000, None), (9004, "the thing " * 20_000, None)], docs.schema)
    out = langid.identify(docs.unionByName(odd)).where("doc_id IS NULL OR doc_id >= 9000").collect()
    told = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == 6 and told == {9001: "und", 9002: "und", 9003: "und", None: "de", 9004: "en"}
    assert not [r for r in out if r.doc_id is None][0].held_out
    kept = langid.drop_undetermined(docs.unionByName(odd))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 3


def test_nothing_learned(spark):
    none = labelled(spark).limit(0)
    assert langid.identify(none).collect() == []
    one = spark.createDataFrame([(1, "abc", "en"), (2, "def", None)], none.schema)
    assert {r.lang_pred for r in langid.identify(one).collect()} <= {"en", "und"}
    unlabelled = spark.createDataFrame([(1, "abc", None)], none.schema)
    assert [r.lang_pred for r in langid.identify(unlabelled).collect()] == ["und"]


def test_machine_separates_two_clouds():
    made = np.random.default_rng(1)
    x = np.concatenate([made.normal(1, 1, (200, 5)), made.normal(-1, 1, (40, 5))]).astype(np.float32)
    y = np.array([1] * 200 + [-1] * 40)
    w = langid.fit_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.93


def test_score_of_sure_texts_with_many_families():
    names = [f"l{k:02d}" for k in range(15)]
    model = langid.Model(names, {}, {("family", a, b): np.zeros(langid.DIMENSIONS + 1, np.float32) for i, a in enumerate(names) for b in names[i + 1 :]})
    margin = np.log(0.95 / 0.05) / 2
    margins = np.array([[margin if plus == "l03" else -margin if minus == "l03" else 0.1 for plus, minus in model.pairs["family"]]])
    best, sure = model._pick("family", names, margins)
    assert names[best[0]] == "l03" and abs(sure[0] - 0.95) < 1e-9


def test_repeated_texts_count_once(spark, monkeypatch):
    docs = labelled(spark)
    many = spark.range(100_000).selectExpr("cast(id + 10000 AS long) AS doc_id", "'der ung sch ei derung' AS text", "'de' AS lang")
    out = langid.identify(docs.unionByName(many), per_language=40)
    assert langid.held_out_accuracy(out, docs).first().accuracy > 0.9
    tables = []
    monkeypatch.setattr(langid, "written", lambda df, name: tables.append(store.written(df, name)) or tables[-1])
    langid.train(docs.unionByName(many), per_language=40)
    assert max(r["count"] for r in tables[0].groupBy("lang").count().collect()) <= 40


def test_thirteen_languages(spark):
    random.seed(8)
    names = [f"l{c}" for c in "abcdefghijklm"]
    syllables = {x: ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for x in names}
    rows = [(i, " ".join(random.choice(syllables[x]) for _ in range(25)), x) for i, x in enumerate(names * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs)
    assert langid.held_out_accuracy(out, docs).first().accuracy > 0.97
    assert out.where("score < 0.8").count() < 10
    assert langid.drop_undetermined(docs).count() == len(rows)


def test_stage_takes_clashing_columns(spark):
    docs = labelled(spark).selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS score__", "3 AS told")
    kept = langid.drop_undetermined(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert langid.drop_undetermined(docs.limit(0)).collect() == []


def test_hundred_languages_half_without_a_family(spark):
    random.seed(9)
    names = [f"l{k:03d}" for k in range(100)]
    families = {x: f"f{k % 7}" for k, x in enumerate(names[:50])}
    syllables = {x: ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for x in names}
    rows = [(i, " ".join(random.choice(syllables[x]) for _ in range(30)), x) for i, x in enumerate(names * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, families)
    assert langid.held_out_accuracy(out, docs).first().accuracy > 0.97


def test_cells_hold_each_pair_once():
    languages = [f"l{k:02d}" for k in range(30)]
    families = {x: f"f{k % 4}" for k, x in enumerate(languages[:22])}
    cells = {}
    for level, first, second, lang, name, group, most in langid._cells(languages, families, 600, 1200):
        cells.setdefault((level, first, second), {}).setdefault(name, []).append((group, lang, most))
    pairs = Counter((level, a, b) for (level, first, second), own in cells.items() for a, b in combinations(sorted(own), 2) if first == second or own[a][0][0] != own[b][0][0])
    kin = {families.get(x, x) for x in languages}
    within = sum(len(list(combinations([x for x in languages if families.get(x) == f], 2))) for f in kin)
    assert set(pairs.values()) == {1} and len(pairs) == len(kin) * (len(kin) - 1) // 2 + within
    assert all(len(own) <= 2 * langid.GROUP and sum(m for _, _, m in rows) <= 1200 for own in cells.values() for rows in own.values())


def test_both_forms_of_the_descent_agree_and_are_optimal():
    made = np.random.default_rng(2)
    x, y = made.normal(0, 1, (40, 39)), np.where(made.random(40) < 0.3, 1, -1)
    few, many = langid.fit_svm(x[:39], y[:39]), langid.fit_svm(np.concatenate([x[:39]] * 3), np.concatenate([y[:39]] * 3))
    assert np.allclose(few, many, atol=2e-3)

    def loss(w):
        weight = np.where(y[:39] > 0, 0.5 / (y[:39] > 0).sum(), 0.5 / (y[:39] < 0).sum())
        return 0.01 * w @ w + (weight * np.maximum(0, 1 - y[:39] * (x[:39] @ w[:-1] + w[-1])) ** 2).sum()

    assert all(loss(few) <= loss(few + 0.01 * made.normal(0, 1, 40)) for _ in range(200))


def test_votes_against_brute_force():
    made = np.random.default_rng(3)
    families = {"a1": "a", "a2": "a", "a3": "a", "b1": "b", "b2": "b"}
    languages = [*families, "c"]
    machines = {("family", p, q): made.normal(0, 1, langid.DIMENSIONS + 1).astype(np.float32) for p, q in combinations("abc", 2)}
    machines |= {(f, p, q): made.normal(0, 1, langid.DIMENSIONS + 1).astype(np.float32) for f in "ab" for p, q in combinations([x for x in families if families[x] == f], 2)}
    machines = {k if k[0] != "family" else ("family", *k[1:]): v for k, v in machines.items()}
    model = langid.Model(languages, families, machines)

    def vote(level, names, x):
        if len(names) == 1:
            return names[0], 1.0
        p = {(a, b): 1 / (1 + np.exp(-np.clip(2 * (x @ machines[level, a, b][:-1].astype(float) + machines[level, a, b][-1]), -40, 40))) for a, b in combinations(names, 2)}
        won = lambda n: [p[a, b] if n == a else 1 - p[a, b] for a, b in p if n in (a, b)]
        best = max(names, key=lambda n: (sum(v >= 0.5 for v in won(n)), sum(won(n))))
        return best, sum(won(best)) / (len(names) - 1)

    random.seed(5)
    texts = [text(random.choice(list(SOUNDS)), random.randint(1, 30)) for _ in range(60)]
    told, score = model.predict(pa.array(texts))
    for t, lang, s in zip(texts, told, score, strict=True):
        raw, at = langid.strings(langid._lowered(pa.array([t])))
        gram, before = langid._grams(raw, at)
        x = np.bincount(gram, minlength=langid.DIMENSIONS) / before[-1] * langid._SCALE
        family, sure = vote("family", ["a", "b", "c"], x)
        best, own = vote(family, [x for x in languages if families.get(x, x) == family], x)
        assert lang == best and abs(s - sure * own) < 1e-3


def test_dotted_columns(spark):
    docs = labelled(spark).selectExpr("*", "1 AS `x.y`", "2 AS `x`", "3 AS `lang_pred.z`")
    kept = langid.drop_undetermined(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    model = langid.train(docs)
    assert langid.predict(docs, model).columns == [*docs.columns, "lang_pred", "score"]
