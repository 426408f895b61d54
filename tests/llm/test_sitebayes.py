import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspan.llm import sitebayes


def corpus(spark, seed=9):
    random.seed(seed)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = ["".join(random.choice("abcdef") for _ in range(random.randint(2, 7))) for _ in range(random.randint(20, 60))]
        text = " ".join(w + random.choice(["$$$", "###"]) for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "bad" if bad and i % 2 else f"h{i % 4}", "en", 3.0, "x"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, own double, path string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in sitebayes.judge(docs, labels).collect()}
    assert len(out) == 400
    unlabelled = [i for i in range(400) if i % 2 and i % 3]
    right = [out[i].kept == (i % 5 != 0) for i in unlabelled]
    assert sum(right) / len(right) > 0.97
    assert out[5].host_posterior < out[1].host_posterior
    kept = sitebayes.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def brute(rows, priors):
    """host's and path's posterior of each row (host, path, told), from all other rows."""
    out = []
    for i, (host, path, _) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i]
        near = [r[2] for r in others if r[0] == host]
        on = [r[2] for r in others if r[:2] == (host, path)]
        of_host = (sum(near) + priors.of_hosts * priors.mean) / (len(near) + priors.of_hosts)
        out.append((of_host, (sum(on) + priors.of_paths * of_host) / (len(on) + priors.of_paths)))
    return out


def test_posteriors_against_brute_force(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", "c", None]), random.choice(["x", "y", None]), random.random()) for _ in range(150)] + [("alone", "z", 0.2)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "a long, host string, path string, told double")
    sums, priors = sitebayes.site_sums(frame)
    assert priors.mean == pytest.approx(sum(r[2] for r in rows) / len(rows))
    of_host, of_path = sitebayes.site_posteriors(priors)
    for bound in (64 << 20, 0):
        sitebayes.BROADCAST_BYTES, before = bound, sitebayes.BROADCAST_BYTES
        got = sitebayes._with_sites(frame, sums).select("a", of_host.alias("h"), of_path.alias("p")).orderBy("a").collect()
        sitebayes.BROADCAST_BYTES = before
        for r, (h, p) in zip(got, brute(rows, priors), strict=True):
            assert r.h == pytest.approx(h, abs=1e-7) and r.p == pytest.approx(p, abs=1e-7)
    assert got[150].p == pytest.approx(priors.mean)


def test_labels_feed_the_sites(spark):
    docs, labels = corpus(spark)
    same = docs.withColumn("source", F.lit("s"))
    for quality in (0, 1):
        told = labels.where(F.col("quality") == quality)
        out = sitebayes.judge(same, told).first()
        assert (out.path_posterior > 0.5) == (quality == 1)


def test_query_against_brute_force(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in sitebayes.judge(docs, labels).collect()}
    label = {r.doc_id: float(r.quality) for r in labels.collect()}
    model = sitebayes.train(docs, labels)
    rows = docs.orderBy("doc_id").collect()
    own = model.probability(sitebayes.text_features(pa.array([r.text for r in rows])))
    told = [(r.source, r.lang, label.get(r.doc_id, float(own[i]))) for i, r in enumerate(rows)]
    _, priors = sitebayes.site_sums(spark.createDataFrame(told, "host string, path string, told double"))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, (h, p) in enumerate(brute(told, priors)):
        r = got[rows[i].doc_id]
        quality = 1 / (1 + math.exp(-(odds(own[i]) + odds(p) - odds(priors.mean))))
        assert r.host_posterior == pytest.approx(h, abs=2e-6) and r.quality == pytest.approx(quality, abs=1e-5) and r.kept == (r.quality >= 0.5)


def test_stage_judges_rows_not_ids(spark):
    docs, labels = corpus(spark)
    good, bad = "abc def abd. " * 20, "a### b$$$ c### d$$$ " * 20
    odd = spark.createDataFrame([(7, bad, "h1", "en", 1.0, "p"), (None, good, "h1", "en", 1.0, "p"), (None, bad, "h1", "en", 1.0, "p"), (900, good, "h1", "en", 1.0, "p"), (900, bad, "h1", "en", 1.0, "p")], docs.schema)
    kept = sitebayes.drop_low_quality(docs.unionByName(odd), labels)
    told = {(r.doc_id, r.text) for r in kept.where("doc_id IS NULL OR doc_id IN (7, 900)").collect()}
    own = docs.where("doc_id = 7").first().text
    assert told == {(7, own), (None, good), (900, good)}


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(900, None, None, None, 1.0, "p"), (901, "", "h1", "en", 1.0, "p"), (902, " \n", "h1", None, 1.0, "p"), (None, "abc def abd. fed cab", "h1", "en", 1.0, "p"), (903, "word " * 40_000, "h1", "en", 1.0, "p"), (903, "word " * 40_000, "h1", "en", 1.0, "p")], docs.schema)
    more = spark.createDataFrame([(900, None, 1), (None, 1, 0), (1, 7, 0)], labels.schema)
    out = sitebayes.judge(docs.unionByName(odd), labels.unionByName(more)).where("doc_id IS NULL OR doc_id >= 900").collect()
    told = {r.doc_id: r for r in out}
    assert len(out) == 6
    assert not any(told[i].kept or told[i].own for i in (900, 901, 902))
    assert sitebayes.judge(docs.limit(0), labels).collect() == []
    alone = sitebayes.judge(docs, labels.limit(0)).collect()
    assert {r.own for r in alone} == {0.5}


def test_features_and_fit():
    x = sitebayes.text_features(pa.array(["a a a b", "A1 $$ x", None, "", "é ö"]))
    names = list(sitebayes.FEATURES)
    assert x.shape == (5, len(names)) and not x[2].any() and not x[3].any()
    assert x[0, names.index("repeats")] == 0.5 and x[1, names.index("marked_words")] == pytest.approx(1 / 3)
    made = np.random.default_rng(2)
    z = made.standard_normal((300, 3))
    model = sitebayes.fit(z, (z[:, 0] > 0).astype(float))
    assert ((model.probability(z) > 0.5) == (z[:, 0] > 0)).mean() > 0.97
