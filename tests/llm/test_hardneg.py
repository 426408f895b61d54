import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspan.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score long, row_no long, part string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=3, low=50, high=95):
    whole = lambda v: [math.floor(256 * x) for x in v]
    rows = [(i, whole(v), c) for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, v, c in rows:
        if i is None or i % 50:
            continue
        scores = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, d) for j, w, d in rows if j != i]  # noqa: B905
        rest = sorted((x for x in scores if x[2] != c), key=key)
        for p, j, _ in sorted((x for x in scores if x[2] == c), key=key)[:positives]:
            window = [x for x in rest if low * p <= 100 * x[0] <= high * p][:negatives]
            out += [(i, j, k + 1, x[1], p, x[0]) for k, x in enumerate(window)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, rows, **more):
    return got(hardneg.hard_negatives(table(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, **more))


def made(n, seed=1, wide=6):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.integers(-3, 4, wide) / 4], int(r.integers(0, 3))) for i in range(n)]


def test_against_brute_force_with_ties(spark):
    rows = made(600)
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want
    assert run(spark, rows, positives=2, negatives=7, low=20, high=80) == brute(rows, 2, 7, 20, 80)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 37), ("BLOCK_ANCHORS", 3), ("LEAST_ROWS", 11), ("CHUNK", 2)):
        monkeypatch.setattr(hardneg, name, value)
    rows = made(400, 2)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = made(200, 3)
    rows += [(None, [0.75] * 6, 1), (1000, None, 1), (1050, [0.5] * 6, None), (1100, [0.5, None, 0.5], 0), (1150, [math.inf] * 6, 0), (1200, [math.nan] * 6, 0)]
    rows += [(1250, [], 2), (1300, [0.75], 1), (1301, [0.75] * 9, 0), (50, [0.75] * 6, 2), (7, [0.75] * 6, 0), (7, [0.75] * 6, 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []


def test_components_beyond_double_precision(spark):
    random.seed(4)
    rows = [(i, [random.choice([1e12, -3.7e11, 2.5, 1e30 if i % 5 == 0 else 0.1]) for _ in range(3)], i % 2) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_hot_vector(spark):
    rows = [(i, [0.5, 0.5], 0 if i % 3 else 1) for i in range(400)] + [(i, [0.4, 0.3], i % 4) for i in range(400, 700)]
    assert run(spark, rows) == brute(rows)


def test_blocks_meet_in_any_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 3)
    rows, confs = made(400, 5), {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        found = run(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == brute(rows)


def test_labels_of_few_rows(spark):
    rows = [(i, [1.0, float(i % 7)], i % 200) for i in range(0, 1000, 5)]
    want = brute(rows)
    assert len(want) > 20 and run(spark, rows) == want


@pytest.mark.parametrize("big", [1, 1 << 61])
def test_excluded_rows_come_last(big):
    scores = np.array([[big, hardneg._NONE, -3, -4 if big == 1 else -hardneg._MOST]])
    assert hardneg._first(scores, 3).tolist() == [[0, 2, 3]]
    assert hardneg._first(scores, 5).tolist() == [[0, 2, 3, 1]]


def test_query_with_the_greatest_labels(spark, tmp_path):
    rows = [(i, v, (1 << 31) - 1 if i % 2 else c) for i, v, c in made(300, 6)] + [(350, [0.75] * 6, (1 << 31) - 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = got(queries.op11_hard_negatives(spark, str(tmp_path)))
    assert found == brute([(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows])


@pytest.mark.parametrize("scores,want", [([100, 100, 80], ([95, 76], 40)), ([-5, 0], ([0], 0)), ([1], ([], 0)), ([], ([], 0))])
def test_limits(scores, want):
    assert hardneg._limits(scores, 50, 95) == want
