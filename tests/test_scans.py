import random

import pytest
from pyspark.sql import functions as F

from seqspan.operators import frames, scans
from seqspan.operators.scans import Running


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    made = [(None if k == 3 else k, i, random.choice([None, 1, 2, 5, 9])) for k, n in ((0, 900), (1, 40), (2, 1), (3, 30)) for i in range(n)]
    return spark.createDataFrame(made, "k long, i long, v long").repartition(5)


STEPS = {f"{kind}{'_back' * back}{'_before' * before}": (kind, back, before) for kind in ("sum", "count", "max", "min", "last") for back in (False, True) for before in (False, True)}


def test_ranges_give_what_one_window_gives(rows):
    steps = {name: Running(F.col("v"), kind, back, before) for name, (kind, back, before) in STEPS.items()}
    one, many = (scans.running(rows, ["k"], ["i"], ranges, **steps) for ranges in (False, True))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_against_plain_code(rows):
    out = scans.running(rows, ["k"], ["-i"], True, total=Running(F.col("v"), "sum"), last=Running(F.col("v"), "last", before=True))
    for k in (0, None):
        own = sorted((r for r in out.collect() if r.k == k), key=lambda r: -r.i)
        total = last = None
        for r in own:
            assert r.last == last
            if r.v is not None:
                total, last = (total or 0) + r.v, r.v
            assert r.total == total


def test_one_key_is_dealt_over_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scans, "written", lambda df, name, f=scans.written: seen.append(f(df, name)) or seen[-1])
    rows = spark.range(4000).selectExpr("0L AS k", "id AS i", "id AS v")
    out = scans.running(rows, ["k"], ["i"], True, total=Running(F.col("v"), "sum"))
    assert out.agg(F.max("total")).first()[0] == 3999 * 2000
    parts = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(parts) >= 8 and max(parts) < 1000


def test_medians(spark):
    random.seed(6)
    made = {k: [random.randint(0, 40) for _ in range(n)] for k, n in ((1, 501), (2, 500), (3, 1))}
    rows = spark.createDataFrame([(k, v) for k, own in made.items() for v in [*own, None]], "k long, v long")
    for ranges in (True, False, None):
        got = {r.k: (r.n, r.low, r.high) for r in scans.medians(rows, ["k"], "v", ranges).collect()}
        assert got == {k: (len(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) for k, v in made.items()}


def test_outgrown(rows):
    assert scans.outgrown(rows, ["k"], 899) and not scans.outgrown(rows, ["k"], 900) and not scans.outgrown(rows.limit(0), ["k"])


def test_frame_operators_agree_both_ways(spark):
    random.seed(7)
    packets = spark.createDataFrame([(k, i, random.choice([None, i * 40 + random.randint(-60, 60)]), random.randint(1, 99), random.random() < 0.1) for k in (1, 2) for i in range(300)], "rec_id long, seq long, pts long, size long, is_key boolean")
    probes = spark.createDataFrame([(k, i, random.randint(-500, 13_000)) for k in (1, 2, 3) for i in range(80)], "rec_id long, id long, q long")
    index = frames.frame_index(packets, False).cache()
    jumps = frames.clock_jumps(index, 60, False).cache()
    for run in (
        lambda r: frames.frame_index(packets, r), lambda r: frames.carry_null_bytes(packets, r), lambda r: frames.nearest(index, probes, r), lambda r: frames.snap(index, probes, None, r),
        lambda r: frames.picture_groups(packets, r), lambda r: frames.upper_median_gap(index, "pts", r), lambda r: frames.clock_jumps(index, 60, r), lambda r: frames.jump_before(probes, jumps, r),
    ):
        assert sorted(map(str, run(True).collect())) == sorted(map(str, run(False).collect()))
