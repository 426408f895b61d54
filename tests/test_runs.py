from pyspark.sql import functions as F

from seqspan.operators import runs as op


def samples(spark, times, flags=None):
    flags = flags or [True] * len(times)
    return spark.createDataFrame([(1, i, t, f) for i, (t, f) in enumerate(zip(times, flags))], "rec_id long, i long, t long, on boolean")


def spans(df):
    return sorted((r.t0, r.t1) for r in df.collect())


def test_gap_and_length_bounds(spark):
    assert spans(op.runs_of(samples(spark, [0, 8, 16, 25]), F.col("on"), 8, 0)) == [(0, 16), (25, 25)]
    assert spans(op.runs_of(samples(spark, [0, 25, 50, 75]), F.col("on"), 30, 75)) == [(0, 75)]
    assert spans(op.runs_of(samples(spark, [0, 25, 50, 74]), F.col("on"), 30, 75)) == []


def test_nothing_flagged_gives_nothing(spark):
    rows = samples(spark, list(range(50)), [False] * 50)
    assert op.runs_of(rows, F.col("on"), 8, 0).count() == 0
    assert op.consecutive_runs(rows).count() == 0
    assert op.junction_mask(rows, 5).where("junction").count() == 0


def test_runs_part_the_flagged_samples(spark):
    rows = samples(spark, list(range(0, 400, 2)), [(i * 7) % 11 < 6 for i in range(200)])
    out = op.runs_of(rows, F.col("on"), 2, 0).collect()
    assert sum(r.n for r in out) == rows.where("on").count()


def test_short_presences_do_not_split_absences(spark):
    flags = [False, False, True, False, True, True, True, True, False]
    merged = F.col("on") & F.col("i").isin(5, 6)  # 2, 4 and 7 were left out of account
    got = [r.present for r in op.merge_absence(samples(spark, list(range(9)), flags).withColumn("merged", merged)).orderBy("i").collect()]
    assert got == [False, False, False, False, True, True, True, True, False]
    alone = [r.present for r in op.merge_absence(samples(spark, list(range(9)), [True] * 9).withColumn("merged", F.col("i") < 4)).collect()]
    assert all(alone)
    held = [r.held for r in op.sustained(samples(spark, list(range(9)), flags), 2).orderBy("i").collect()]
    assert held == [False] * 4 + [True] * 4 + [False]


def test_modes(spark):
    rows = spark.createDataFrame([(1, 0, 0, 30, "a"), (1, 1, 10, 31, "b"), (1, 2, 20, 10, "b"), (1, 3, 30, 11, "a")], "rec_id long, i long, t long, width long, aspect string")
    assert tuple(op.bucket_mode(rows, "width", 10).first()) == (1, 10, 0.5)
    assert tuple(op.weighted_mode(rows, "aspect").first()) == (1, "a", 20)
    assert op.weighted_mode(rows.limit(1), "aspect").first().weight == 1
