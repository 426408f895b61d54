from seqspan.operators import frames as op


def packets(spark, rows):
    return spark.createDataFrame([(1, i, p, s, k) for i, (p, s, k) in enumerate(rows)], "rec_id long, seq long, pts long, size long, is_key boolean")


def test_bytes_of_packets_without_time_go_to_the_next(spark):
    rows = packets(spark, [(None, 5, False), (20, 1, True), (10, 2, False), (None, 7, False), (None, 7, True), (30, 3, False), (None, 100, False)])
    out = [(r.pts, r.bytes, r.cum_bytes, r.is_key) for r in op.frame_index(rows).orderBy("frame_no").collect()]
    assert out == [(10, 2, 2, False), (20, 6, 8, True), (30, 17, 25, False)]


def test_nearest_takes_the_earlier_of_two(spark):
    index = op.frame_index(packets(spark, [(0, 1, True), (10, 1, False), (10, 1, False)]))
    asked = spark.createDataFrame([(1, i, q) for i, q in enumerate([5, 6, -4, 99, 10])], "rec_id long, id long, q long")
    assert {r.id: r.frame_no for r in op.nearest(index, asked).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}
    assert {r.id: (r.down, r.up) for r in op.snap(index, asked).collect()} == {0: (0, 10), 1: (0, 10), 2: (0, 0), 3: (10, None), 4: (10, 10)}


def test_upper_median(spark):
    points = spark.createDataFrame([(1, p) for p in (0, 1, 3, 6, 16)], "rec_id long, pts long")
    assert op.upper_median_gap(points).first().gap == 3


def test_rounding_is_half_to_even(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(op.seconds_to_ticks(F.lit(2.5), F.lit(100), 1, 1).alias("x"), op.seconds_to_ticks(F.lit(3.5), F.lit(100), 1, 1).alias("y")).first()
    assert (row.x, row.y) == (102, 104)


def test_jumps_and_lengths(spark):
    index = op.frame_index(packets(spark, [(p, 1, False) for p in (0, 10, 20, 520, 530)]))
    jumps = op.clock_jumps(index, 60)
    assert [(r.split2, r.amount) for r in jumps.collect()] == [(540, 490)]
    spans = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 530), (1, 2, 600, 610)], "rec_id long, k long, s long, e long")
    out = [(r.jumped, r.out_length, r.out_start) for r in op.jumped_lengths(spans, jumps).orderBy("k").collect()]
    assert out == [(0, 100, 0), (490, -60, 100), (0, 10, 40)]
    at = spark.createDataFrame([(1, 1, 269), (1, 2, 270)], "rec_id long, id long, q long")
    assert {r.id: r.jumped for r in op.jump_before(at, jumps).collect()} == {1: 0, 2: 490}


def test_half_pictures_merge_into_the_last_kept(spark):
    index = op.frame_index(packets(spark, [(0, 1, True), (50, 2, False), (80, 4, True), (110, 8, False)]))
    out = [(r.pts, r.bytes, r.is_key) for r in op.collapse_field_pairs(index, 100).orderBy("pts").collect()]
    assert out == [(0, 3, True), (80, 12, True)]
