import random

import pytest

from seqspan.operators import carry
from seqspan.operators import intervals as op


def ranges(spark, rows):
    return spark.createDataFrame([(1, a, b) for a, b in rows], "rec_id long, start_f long, end_f long")


def bounds(spark, n):
    return spark.createDataFrame([(1, n)], "rec_id long, n long")


def got(df):
    return sorted((r.start_f, r.end_f) for r in df.collect())


@pytest.mark.parametrize("rows,want", [([(0, 4), (5, 9)], [(0, 9)]), ([(0, 4), (6, 9)], [(0, 4), (6, 9)]), ([(9, 5), (0, 4)], [(0, 9)]), ([(0, 20), (3, 4), (19, 21)], [(0, 21)])])
def test_union(spark, rows, want):
    assert got(op.union(ranges(spark, rows))) == want


@pytest.mark.parametrize("n,removed,overflow,want", [(10, [(3, 5)], False, [(0, 2), (6, 9)]), (10, [(1, 4), (3, 6)], False, [(0, 0), (7, 9)]), (10, [(12, 15)], False, [(0, 9)]), (10, [(12, 15)], True, [(0, 11)]), (10, [], False, [(0, 9)]), (10, [(0, 9)], False, [])])
def test_complement(spark, n, removed, overflow, want):
    out = got(op.complement(ranges(spark, removed), bounds(spark, n), overflow))
    assert out == want or (overflow and out == [(0, 9), (0, 11)]) is False and out == want


def test_subtract_and_commit(spark):
    assert got(op.subtract(ranges(spark, [(0, 9)]), ranges(spark, [(3, 5)]))) == [(0, 2), (6, 9)]
    assert got(op.commit(ranges(spark, [(0, 4), (8, 12)]), ranges(spark, [(3, 9)]))) == [(3, 9)]
    assert got(op.commit(ranges(spark, [(0, 4), (8, 12)]), ranges(spark, [(5, 7)]))) == [(0, 12)]


def test_sets_of_frames(spark):
    random.seed(3)
    for _ in range(4):
        a = [(s, s + random.randint(0, 90)) for s in random.sample(range(500), 12)]
        b = [(s, s + random.randint(0, 40)) for s in random.sample(range(500), 12)]
        days = lambda rows: {d for s, e in rows for d in range(s, e + 1)}
        left = op.union(ranges(spark, a))
        assert days(got(op.subtract(left, ranges(spark, b)))) == days(a) - days(b)
        assert days(got(op.intersect(left, op.union(ranges(spark, b))))) == days(a) & days(b)
        whole = op.complement(ranges(spark, a), bounds(spark, 600))
        assert got(op.complement(whole, bounds(spark, 600))) == got(left)


def test_markers_go_round(spark):
    markers = spark.createDataFrame([(1, 5), (1, 9)], "rec_id long, frame long")
    at = spark.createDataFrame([(1, 7, 9), (1, 8, 5), (2, 9, 3)], "rec_id long, id long, at long")
    out = {r.id: (r.following, r.preceding) for r in op.neighbours(markers, at).collect()}
    assert out == {7: (5, 5), 8: (9, 9), 9: (3, 3)}


def test_padding(spark):
    cuts = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 180), (600, 780), (3000, 3600)])], "rec_id long, id long, a long, b long")
    length = spark.createDataFrame([(1, 3600)], "rec_id long, duration long")
    assert [r.kind for r in op.split_padding(cuts, length).orderBy("id").collect()] == ["padding", "advert", "padding"]
    assert op.learnable(op.split_padding(cuts, length), length, 35, 420).first().reason == "ok"


def test_edit_log(spark):
    log = [("add", 0, 9), ("remove", 3, 5), ("undo", 0, 0), ("redo", 0, 0), ("undo", 0, 0), ("add", 20, 30), ("redo", 0, 0)]
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(log)], "rec_id long, seq long, action string, start_f long, end_f long")
    assert tuple(op.edit_log(rows).first()) == (1, "0-9,20-30", 2, 0)


@pytest.mark.parametrize("keeps,want", [([(12, 15)], [(0, 18)]), ([(2, 3), (12, 15)], [(0, 2), (8, 18)]), ([(4, 30), (35, 39)], [(0, 6)]), ([(10, 12)], [(0, 18)]), ([(0, 9), (11, 12)], [])])
def test_kept_frames_past_the_last_one(spark, keeps, want):
    index = spark.createDataFrame([(1, n, 500 + 2000 * n) for n in range(10)], "rec_id long, frame_no long, pts long")
    assert sorted((r.a, r.b) for r in carry.cut_seconds(ranges(spark, keeps), index, 1000.0).collect()) == want
