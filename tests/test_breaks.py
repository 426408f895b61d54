import random

from seqspan.operators import breaks as op


def test_choice_never_overlaps(spark):
    random.seed(1)
    rows = [(r, random.randint(1, 4), random.random(), a, a + random.randint(1, 60)) for r in range(5) for a in random.sample(range(600), 60)]
    out = op.choose(spark.createDataFrame(rows, "rec_id long, support long, evidence double, a long, b long")).collect()
    for r in range(5):
        own = sorted((x.a, x.b) for x in out if x.rec_id == r)
        assert own and all(b <= c for (_, b), (c, _) in zip(own, own[1:]))
        taken = []
        for _, s, e, a, b in sorted([x for x in rows if x[0] == r], key=lambda x: (x[1], x[2], x[3], x[4]), reverse=True):
            if all(min(b, d) <= max(a, c) for c, d in taken):
                taken.append((a, b))
        assert own == sorted(taken)


def test_silences_count_against_those_before(spark):
    signals = spark.createDataFrame([(1, "black", 100, 100, 1), (1, "silence", 104, 104, 2), (1, "silence", 112, 112, 3), (1, "silence", 118, 118, 4), (1, "silence", 130, 130, 5), (1, "scene", 131, 131, 6)], "rec_id long, kind string, t0 long, t1 long, id long")
    out = sorted((r.t2 / 2, r.score) for r in op.coincidences(signals, 7).collect())
    assert out == [(100, 2.0), (112, 0.6), (130, 1.0)]


def test_matching_is_one_to_one_in_order(spark):
    schema = "rec_id long, a long, b long"
    truth = spark.createDataFrame([(1, 0, 10), (1, 12, 22), (1, 50, 60)], schema)
    found = spark.createDataFrame([(1, 4, 19), (1, 51, 60), (1, 49, 59), (1, 90, 99)], schema)
    pairs = op.matched(truth, found)
    assert sorted((r.a, r.c) for r in pairs.collect()) == [(0, 4), (12, -1), (50, 49)]
    row = op.score_summary(pairs, found, 2).first()
    assert (row.true_breaks, row.found, row.false_breaks, row.near_edges, row.error) == (3, 2, 2, 2, 15)


def test_edges_move_inward_for_worth(spark):
    brackets = spark.createDataFrame([(1, 1, 100, 200)], "rec_id long, id long, lo long, hi long")
    events = spark.createDataFrame([(1, 99, 0.6), (1, 111, 1.0), (1, 190, 1.0), (1, 201, 0.6), (1, 95, 9.0)], "rec_id long, t long, score double")
    row = op.refine_edges(brackets, events, 20, 2, 0.04).first()
    assert (row.a, row.sa, row.b, row.sb) == (99, 0.6, 190, 1.0) or (row.a, row.b) == (99, 190)
