import random

import numpy as np

from seqspan.operators import cards, learn, masks


def near(x, y):
    return sum(abs(a - b) for a, b in zip(x, y)) / len(x)


def test_onsets_against_a_plain_walk(spark):
    random.seed(2)
    base = [[random.randint(0, 255) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        fp = [min(255, max(0, v + random.randint(-3, 3))) for v in random.choice(base)] if random.random() > 0.1 else [1] * 6
        rows.append((i % 3, i % 2, i, i / 2, fp, random.random() < 0.1))
    frame = spark.createDataFrame(rows, "rec_id long, place long, i long, offset double, fp array<int>, known boolean")
    want = set()
    for rec in range(3):
        for place in range(2):
            last, kept = None, 0
            for r in rows:
                if r[:2] != (rec, place) or kept >= 9:
                    continue
                if r[5] or sum(r[4]) / 6 < 24:
                    last = None
                elif last is None or near(r[4], last) >= 8:
                    last, kept = r[4], kept + 1
                    want.add((rec, place, r[2]))
    got = {(r.rec_id, r.place, r.i) for r in cards.onsets(frame.repartition(5), 24.0, 8.0, 9).collect()}
    assert got == want


def test_readings_compare_a_mask_with_its_ring(spark):
    made = np.random.default_rng(4)
    width, height = 12, 9
    frames, mask = [], [(4, 3), (5, 3), (4, 4), (5, 4)]
    for i in range(6):
        v = made.integers(0, 255, (height, width))
        frames.append((1, i, v.reshape(-1).tolist()))
    frames.append((1, 9, None))
    frames.append((2, 0, [0] * (width * height)))
    got = {r.i: r for r in masks.readings(spark.createDataFrame(frames, "rec_id long, i long, v array<int>"), spark.createDataFrame([(1, x, y) for x, y in mask], "rec_id long, x long, y long"), width, height, pad=2).collect()}
    assert sorted(got) == list(range(6))
    for i in range(6):
        v = np.array(frames[i][2]).reshape(height, width)
        on, off, lit, dim = [], [], [], []
        for y in range(1, 7):
            for x in range(2, 8):
                edge = abs(v[y, x + 1] - v[y, x]) + abs(v[y + 1, x] - v[y, x]) > 18
                (on if (x, y) in mask else off).append(edge)
                (lit if (x, y) in mask else dim).append(v[y, x])
        assert abs(got[i].edges - (np.mean(on) - np.mean(off))) < 1e-9
        assert abs(got[i].light - (np.mean(lit) - np.mean(dim))) < 1e-9


def test_masks_land_on_the_picture(spark):
    points = spark.createDataFrame([("k", 0.0, 0.0), ("k", 0.25, 0.5), ("k", 1.5, 0.0)], "key string, fx double, fy double")
    boxes = spark.createDataFrame([(1, "k", 1.5, 0.0, 10.0, 8.0)], "rec_id long, key string, left double, top double, w double, h double")
    assert sorted((r.x, r.y) for r in masks.on_picture(points, boxes, 12, 12).collect()) == [(2, 0), (4, 4)]


def test_a_card_at_the_edges_is_learned(spark):
    made = np.random.default_rng(5)
    card = made.integers(0, 255, 12).astype(float)
    frames, cuts = [], [(40, 80), (140, 190), (260, 300)]
    for t in range(0, 400, 2):
        fp = made.integers(0, 255, 12).astype(float)
        if any(a + 2 <= t < a + 6 or b - 4 <= t < b for a, b in cuts):
            fp = card + made.normal(0, 1, 12)
        frames.append((1, t // 2, t, fp.tolist()))
        frames.append((2, t // 2, t, fp.tolist()))
    frame = spark.createDataFrame(frames, "rec_id long, i long, t long, fp array<double>")
    rules = cards.EdgeCardRules(window=10, margin=2, reach=4, padding=5, step=2, match=8.0, clear=15.0)
    cut = spark.createDataFrame([(r, a, b) for r in (1, 2) for a, b in cuts], "rec_id long, a long, b long")
    gate = spark.createDataFrame([(1, "ok"), (2, "length")], "rec_id long, reason string")
    ends = spark.createDataFrame([(1, 400), (2, 400)], "rec_id long, duration long")
    got, places = cards.learned_cards(frame, cut, gate, ends, rules, 64)
    row = got.collect()
    assert len(row) == 1 and (row[0].rec_id, row[0].matched, row[0].edges) == (1, 6, 6) and row[0].clearance > 15
    assert near(row[0].fp, card) < 2
    assert {(r.side, r.offset, r.spread, r.n) for r in places.collect()} == {("start", 2.0, 0.0, 3), ("end", 0.0, 0.0, 3)}


def test_reach_gives_all_near_cards_from_few_comparisons():
    made = np.random.default_rng(6)
    bright = made.integers(0, 200, 1000)
    prints = (bright[:, None] + made.normal(0, 4, (1000, 24))).tolist()
    table = learn.Reach(list(range(1000)), prints)
    asked = (made.integers(0, 200, 300)[:, None] + made.normal(0, 4, (300, 24))).tolist()
    for fp in asked:
        want = {k for k, x in enumerate(prints) if near(x, fp) < 8}
        assert {k for k, _ in table.near(fp, 8.0)} == want
    assert table.compared <= 300 * 1000 / 10


def test_reach_of_few_and_equal_cards():
    one = learn.Reach([7], [[1.0, 2.0]])
    assert list(one.near([1.0, 2.5], 1.0)) == [(7, 0.25)] and list(one.near([9.0, 9.0], 1.0)) == []
    same = learn.Reach(list(range(20)), [[3.0, 3.0]] * 20)
    assert {k for k, _ in same.near([3.0, 3.5], 1.0)} == set(range(20))


def test_markers_are_matched_from_frames(spark):
    """A recording's lead-in ends at 100 and its tail begins at 900; another project's markers stand 4 behind and 6 in front."""
    made = np.random.default_rng(7)
    shots = {t: made.integers(0, 255, 8).astype(float) for t in range(0, 1001, 2)}
    frames = spark.createDataFrame([(1, t, fp.tolist()) for t, fp in shots.items()], "rec_id long, t long, fp array<double>")
    rows = [(1, 0, 2, 4, shots[108] + 1), (2, 1, 2, -6, shots[890] - 1), (3, 0, 1, 0, shots[96]), (4, 1, 2, -6, shots[110])]
    markers = spark.createDataFrame([(c, s, p, o, fp.tolist()) for c, s, p, o, fp in rows], "card long, side long, project long, offset long, fp array<double>")
    breaks = spark.createDataFrame([(1, 0, 100), (1, 400, 500), (1, 900, 1000), (2, 0, 1000)], "rec_id long, a long, b long")
    ends = spark.createDataFrame([(1, 1000, 60, 60), (2, 1000, 60, 60)], "rec_id long, duration long, head_reach long, tail_reach long")
    events = spark.createDataFrame([(1, 105, 2.0), (1, 102, 0.5)], "rec_id long, t long, score double")
    rules = cards.MarkerRules(search=20, snap=3, run_gap=1, cost=0.04)
    today = {(r.rec_id, r.side): r.today for r in cards.programme_edges(breaks, ends).collect()}
    assert today == {(1, 0): 100, (1, 1): 900}
    got = cards.with_markers(breaks, frames, markers, events, ends, rules, 8.0, 26, 64).collect()
    assert sorted((r.rec_id, r.a, r.b) for r in got) == [(1, 0.0, 105.0), (1, 400.0, 500.0), (1, 896.0, 1000.0), (2, 0.0, 1000.0)]


def test_markers_without_hits_change_nothing(spark):
    frames = spark.createDataFrame([(1, 98, [9.0])], "rec_id long, t long, fp array<double>")
    markers = spark.createDataFrame([], "card long, side long, project long, offset long, fp array<double>")
    breaks = spark.createDataFrame([(1, 0, 100)], "rec_id long, a long, b long")
    ends = spark.createDataFrame([(1, 1000, 60, 60)], "rec_id long, duration long, head_reach long, tail_reach long")
    events = spark.createDataFrame([], "rec_id long, t long, score double")
    rules = cards.MarkerRules(search=20, snap=3, run_gap=1, cost=0.04)
    got = cards.with_markers(breaks, frames, markers, events, ends, rules, 8.0, 26, 64).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 100.0)]


def plain_offsets(frames, markers, today, below, reach, gap):
    """Every frame near an edge against every marker of its side."""
    from statistics import median

    hits = {}
    for (rec, side), edge in today.items():
        for r, t, fp in frames:
            if r == rec and abs(t - edge) <= reach:
                for s, project, offset, other in markers:
                    if s == side and project != rec and near(fp, other) < below:
                        hits.setdefault((rec, side, t), []).append((project, offset))
    out, before = {}, {}
    for rec, side, t in sorted(hits):
        if t - before.get((rec, side), -1_000_000) > gap:
            least = {}
            for project, offset in hits[rec, side, t]:
                least[project] = min(offset, least.get(project, offset))
            out[rec, side, t] = median(least.values())
        before[rec, side] = t
    return out


def test_frames_and_markers_meet_by_fingerprint(spark, monkeypatch):
    """As pair by pair, with equal fingerprints, own markers and several frames at an instant; equal ones are compared once."""
    made = np.random.default_rng(11)
    draw = lambda: made.integers(0, 12, 2).astype(float).tolist()
    frames = [(r, int(t), draw()) for r in range(30) for t in made.integers(0, 400, 60)]
    markers = [(int(made.integers(0, 2)), int(made.integers(0, 12)), int(made.integers(-9, 9)), draw()) for _ in range(900)]
    today = {(r, s): 100 + s * 200 for r in range(30) for s in (0, 1)}
    met = []
    own = learn.sightings
    monkeypatch.setattr(learn, "sightings", lambda a, b, below: met.extend([a.count(), b.count()]) or own(a, b, below))
    got = cards.usual_offsets(
        spark.createDataFrame(frames, "rec_id long, t long, fp array<double>"), spark.createDataFrame(markers, "side long, project long, offset long, fp array<double>"),
        spark.createDataFrame([(*k, v) for k, v in today.items()], "rec_id long, side long, today long"), 0.8, 60, 3, 64,
    ).collect()
    want = plain_offsets(frames, markers, today, 0.8, 60, 3)
    assert len(want) > 300 and {(r.rec_id, r.side, r.t): r.usual for r in got} == want and len(got) == len(want)
    assert max(met) <= 144
