import numpy as np

from seqspan.llm import pstable


def table(spark, vectors, extra=()):
    rows = [(i, v, 1, 5) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long")


def brute(vectors, least=0.9):
    n, count, root = len(vectors), [0] * len(vectors), list(range(len(vectors)))
    x = [np.array(v, np.float32).astype(float) for v in vectors]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= least:
                count[i] += 1
                count[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (count[i], find(i)) for i in range(n)}


def planted(seed):
    made = np.random.default_rng(seed)
    centres = made.standard_normal((30, 16))
    near = [c + made.standard_normal(16) * 0.07 for c in centres for _ in range(made.integers(1, 9))]
    loose = list(made.standard_normal((150, 16)))
    copies = [near[0]] * 40
    return [[float(z) for z in v] for v in near + loose + copies + [near[0] * 3]]


def test_recall_and_exact_links(spark, monkeypatch):
    monkeypatch.setattr(pstable, "BLOCK", 16)
    vectors = planted(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pstable.near_vectors(table(spark, vectors), recall=0.9999).collect()}
    assert got == brute(vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(10, None, 1, 1), (11, [], 1, 1), (12, [0.0, 0.0], 1, 1), (13, [nan, 1.0], 1, 1), (14, [inf, 1.0], 1, 1), (15, [None, 1.0], 1, 1), (None, [1.0, 0.0], 1, 1), (16, [1.0, 0.0, 0.0], 1, 1)]
    rows = table(spark, [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0]], [*odd, (0, [1.0, 0.0], 9, 9)])
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pstable.near_vectors(rows).collect()), key=str)
    alone = [(i, 0, i, True) for i in range(10, 17)]
    assert got == sorted([(0, 1, 0, True), (0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (None, 0, None, True), *alone], key=str)
    assert pstable.near_vectors(rows.limit(0)).collect() == []


def test_plan_grows_with_the_input():
    assert pstable.plan(10**3, 0.9)[0] < pstable.plan(10**7, 0.9)[0]


def test_recall_of_the_registered_setting(spark):
    made = np.random.default_rng(7)
    base = made.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = made.standard_normal((3000, 64))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.9005 * base + np.sqrt(1 - 0.9005**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    all_ = np.concatenate([base, near])
    dots = np.triu(all_ @ all_.T, 1)
    want = np.bincount(np.concatenate(np.nonzero(dots >= 0.9)), minlength=len(all_))
    links = np.array([got[i].n_links for i in range(len(all_))])
    assert (links <= want).all() and links.sum() >= 0.93 * want.sum()


def test_large_and_small_doubles(spark):
    rows = [(i, v) for i, v in enumerate([[1e60, 0.0], [1e-60, 0.0], [2e-60, 0.0], [1.0, 0.0], [1e200, 1e200], [1e-300, 1e-300], [0.0, 1.0]])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_blocks_and_counts_of_a_tight_cluster(spark, monkeypatch):
    made = np.random.default_rng(3)
    centre = made.standard_normal(16)
    rows = [(i, (centre + 0.02 * made.standard_normal(16)).tolist()) for i in range(900)] + [(1000 + i, made.standard_normal(16).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pstable, "BLOCK", 100)
    monkeypatch.setattr(pstable, "SAMPLED", 4)
    got = {r.vec_id: r for r in pstable.near_vectors(frame, recall=0.9999).collect()}
    assert {got[i].n_links for i in range(900)} == {899} and {got[i].component_id for i in range(900)} == {0}
