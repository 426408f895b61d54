"""Registered queries over signals, brackets and breaks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import breaks as op
from ..operators import runs
from . import adapters as src
from .adapters import with_tables
from .run_queries import GAP, HOUR, _runs

WINDOW = HOUR
RULES = op.BreakRules(shortest=8 * HOUR, shortest_sure=4 * HOUR, longest=160 * HOUR, edge=HOUR)


def black_events(spark, sf_dir):
    return op.black_events(src.signals(spark, sf_dir), WINDOW)


def coincidence_events(spark, sf_dir):
    return op.coincidences(src.signals(spark, sf_dir), WINDOW)


def _events(spark, sf_dir):
    return black_events(spark, sf_dir).select("rec_id", F.floor(F.col("mid2") / 2).cast("long").alias("t"), "score")


def _brackets(spark, sf_dir):
    r = runs.runs_of(src.samples(spark, sf_dir), F.col("width") < 300, GAP, 4 * HOUR)
    n = F.row_number().over(W.partitionBy("rec_id").orderBy("t0")).cast("long")
    return r.select("rec_id", n.alias("id"), F.col("t0").alias("lo"), F.col("t1").alias("hi"), (F.col("n") % 3 + 1).alias("support"), (F.col("n") % 2 == 0).alias("sure"))


def _ends(spark, sf_dir):
    s = src.samples(spark, sf_dir).groupBy("rec_id").agg(F.max("t").alias("finish"))
    return s.withColumn("duration", F.col("finish") + 1000)


def _refined(spark, sf_dir):
    return op.refine_edges(_brackets(spark, sf_dir), _events(spark, sf_dir), 10 * HOUR, HOUR, 0.04 / HOUR)


def refine_edges(spark, sf_dir):
    return _refined(spark, sf_dir).select("rec_id", "id", "a", "sa", "b", "sb")


def judge_brackets(spark, sf_dir):
    return op.judged(_refined(spark, sf_dir), _ends(spark, sf_dir).select("rec_id", "finish"), RULES).select("rec_id", "id", "a", "b", "reason")


def _candidates(spark, sf_dir):
    kept = op.judged(_refined(spark, sf_dir), _ends(spark, sf_dir).select("rec_id", "finish"), RULES).where("reason = 'kept'")
    wide = src.cuts(spark, sf_dir).select("rec_id", (F.col("id") % 3).alias("support"), (F.col("id") % 5 / 2.0).alias("evidence"), "a", (F.col("b") + 200).alias("b"))
    return kept.select("rec_id", "support", (F.col("sa") + F.col("sb")).alias("evidence"), "a", "b"), wide


def choose_breaks(spark, sf_dir):
    return op.choose(_candidates(spark, sf_dir)[1])


def detect_breaks(spark, sf_dir):
    chosen = op.choose(_candidates(spark, sf_dir)[0])
    return op.snap_to_ends(chosen, _ends(spark, sf_dir), 2 * HOUR)


def _cuts(spark, sf_dir):
    return src.cuts(spark, sf_dir).where("b > a AND id % 4 < 2").select("rec_id", "id", "a", "b")


def _cut_ends(spark, sf_dir):
    c = src.cuts(spark, sf_dir).groupBy("rec_id").agg(F.max("b").alias("finish"))
    return c.select("rec_id", "finish", (F.col("finish") + F.col("rec_id") % 50).alias("duration"))


def snap_edges(spark, sf_dir):
    return op.snap_to_ends(_cuts(spark, sf_dir).select("rec_id", "a", "b"), _cut_ends(spark, sf_dir), 20)


def density_brackets(spark, sf_dir):
    return op.density_brackets(_events(spark, sf_dir), 1.5, 8 * HOUR, 60 * HOUR, 0.02 / HOUR)


def _marks(spark, sf_dir):
    return src.cuts(spark, sf_dir).where("id % 4 >= 2").select("rec_id", F.col("a").alias("t0"), (F.col("b") + 15).alias("t1"))


def mask_disagreements(spark, sf_dir):
    b = _cuts(spark, sf_dir).select("rec_id", "id", F.col("a").alias("lo"), F.col("b").alias("hi"))
    return op.disagreements(b, _marks(spark, sf_dir), _cut_ends(spark, sf_dir).select("rec_id", "finish"), 0.3, 60).select("rec_id", "id", "lo", "hi", "covered", "dropped")


def suppress_overlaps(spark, sf_dir):
    b = _cuts(spark, sf_dir).select("rec_id", "id", F.col("a").alias("lo"), F.col("b").alias("hi"))
    return op.without_overlap(b, _marks(spark, sf_dir).select("rec_id", F.col("t0").alias("c"), F.col("t1").alias("d")))


def sweep_tail(spark, sf_dir):
    brackets = src.cuts(spark, sf_dir).select("rec_id", F.col("id").alias("order"), (F.col("a") - 10).alias("lo"), (F.col("b") + 30).alias("hi"))
    return op.sweep_tail(_cuts(spark, sf_dir).select("rec_id", "a", "b").distinct(), brackets, _cut_ends(spark, sf_dir).select("rec_id", "duration"), 20, 30)


def _found(spark, sf_dir):
    return src.cuts(spark, sf_dir).where("id % 4 = 1 AND b > a OR id % 7 = 0").select("rec_id", (F.col("a") + F.col("id") % 9 - 4).alias("a"), (F.col("b") + F.col("id") % 5).alias("b"))


def score_matches(spark, sf_dir):
    return op.matched(_cuts(spark, sf_dir), _found(spark, sf_dir)).where("a IS NOT NULL")


def score_summary(spark, sf_dir):
    return op.score_summary(score_matches(spark, sf_dir), _found(spark, sf_dir), 2)


def countable_breaks(spark, sf_dir):
    cuts = src.cuts(spark, sf_dir).where("b > a AND id % 6 = 0").select("rec_id", "a", "b")
    return op.countable(_found(spark, sf_dir).where("b > a"), cuts, 5)


def padding_scores(spark, sf_dir):
    cuts = src.cuts(spark, sf_dir).where("b > a").select("rec_id", "id", "a", "b")
    ends = _cut_ends(spark, sf_dir).select("rec_id", "duration")
    edge = cuts.groupBy("rec_id").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    rows = cuts.join(edge, "rec_id").select("rec_id", F.when(F.col("a") == F.col("first"), F.lit(0)).otherwise(F.col("a")).cast("long").alias("a"), "b", "last").distinct()
    return op.padding_edges(rows.where("a = 0 OR b = last").select("rec_id", "a", "b"), _found(spark, sf_dir), ends, 30)


QUERIES = {f.__name__: f for f in (black_events, coincidence_events, refine_edges, judge_brackets, choose_breaks, detect_breaks, snap_edges, density_brackets, mask_disagreements, suppress_overlaps, sweep_tail, score_matches, score_summary, countable_breaks, padding_scores)}

_BLACK = f"black AS (SELECT rec_id, id, t0 + t1 AS mid2, (t0 + t1) // 2 AS lo, (t0 + t1 + 1) // 2 AS hi FROM signals WHERE kind = 'black'), events AS (SELECT b.rec_id, b.id, mid2, 1.0::DOUBLE + CASE WHEN EXISTS (SELECT 1 FROM signals s WHERE s.kind = 'silence' AND s.rec_id = b.rec_id AND s.t0 <= b.hi + {WINDOW} AND s.t1 >= b.lo - {WINDOW}) THEN 1.0 ELSE 0.0 END + CASE WHEN EXISTS (SELECT 1 FROM signals s WHERE s.kind = 'scene' AND s.rec_id = b.rec_id AND s.t0 <= b.hi + {WINDOW} AND s.t0 >= b.lo - {WINDOW}) THEN 0.5 ELSE 0.0 END AS score FROM black b), ev2 AS (SELECT rec_id, mid2 // 2 AS t, score FROM events)"
_BRACKETS = f"{_runs('rr', 'samples', 'width < 300', GAP, 4 * HOUR)}, brackets AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t0) AS id, t0 AS lo, t1 AS hi, n % 3 + 1 AS support, n % 2 = 0 AS sure FROM rr), fin AS (SELECT rec_id, max(t) AS finish, max(t) + 1000 AS duration FROM samples GROUP BY rec_id)"


def _edge(at: str, back: int, ahead: int, name: str) -> str:
    return f"{name} AS (SELECT k.rec_id, k.id, e.t, e.score FROM brackets k JOIN ev2 e ON e.rec_id = k.rec_id AND e.t BETWEEN k.{at} - {back} AND k.{at} + {ahead} AND e.t BETWEEN k.lo - {HOUR} AND k.hi + {HOUR} QUALIFY row_number() OVER (PARTITION BY k.rec_id, k.id ORDER BY round(e.score - abs(e.t - k.{at}) * {0.04 / HOUR!r}::DOUBLE, 9) DESC, e.t, e.score) = 1)"


_REFINED = f"{_BLACK}, {_BRACKETS}, {_edge('lo', HOUR, 10 * HOUR, 'xs')}, {_edge('hi', 10 * HOUR, HOUR, 'xe')}, refined AS (SELECT k.*, coalesce(xs.t, lo) AS a, coalesce(xs.score, 0) AS sa, coalesce(xe.t, hi) AS b, coalesce(xe.score, 0) AS sb FROM brackets k LEFT JOIN xs USING (rec_id, id) LEFT JOIN xe USING (rec_id, id))"
_JUDGED = f"judged AS (SELECT *, CASE WHEN hi - lo < fl THEN 'short' WHEN b - a < fl THEN 'short when refined' WHEN (s_at OR e_at) AND finish > 0 AND b - a > finish * 0.5 THEN 'most of the recording' WHEN b - a > {RULES.longest} AND NOT (s_at OR e_at) THEN 'long' WHEN NOT (sa > 0 OR s_at) AND NOT (sb > 0 OR e_at) THEN 'no evidence' WHEN b - a < {RULES.shortest} AND NOT ((sa > 0 OR s_at) AND (sb > 0 OR e_at)) THEN 'short with one edge' ELSE 'kept' END AS reason FROM (SELECT *, CASE WHEN sure THEN {RULES.shortest_sure} ELSE {RULES.shortest} END AS fl, lo <= {RULES.edge} AS s_at, finish > 0 AND hi >= finish - {RULES.edge} AS e_at FROM refined JOIN fin USING (rec_id)))"
_CUTS = "cc AS (SELECT rec_id, id, a, b FROM cuts WHERE b > a AND id % 4 < 2), ce AS (SELECT rec_id, max(b) AS finish, max(b) + rec_id % 50 AS duration FROM cuts GROUP BY rec_id), mk AS (SELECT rec_id, a AS t0, b + 15 AS t1 FROM cuts WHERE id % 4 >= 2)"


def _greedy(source: str) -> str:
    """Greedy choice as a recursion over each recording's ranked candidates."""
    return (
        f"ranked AS (SELECT rec_id, a, b, row_number() OVER (PARTITION BY rec_id ORDER BY support DESC, evidence DESC, a DESC, b DESC) AS r FROM {source}), "
        "walk AS (SELECT rec_id, 0::BIGINT AS r, []::STRUCT(a BIGINT, b BIGINT)[] AS taken FROM (SELECT DISTINCT rec_id FROM ranked) UNION ALL "
        "SELECT w.rec_id, k.r, CASE WHEN len(list_filter(w.taken, lambda x: least(x.b, k.b) - greatest(x.a, k.a) > 0)) = 0 THEN list_append(w.taken, {'a': k.a, 'b': k.b}) ELSE w.taken END FROM walk w JOIN ranked k ON k.rec_id = w.rec_id AND k.r = w.r + 1), "
        "chosen AS (SELECT rec_id, x.a AS a, x.b AS b FROM (SELECT rec_id, unnest(taken) AS x FROM walk QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY r DESC) >= 1 AND r = max(r) OVER (PARTITION BY rec_id)))"
    )


#: Matching as a recursion: each true break has its candidates in the order of preference, and takes the first still free.
_MATCHED = (
    "tr AS (SELECT rec_id, a, b, row_number() OVER (PARTITION BY rec_id ORDER BY a, b) AS r FROM cuts WHERE b > a AND id % 4 < 2), "
    "fo AS (SELECT rec_id, a + id % 9 - 4 AS c, b + id % 5 AS d FROM cuts WHERE (id % 4 = 1 AND b > a) OR id % 7 = 0), fn AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY c, d) AS n FROM fo), "
    "pr AS (SELECT tr.rec_id, tr.r, list(n ORDER BY least(b, d) - greatest(a, c) DESC, n) AS ns FROM tr JOIN fn ON fn.rec_id = tr.rec_id AND least(b, d) - greatest(a, c) > 0.5 * (b - a) GROUP BY tr.rec_id, tr.r), "
    "tc AS (SELECT tr.*, coalesce(ns, []) AS ns FROM tr LEFT JOIN pr USING (rec_id, r)), "
    "mw AS (SELECT rec_id, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS n FROM (SELECT DISTINCT rec_id FROM tr) UNION ALL "
    "SELECT w.rec_id, k.r, CASE WHEN len(list_filter(k.ns, lambda x: NOT list_contains(w.taken, x))) > 0 THEN list_append(w.taken, list_filter(k.ns, lambda x: NOT list_contains(w.taken, x))[1]) ELSE w.taken END, list_filter(k.ns, lambda x: NOT list_contains(w.taken, x))[1] FROM mw w JOIN tc k ON k.rec_id = w.rec_id AND k.r = w.r + 1), "
    "ma AS (SELECT tr.rec_id, tr.a, tr.b, coalesce(fn.c, -1) AS c, coalesce(fn.d, -1) AS d FROM mw JOIN tr ON tr.rec_id = mw.rec_id AND tr.r = mw.r LEFT JOIN fn ON fn.rec_id = mw.rec_id AND fn.n = mw.n)"
)
_ALONE = (
    f"si AS (SELECT rec_id, id, t0 + t1 AS t2, (t0 + t1) // 2 AS lo, (t0 + t1 + 1) // 2 AS hi, row_number() OVER (PARTITION BY rec_id ORDER BY t0, id) AS r FROM signals WHERE kind = 'silence'), "
    f"sc AS (SELECT si.*, CASE WHEN EXISTS (SELECT 1 FROM signals x WHERE x.kind = 'scene' AND x.rec_id = si.rec_id AND x.t0 <= si.hi + {WINDOW} AND x.t0 >= si.lo - {WINDOW}) THEN 1.0 ELSE 0.6 END AS score FROM si), "
    "cw AS (SELECT rec_id, 0::BIGINT AS r, coalesce(list(mid2) FILTER (mid2 IS NOT NULL), []) AS taken, NULL::BIGINT AS t2, NULL::DOUBLE AS score FROM (SELECT DISTINCT rec_id FROM signals) LEFT JOIN events USING (rec_id) GROUP BY rec_id UNION ALL "
    f"SELECT w.rec_id, k.r, CASE WHEN len(list_filter(w.taken, lambda x: abs(x - k.t2) <= {2 * WINDOW})) = 0 THEN list_append(w.taken, k.t2) ELSE w.taken END, CASE WHEN len(list_filter(w.taken, lambda x: abs(x - k.t2) <= {2 * WINDOW})) = 0 THEN k.t2 END, k.score FROM cw w JOIN sc k ON k.rec_id = w.rec_id AND k.r = w.r + 1)"
)
ORACLES = {
    "coincidence_events": with_tables("signals", f"WITH {_BLACK}, {_ALONE} SELECT rec_id, mid2 AS t2, score FROM events UNION ALL SELECT rec_id, t2, score FROM cw WHERE t2 IS NOT NULL").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "score_matches": with_tables("cuts", f"WITH {_MATCHED} SELECT * FROM ma").replace("WITH cuts", "WITH RECURSIVE cuts"),
    "score_summary": with_tables("cuts", f"WITH {_MATCHED}, p AS (SELECT rec_id, count(*) AS true_breaks, count(*) FILTER (c >= 0) AS found, CAST(coalesce(sum((abs(a - c) <= 2)::INT + (abs(b - d) <= 2)::INT) FILTER (c >= 0), 0) AS BIGINT) AS near_edges, CAST(coalesce(sum(abs(a - c) + abs(b - d)) FILTER (c >= 0), 0) AS BIGINT) AS error FROM ma GROUP BY rec_id) SELECT rec_id, true_breaks, found, coalesce((SELECT count(*) FROM fo WHERE fo.rec_id = p.rec_id), 0) - found AS false_breaks, near_edges, error FROM p").replace("WITH cuts", "WITH RECURSIVE cuts"),
    "countable_breaks": with_tables("cuts", "WITH fo AS (SELECT rec_id, a + id % 9 - 4 AS a, b + id % 5 AS b FROM cuts WHERE (id % 4 = 1 AND b > a) OR id % 7 = 0) SELECT * FROM fo WHERE b > a AND NOT EXISTS (SELECT 1 FROM cuts p WHERE p.rec_id = fo.rec_id AND p.b > p.a AND p.id % 6 = 0 AND p.a - 5 <= fo.a AND fo.b <= p.b + 5)"),
    "padding_scores": with_tables("cuts", "WITH c AS (SELECT *, min(a) OVER (PARTITION BY rec_id) AS first, max(b) OVER (PARTITION BY rec_id) AS last FROM cuts WHERE b > a), du AS (SELECT rec_id, max(b) + rec_id % 50 AS duration FROM cuts GROUP BY rec_id), p AS (SELECT DISTINCT rec_id, CASE WHEN a = first THEN 0 ELSE a END AS a, b FROM c WHERE a = first OR b = last), r AS (SELECT p.*, duration, CASE WHEN a <= 30 THEN 'head' ELSE 'tail' END AS side FROM p JOIN du USING (rec_id) WHERE (a <= 30) <> (b >= duration - 30)), fo AS (SELECT rec_id, a + id % 9 - 4 AS c, b + id % 5 AS d FROM cuts WHERE (id % 4 = 1 AND b > a) OR id % 7 = 0), o AS (SELECT r.rec_id, r.a, r.b, r.side, min(c) AS nf, max(d) AS ff FROM r JOIN fo ON fo.rec_id = r.rec_id AND d > c AND least(d, b) - greatest(c, a) > 0 GROUP BY ALL), w AS (SELECT *, CASE WHEN side = 'head' THEN a ELSE greatest(a, nf) END AS lo, CASE WHEN side = 'head' THEN least(b, ff) ELSE b END AS hi FROM o), z AS (SELECT w.*, greatest(0, hi - lo) - (SELECT coalesce(sum(greatest(0, least(d, hi) - greatest(c, lo))), 0) FROM fo WHERE fo.rec_id = w.rec_id AND d > c AND least(d, b) - greatest(c, a) > 0) AS rest FROM w) SELECT r.rec_id, r.a, r.b, r.side, z.rec_id IS NULL AS missed, coalesce(CASE WHEN r.side = 'head' THEN ff - r.b ELSE nf - r.a END, 0) AS error, CAST(coalesce(CASE WHEN rest > 30 THEN rest END, 0) AS BIGINT) AS unswept FROM r LEFT JOIN z ON z.rec_id = r.rec_id AND z.a = r.a AND z.b = r.b AND z.side = r.side"),
    "black_events": with_tables("signals", f"WITH {_BLACK} SELECT * FROM events"),
    "refine_edges": with_tables("signals samples", f"WITH {_REFINED} SELECT rec_id, id, a, sa, b, sb FROM refined"),
    "judge_brackets": with_tables("signals samples", f"WITH {_REFINED}, {_JUDGED} SELECT rec_id, id, a, b, reason FROM judged"),
    "choose_breaks": with_tables("cuts", f"WITH cand AS (SELECT rec_id, id % 3 AS support, id % 5 / 2.0 AS evidence, a, b + 200 AS b FROM cuts), {_greedy('cand')} SELECT * FROM chosen").replace("WITH cuts", "WITH RECURSIVE cuts"),
    "detect_breaks": with_tables("signals samples", f"WITH {_REFINED}, {_JUDGED}, cand AS (SELECT rec_id, support, sa + sb AS evidence, a, b FROM judged WHERE reason = 'kept'), {_greedy('cand')} SELECT rec_id, CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a, b) = 1 AND a <= {2 * HOUR} THEN 0 ELSE a END AS a, CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a DESC, b DESC) = 1 AND finish > 0 AND b >= finish - {2 * HOUR} THEN greatest(duration, finish) ELSE b END AS b FROM chosen JOIN fin USING (rec_id)").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "snap_edges": with_tables("cuts", f"WITH {_CUTS} SELECT rec_id, CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a, b) = 1 AND a <= 20 THEN 0 ELSE a END AS a, CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a DESC, b DESC) = 1 AND finish > 0 AND b >= finish - 20 THEN greatest(duration, finish) ELSE b END AS b FROM cc JOIN ce USING (rec_id)"),
    "density_brackets": with_tables("signals", f"WITH {_BLACK}, st AS (SELECT DISTINCT rec_id, t FROM ev2 WHERE score >= 1.5), p AS (SELECT x.rec_id, x.t AS lo, y.t AS hi FROM st x JOIN st y ON x.rec_id = y.rec_id AND y.t - x.t BETWEEN {8 * HOUR} AND {60 * HOUR}), q AS (SELECT p.*, round(coalesce((SELECT sum(score) FROM ev2 e WHERE e.rec_id = p.rec_id AND e.t > lo AND e.t < hi), 0), 6) AS inside FROM p) SELECT * FROM q WHERE inside / (hi - lo) >= {0.02 / HOUR!r}::DOUBLE"),
    "mask_disagreements": with_tables("cuts", f"WITH {_CUTS}, c AS (SELECT cc.rec_id, cc.id, a AS lo, b AS hi, CAST(coalesce((SELECT sum(greatest(0, least(t1, b) - greatest(t0, a))) FROM mk WHERE mk.rec_id = cc.rec_id), 0) AS BIGINT) AS covered FROM cc) SELECT rec_id, id, lo, hi, covered, NOT (hi <= lo OR lo <= 60 OR hi >= finish - 60) AND covered > (hi - lo) * 0.3 AS dropped FROM c JOIN ce USING (rec_id)"),
    "suppress_overlaps": with_tables("cuts", f"WITH {_CUTS} SELECT rec_id, id, a AS lo, b AS hi FROM cc WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.rec_id = cc.rec_id AND least(t1, b) - greatest(t0, a) > 0)"),
    "sweep_tail": with_tables("cuts", f"WITH {_CUTS}, br AS (SELECT DISTINCT rec_id, a, b FROM cc), s AS (SELECT rec_id, duration FROM ce JOIN (SELECT rec_id, max(b) AS last FROM br GROUP BY rec_id) USING (rec_id) WHERE duration - last > 20), pick AS (SELECT k.rec_id, br.a AS start, s.duration FROM cuts k JOIN s USING (rec_id) JOIN br ON br.rec_id = k.rec_id AND abs(k.a - 10 - br.a) <= 30 WHERE k.b + 30 >= duration - 20 QUALIFY row_number() OVER (PARTITION BY k.rec_id ORDER BY k.id, br.a) = 1) SELECT br.rec_id, br.a, CASE WHEN br.a = start THEN duration ELSE b END AS b FROM br LEFT JOIN pick USING (rec_id) WHERE start IS NULL OR br.a <= start"),
}
