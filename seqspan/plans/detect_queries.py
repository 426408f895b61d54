"""Registered queries over detection as a whole, remembered masks, cards and markers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import breaks as br
from ..operators import cards as op
from ..operators import detect as dt
from ..operators import masks as mk
from ..operators import runs
from . import adapters as src
from .adapters import table, with_tables
from .break_queries import _BLACK, _ends, _events, _greedy
from .run_queries import GAP, HOUR, _runs

RULES = dt.Rules(
    breaks=br.BreakRules(shortest=8 * HOUR, shortest_sure=4 * HOUR, longest=160 * HOUR, edge=HOUR), search=10 * HOUR, slack=HOUR, cost=0.04 / HOUR, strong=1.5, density=0.02 / HOUR,
    end_slack=2 * HOUR, tail=24 * HOUR, near=30 * HOUR, bucket=1 << 27, mark_edge=12 * HOUR,
)
PLACED_CARDS = op.CardRules(run=2 * HOUR, shortest=10 * HOUR, longest=90 * HOUR, least=6 * HOUR, reach=24 * HOUR, shrink=10 * HOUR, snap=3 * HOUR, spread=0.5)
PLACED_MARKERS = op.MarkerRules(search=20 * HOUR, snap=3 * HOUR, run_gap=HOUR, cost=0.04 / HOUR)
NEAR = 4.0
CARDS = op.CardRules(run=2, shortest=10, longest=90, least=6, reach=12, shrink=5, snap=3, spread=0.5)


def _spans(spark, sf_dir, flag, gap, length):
    return runs.runs_of(src.samples(spark, sf_dir), flag, gap, length).select("rec_id", F.col("t0").alias("lo"), F.col("t1").alias("hi"), "n")


def detect_all(spark, sf_dir):
    width = F.col("width")
    shape = _spans(spark, sf_dir, width >= 300, GAP, 4 * HOUR).where("rec_id % 3 > 0").select("rec_id", "lo", "hi")
    aspect = _spans(spark, sf_dir, F.col("aspect") == "view", 2 * GAP, 4 * HOUR).select("rec_id", "lo", "hi")
    anchors = runs.gaps_between(_spans(spark, sf_dir, width < 220, 12 * HOUR, 6 * HOUR).withColumnsRenamed({"lo": "t0", "hi": "t1"})).where("rec_id % 2 = 0").select("rec_id", F.col("a").alias("lo"), F.col("b").alias("hi"))
    level = F.array(F.struct(F.lit(0).alias("corner"), F.lit(300).alias("bound")), F.struct(F.lit(1).alias("corner"), F.lit(200).alias("bound")))
    corners = src.samples(spark, sf_dir).withColumn("c", F.explode(level)).groupBy("rec_id", "c.corner").agg(F.avg((width >= F.col("c.bound")).cast("double")).alias("share"))
    two = [_spans(spark, sf_dir, width < bound, GAP, 4 * HOUR).select("rec_id", F.lit(c).alias("corner"), "lo", "hi", (F.col("n") % 3 + 1).alias("support")) for c, bound in ((0, 300), (1, 200))]
    # the masks of some recordings come and go: they have marks and propose nothing
    mask = _spans(spark, sf_dir, width < 25, GAP, 2 * HOUR).where("rec_id % 4 > 0").select("rec_id", "lo", "hi")
    marks = _spans(spark, sf_dir, width >= 25, 24 * HOUR, HOUR).select("rec_id", F.col("lo").alias("t0"), F.col("hi").alias("t1"))
    start = src.samples(spark, sf_dir).groupBy("rec_id").agg(F.min("t").alias("start"))
    # times count from each recording's start
    rel = lambda d, *cols: d.join(start, "rec_id").withColumns({c: F.col(c) - F.col("start") for c in cols}).drop("start")
    events = rel(_events(spark, sf_dir), "t")
    both = [rel(d, "lo", "hi") for d in (shape, aspect, anchors, two[0].unionByName(two[1]), mask)]
    return dt.detect(events, both[0], both[1], both[2], corners, both[3], both[4], rel(marks, "t0", "t1"), rel(_ends(spark, sf_dir), "finish", "duration"), RULES)


def _placed_samples(spark, sf_dir):
    s = src.samples(spark, sf_dir)
    return s.withColumn("t", F.col("t") - F.min("t").over(W.partitionBy("rec_id")))


def detect_placed(spark, sf_dir):
    """Detection with cards and markers at its end."""
    s, i = _placed_samples(spark, sf_dir), F.col("i")
    start = src.samples(spark, sf_dir).groupBy("rec_id").agg(F.min("t").alias("start"))
    known = lambda keep, value: F.when(i % keep > 0, value)
    sightings = s.where("aspect = 'purchase'").select(
        "rec_id", i.alias("id"), F.col("t").alias("t0"), (F.col("t") + F.col("width") % 6 * HOUR).alias("t1"),
        known(5, (i % 3 - 1) * HOUR).alias("start_off"), known(5, i % 3 / 4.0).alias("start_spread"), known(7, (i % 4 - 2) * HOUR).alias("end_off"), known(7, i % 5 / 8.0).alias("end_spread"),
    )
    scenes = src.signals(spark, sf_dir).where("kind = 'scene'").join(start, "rec_id").select("rec_id", (F.col("t0") - F.col("start")).alias("t"))
    events = _events(spark, sf_dir).join(start, "rec_id").select("rec_id", (F.col("t") - F.col("start")).alias("t"), "score")
    frames = s.select("rec_id", "i", "t", F.array((F.col("width") % 100), i % 50, (F.col("width") * 7) % 90).cast("array<double>").alias("fp"))
    markers = frames.where("rec_id % 10 = 0 AND i % 11 < 4").select((F.col("rec_id") * 1_000_000 + i).alias("card"), (i % 2).alias("side"), F.col("rec_id").alias("project"), ((i % 7 - 3) * HOUR).alias("offset"), "fp")
    ends = s.groupBy("rec_id").agg((F.max("t") + 1000).alias("duration")).select("rec_id", "duration", F.lit(60 * HOUR).alias("head_reach"), F.lit(24 * HOUR).alias("tail_reach"))
    found = op.with_cards(detect_all(spark, sf_dir), sightings, scenes, PLACED_CARDS, RULES.bucket)
    return op.with_markers(found, frames.drop("i"), markers, events, ends, PLACED_MARKERS, NEAR, 30 * HOUR, RULES.bucket)


def _track(spark, sf_dir):
    s = src.samples(spark, sf_dir)
    first = W.partitionBy("rec_id")
    return s.select("rec_id", "i", (F.col("t") - F.min("t").over(first)).alias("t"), (F.col("width") / 500).alias("v"))


def mask_scores(spark, sf_dir):
    track = _track(spark, sf_dir)
    ends = track.groupBy("rec_id").agg(F.max("t").alias("duration"))
    cuts = track.where("i % 23 = 5").select("rec_id", F.col("t").alias("a"), (F.col("t") + F.col("i") % 11 * 6 * HOUR).alias("b"))
    return mk.scored(track, cuts, ends, 0.3, 8 * HOUR, 4 * HOUR, 16 * HOUR, 12 * HOUR, 3 * HOUR, 24 * HOUR)


def _records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("long").alias("model"), (F.col("l_partkey") % 5).alias("project")]
    return li.groupBy(*keys).agg(F.round(F.max("l_discount"), 4).alias("good"), F.sum(F.when(F.col("l_tax") > 0.07, 1).otherwise(0)).alias("false"), (F.max("l_quantity") > 40).alias("fit"))


def _masks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    m = s.select(k.alias("key"), F.explode(F.sequence(F.lit(1), (k % 4 + 5).cast("int"))).alias("model"))
    return m.select("key", F.col("model").cast("long").alias("model"), (9 - F.col("model")).cast("long").alias("place"), (F.col("model") == F.col("key") % 3 + 1).alias("current"))


def mask_tiers(spark, sf_dir):
    return mk.tiers(_masks(spark, sf_dir), _records(spark, sf_dir))


def mask_active(spark, sf_dir):
    return mk.active(_masks(spark, sf_dir), _records(spark, sf_dir))


def mask_results(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("project", F.concat(F.lit("p"), F.col("project").cast("string"))).withColumn("order", F.col("model") * 10 + F.length("project"))
    fresh = r.where(F.col("false") == 0).withColumn("order", F.col("order") + 100).withColumn("project", F.when(F.col("key") % 7 == 0, "").when(F.col("key") % 2 == 0, F.concat("project", F.lit("x"))).otherwise(F.col("project")))
    return mk.recorded(r, fresh, 4, _masks(spark, sf_dir))


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("rec_id"), F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 400).cast("int") % 256).alias("v"))


def mask_readings(spark, sf_dir):
    f = _frames(spark, sf_dir)
    boxes = f.select("rec_id").distinct().selectExpr("rec_id", "rec_id % 3 AS key", "cast(rec_id % 2 AS double) AS left", "1.0D AS top", "6.0D AS w", "5.0D AS h")
    points = [(k, x / 4, y / 4) for k in range(3) for x in range(k, 3) for y in range(1, 3)]
    at = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(x).alias("fx"), F.lit(y).alias("fy")) for k, x, y in points])
    masks = boxes.select("key").distinct().select("key", F.explode(at).alias("p")).where("p.key = key").select("key", "p.fx", "p.fy")
    out = mk.readings(f, mk.on_picture(masks, boxes, 7, 7), 8, 8, pad=2)
    return out.select("rec_id", "i", F.round("edges", 6).alias("edges"), F.round("light", 6).alias("light"))


def _sightings(spark, sf_dir):
    c = src.cuts(spark, sf_dir)
    i = F.col("id")
    return c.select("rec_id", "id", F.col("a").alias("t0"), (F.col("a") + i % 6).alias("t1"), F.when(i % 5 > 0, i % 3 - 1).alias("start_off"), F.when(i % 5 > 0, i % 3 / 4.0).alias("start_spread"), F.when(i % 7 > 0, i % 4 - 2).alias("end_off"), F.when(i % 7 > 0, i % 5 / 8.0).alias("end_spread"))


def _found(spark, sf_dir):
    c = src.cuts(spark, sf_dir).where("id % 9 = 0").groupBy("rec_id", (F.floor(F.col("a") / 120) * 120).alias("a")).agg(F.max(F.col("id") % 60 + 15).alias("n"))
    return c.select("rec_id", F.col("a").cast("long").alias("a"), (F.col("a") + F.col("n")).cast("long").alias("b"))


def card_breaks(spark, sf_dir):
    return op.card_breaks(_sightings(spark, sf_dir), _found(spark, sf_dir), CARDS, 128)


def card_edges(spark, sf_dir):
    scenes = src.cuts(spark, sf_dir).where("id % 2 = 0").select("rec_id", F.col("b").alias("t"))
    return op.card_edges(_found(spark, sf_dir), _sightings(spark, sf_dir), scenes, CARDS, 128)


def card_added(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("order"), F.col("embedding").alias("fp"))
    new = e.groupBy("key").agg(F.max(F.struct("order", "fp")).alias("x")).select("key", "x.order", "x.fp")
    return op.added_cards(e.join(new.select("key", "order"), ["key", "order"], "left_anti"), new, 0.13, 5).select("key", "order")


def marker_onsets(spark, sf_dir):
    f = _frames(spark, sf_dir)
    rows = f.select("rec_id", (F.col("i") % 3).alias("place"), "i", (F.col("i") / 2).alias("offset"), F.col("v").alias("fp"), (F.col("i") % 11 == 0).alias("known"))
    return op.onsets(rows, 31.0, 32.0, 12)


def _marker_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("rec_id"), (F.col("l_linenumber") % 2).cast("long").alias("side"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("t"), (F.col("l_partkey") % 4).alias("project"), (F.col("l_orderkey") % 13 - 6).alias("offset"))


def _today(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("rec_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("rec_id", F.col("side").cast("long").alias("side"), (F.col("rec_id") * 37 % 300 + 100 + F.col("side") * 1900).alias("today"))


def _marker_events(spark, sf_dir):
    c = src.cuts(spark, sf_dir).where("id % 3 = 0")
    return c.select(F.floor(F.col("rec_id") / 15).cast("long").alias("rec_id"), F.col("a").alias("t"), (F.col("id") % 4 / 2.0).alias("score"))


def cards_learned(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long")
    frames = e.select(F.col("label").cast("long").alias("rec_id"), F.col("vec_id").alias("i"), (place * 10).alias("t"), F.col("embedding").alias("fp"))
    ends = frames.groupBy("rec_id").agg(F.max("t").alias("duration"))
    cuts = ends.select("rec_id", F.explode(F.sequence(F.lit(60).cast("long"), F.col("duration"), F.lit(200).cast("long"))).alias("a")).withColumn("b", F.col("a") + 90)
    gate = ends.select("rec_id", F.lit("ok").alias("reason"))
    rules = op.EdgeCardRules(window=30, margin=10, reach=20, padding=5, step=10, match=0.14, clear=0.05)
    cards, places = op.learned_cards(frames, cuts, gate, ends, rules, 256)
    return cards.select("rec_id", "matched", "edges", "clearance").join(places, "rec_id", "left")


MARKERS = op.MarkerRules(search=20, snap=3, run_gap=1, cost=0.04)


def _marker_edges(spark, sf_dir):
    return op.predicted_edges(_marker_hits(spark, sf_dir), _today(spark, sf_dir), _marker_events(spark, sf_dir), MARKERS, 64)


def marker_predictions(spark, sf_dir):
    return _marker_edges(spark, sf_dir)


def marker_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    some = F.array(F.struct(F.lit(0).alias("a"), (k * 37 % 300 + 100).alias("b")), F.struct((k % 400 + 300).alias("a"), (k % 400 + 380).alias("b")), F.struct((k * 37 % 300 + 2000).alias("a"), F.lit(2600).alias("b")))
    breaks = s.select(k.alias("rec_id"), F.explode(some).alias("x")).select("rec_id", F.col("x.a").cast("long").alias("a"), F.col("x.b").cast("long").alias("b")).where("rec_id % 5 > 0 OR a = 0")
    ends = s.select(k.alias("rec_id"), (k % 90 + 2600).alias("duration"), F.lit(60).alias("head_reach"), F.lit(60).alias("tail_reach"))
    return op.placed_edges(breaks, _marker_edges(spark, sf_dir), ends)


QUERIES = {f.__name__: f for f in (detect_all, detect_placed, mask_scores, mask_tiers, mask_active, mask_results, mask_readings, card_breaks, card_edges, card_added, cards_learned, marker_onsets, marker_predictions, marker_edges)}

_B = RULES.breaks


def _rel(name: str, source: str, extra: str = "") -> str:
    return f"{name} AS (SELECT rec_id, t0 - st0 AS lo, t1 - st0 AS hi{extra} FROM {source} JOIN st USING (rec_id))"


def _refine(source: str, keep: str) -> str:
    """The two edges of each bracket of ``source`` at the best event close by."""

    def edge(at: str, back: int, ahead: int, name: str) -> str:
        return (
            f"{source}_{name} AS (SELECT k.rec_id, k.id, e.t, e.score FROM {source} k JOIN rv e ON e.rec_id = k.rec_id AND e.t BETWEEN k.{at} - {back} AND k.{at} + {ahead} AND e.t BETWEEN k.lo - {RULES.slack} AND k.hi + {RULES.slack} "
            f"QUALIFY row_number() OVER (PARTITION BY k.rec_id, k.id ORDER BY round(e.score - abs(e.t - k.{at}) * {RULES.cost!r}::DOUBLE, 9) DESC, e.t, e.score) = 1)"
        )

    return f"{edge('lo', RULES.slack, RULES.search, 'x')}, {edge('hi', RULES.search, RULES.slack, 'y')}, {keep} AS (SELECT k.*, coalesce(x.t, lo) AS a, coalesce(x.score, 0) AS sa, coalesce(y.t, hi) AS b, coalesce(y.score, 0) AS sb FROM {source} k LEFT JOIN {source}_x x USING (rec_id, id) LEFT JOIN {source}_y y USING (rec_id, id))"


def _judge(source: str, keep: str) -> str:
    return (
        f"{keep} AS (SELECT rec_id, support, sa + sb AS evidence, a, b FROM (SELECT *, CASE WHEN sure THEN {_B.shortest_sure} ELSE {_B.shortest} END AS fl, lo <= {_B.edge} AS s_at, finish > 0 AND hi >= finish - {_B.edge} AS e_at FROM {source} JOIN fin USING (rec_id)) "
        f"WHERE hi - lo >= fl AND b - a >= fl AND NOT ((s_at OR e_at) AND finish > 0 AND b - a > finish * 0.5) AND NOT (b - a > {_B.longest} AND NOT (s_at OR e_at)) AND (sa > 0 OR s_at OR sb > 0 OR e_at) AND NOT (b - a < {_B.shortest} AND NOT ((sa > 0 OR s_at) AND (sb > 0 OR e_at))))"
    )


def _pick(source: str, keep: str) -> str:
    greedy = _greedy(source).replace("ranked", f"{keep}_r").replace("walk", f"{keep}_w").replace("chosen", f"{keep}_c")
    snap = RULES.end_slack
    return (
        f"{greedy}, {keep} AS (SELECT rec_id, CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a, b) = 1 AND a <= {snap} THEN 0 ELSE a END AS a, "
        f"CASE WHEN row_number() OVER (PARTITION BY rec_id ORDER BY a DESC, b DESC) = 1 AND finish > 0 AND b >= finish - {snap} THEN greatest(duration, finish) ELSE b END AS b FROM {keep}_c JOIN fin USING (rec_id))"
    )


def _agree(source: str, share: float) -> str:
    return (
        f"(SELECT x.rec_id, x.lo, x.hi, x.support FROM {source} x JOIN fin USING (rec_id) WHERE x.hi <= x.lo OR x.lo <= {RULES.mark_edge} OR x.hi >= duration - {RULES.mark_edge} "
        f"OR coalesce((SELECT sum(greatest(0, least(m.hi, x.hi) - greatest(m.lo, x.lo))) FROM marks m WHERE m.rec_id = x.rec_id), 0) <= (x.hi - x.lo) * {share})"
    )


def _free(source: str, other: str) -> str:
    return f"(SELECT x.* FROM {source} x WHERE NOT EXISTS (SELECT 1 FROM {other} o WHERE o.rec_id = x.rec_id AND least(o.hi, x.hi) - greatest(o.lo, x.lo) > 0))"


_DETECT = ", ".join([
    _BLACK, "st AS (SELECT rec_id, min(t) AS st0 FROM samples GROUP BY rec_id)", "rv AS (SELECT rec_id, t - st0 AS t, score FROM ev2 JOIN st USING (rec_id))",
    "fin AS (SELECT rec_id, max(t) - min(t) AS finish, max(t) - min(t) + 1000 AS duration FROM samples GROUP BY rec_id)",
    _runs("r1", "samples", "width >= 300", GAP, 4 * HOUR), _runs("r2", "samples", "aspect = 'view'", 2 * GAP, 4 * HOUR), _runs("r3", "samples", "width < 220", 12 * HOUR, 6 * HOUR),
    _runs("r4", "samples", "width < 300", GAP, 4 * HOUR), _runs("r5", "samples", "width < 200", GAP, 4 * HOUR), _runs("r6", "samples", "width < 25", GAP, 2 * HOUR), _runs("r7", "samples", "width >= 25", 24 * HOUR, HOUR),
    "g3 AS (SELECT * FROM (SELECT rec_id, t1 AS t0, lead(t0) OVER (PARTITION BY rec_id ORDER BY t0, t1) AS t1 FROM r3) WHERE t1 > t0 AND rec_id % 2 = 0)",
    _rel("shp", "(SELECT * FROM r1 WHERE rec_id % 3 > 0)", ", 4 AS support"), _rel("asp", "(SELECT * FROM r2 WHERE rec_id NOT IN (SELECT rec_id FROM r1 WHERE rec_id % 3 > 0))", ", 4 AS support"), _rel("anc", "g3", ", 4 AS support"),
    _rel("cor", "(SELECT *, 0 AS corner FROM r4 UNION ALL SELECT *, 1 AS corner FROM r5)", ", corner, n % 3 + 1 AS support, corner::BIGINT * 10000000000000 + t0 AS id"),
    _rel("mk0", "r7"), "fitting AS (SELECT * FROM mk0 WHERE rec_id IN (SELECT rec_id FROM mk0 JOIN fin USING (rec_id) GROUP BY rec_id, duration HAVING sum(hi - lo) / duration >= 0.25))",
    _rel("msk", "(SELECT * FROM r6 WHERE rec_id % 4 > 0 AND rec_id IN (SELECT rec_id FROM fitting))", ", 4 AS support"), "marks AS (SELECT * FROM fitting WHERE rec_id IN (SELECT rec_id FROM msk))",
    _refine("cor", "cr"),
    f"le AS (SELECT rec_id, corner FROM (SELECT s.rec_id, c.corner, avg((width >= c.bound)::INT::DOUBLE) AS share FROM samples s, (VALUES (0, 300), (1, 200)) c(corner, bound) GROUP BY ALL) LEFT JOIN (SELECT rec_id, corner, round(sum(sa + sb), 6) AS ev FROM cr WHERE b - a BETWEEN {_B.shortest} AND {_B.longest} GROUP BY ALL) USING (rec_id, corner) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY share >= 0.5 DESC, coalesce(ev, 0) DESC, corner) = 1)",
    "lg0 AS (SELECT c.rec_id, lo, hi, support FROM cor c JOIN le USING (rec_id, corner))", f"lg AS {_agree('lg0', RULES.agree)}",
    f"m1 AS {_free('msk', 'lg')}", f"m2 AS {_free('m1', 'anc')}", f"alone AS {_agree('m2', RULES.self_agree)}", f"sh2 AS {_free('shp', 'anc')}",
    "pool0 AS (SELECT rec_id, lo, hi, support FROM lg UNION SELECT rec_id, lo, hi, support FROM alone UNION SELECT rec_id, lo, hi, support FROM sh2 UNION SELECT rec_id, lo, hi, support FROM asp UNION SELECT rec_id, lo, hi, support FROM anc)",
    "pool AS (SELECT *, row_number() OVER () AS id, (rec_id, lo, hi) IN (SELECT (rec_id, lo, hi) FROM alone) AS sure FROM pool0)", _refine("pool", "pr"), _judge("pr", "pj"), _pick("pj", "pk"),
    f"sg AS (SELECT DISTINCT rec_id, t FROM rv WHERE score >= {RULES.strong})",
    f"dp AS (SELECT x.rec_id, x.t AS lo, y.t AS hi FROM sg x JOIN sg y ON x.rec_id = y.rec_id AND y.t - x.t BETWEEN {_B.shortest} AND {_B.longest} WHERE x.rec_id NOT IN (SELECT rec_id FROM pk))",
    f"dq AS (SELECT rec_id, lo, hi, 4 AS support FROM dp WHERE round(coalesce((SELECT sum(score) FROM rv e WHERE e.rec_id = dp.rec_id AND e.t > lo AND e.t < hi), 0), 6) / (hi - lo) >= {RULES.density!r}::DOUBLE)",
    "po2 AS (SELECT *, row_number() OVER () AS id, false AS sure FROM (SELECT * FROM pool0 WHERE rec_id IN (SELECT rec_id FROM dq) UNION SELECT * FROM dq))", _refine("po2", "qr"), _judge("qr", "qj"), _pick("qj", "qk"),
    "fo AS (SELECT * FROM pk UNION ALL SELECT * FROM qk)",
    f"sw AS (SELECT rec_id, duration FROM fin JOIN (SELECT rec_id, max(b) AS last FROM fo GROUP BY rec_id) USING (rec_id) WHERE duration - last > {RULES.tail})",
    f"tl AS (SELECT k.rec_id, fo.a AS start, sw.duration FROM (SELECT rec_id, lo, hi, 0 AS o FROM shp UNION ALL SELECT rec_id, lo, hi, 1 FROM asp) k JOIN sw USING (rec_id) JOIN fo ON fo.rec_id = k.rec_id AND abs(k.lo - fo.a) <= {RULES.near} WHERE k.hi >= duration - {RULES.tail} QUALIFY row_number() OVER (PARTITION BY k.rec_id ORDER BY k.o, k.lo, k.hi, fo.a) = 1)",
])
_TRACK = "tk AS (SELECT rec_id, i, t - min(t) OVER (PARTITION BY rec_id) AS t, width / 500.0::DOUBLE AS v FROM samples)"
_REC = "rc AS (SELECT l_suppkey AS key, l_linenumber::BIGINT AS model, l_partkey % 5 AS project, round(max(l_discount), 4) AS good, CAST(count(*) FILTER (l_tax > 0.07) AS BIGINT) AS bad, max(l_quantity) > 40 AS fit FROM lineitem GROUP BY ALL)"
_MASKS = "ma AS (SELECT s_suppkey AS key, unnest(generate_series(1, s_suppkey % 4 + 5)) AS model FROM supplier), ms AS (SELECT key, model, 9 - model AS place, model = key % 3 + 1 AS current FROM ma)"
_TIERS = f"{_REC}, {_MASKS}, ti AS (SELECT ms.key, ms.model, place, current, CASE WHEN fit IS NULL THEN 1 WHEN fit THEN 2 ELSE 0 END AS tier, coalesce(projects, 0) AS projects FROM ms LEFT JOIN (SELECT key, model, bool_or(fit) AS fit, count(DISTINCT project) AS projects FROM rc GROUP BY ALL) USING (key, model))"
_BEATS = "pa AS (SELECT a.key, a.model, b.model AS other, sum(a.bad) AS f1, sum(b.bad) AS f2, sum(a.good) AS g1, sum(b.good) AS g2, count(*) AS n FROM rc a JOIN rc b ON a.key = b.key AND a.project = b.project AND a.model <> b.model GROUP BY ALL), be AS (SELECT key, model, list(other) AS beaten FROM pa WHERE f1 < f2 OR (f1 = f2 AND round(g1 - g2, 9) > round(n * 0.01::DOUBLE, 9)) GROUP BY ALL)"
_SIGHT = "si AS (SELECT rec_id, id, a AS t0, a + id % 6 AS t1, CASE WHEN id % 5 > 0 THEN id % 3 - 1 END AS so, CASE WHEN id % 5 > 0 THEN id % 3 / 4.0 END AS ss, CASE WHEN id % 7 > 0 THEN id % 4 - 2 END AS eo, CASE WHEN id % 7 > 0 THEN id % 5 / 8.0 END AS es FROM cuts), fd AS (SELECT rec_id, a // 120 * 120 AS a, a // 120 * 120 + max(id % 60 + 15) AS b FROM cuts WHERE id % 9 = 0 GROUP BY rec_id, a // 120)"


def _place(edge: str, at: str, off: str, spread: str, order: str, name: str, c: op.CardRules = CARDS, scenes: str = "(SELECT rec_id, b AS t FROM cuts WHERE id % 2 = 0)") -> str:
    return (
        f"{name}0 AS (SELECT n.rec_id, n.k, s.{at} - s.{off} AS pos FROM nb n JOIN si s ON s.rec_id = n.rec_id AND abs(s.{at} - n.{edge}) <= {c.reach} WHERE s.{spread} <= {c.spread} QUALIFY row_number() OVER (PARTITION BY n.rec_id, n.k ORDER BY s.{at} {order}, s.id) = 1), "
        f"{name} AS (SELECT rec_id, k, coalesce((SELECT t FROM {scenes} c WHERE c.rec_id = z.rec_id AND abs(c.t - z.pos) <= {c.snap} ORDER BY abs(c.t - z.pos), c.t LIMIT 1), pos) AS v FROM {name}0 z)"
    )




def _moved(c: op.CardRules) -> tuple[str, str]:
    """The new edges of break ``x`` behind one that ends at ``w.pe``."""
    a, b = (f"(CASE WHEN {inward} > {c.shrink} THEN x.{old} ELSE x.{new} END)" for inward, old, new in (("x.na - x.a", "a", "na"), ("x.b - x.nb", "b", "nb")))
    new_a = f"CASE WHEN {a} < w.pe OR {b} - {a} < {c.least} THEN x.a ELSE {a} END"
    return new_a, f"CASE WHEN {b} > coalesce(x.nx, 9000000000000000) OR {b} - ({new_a}) < {c.least} THEN x.b ELSE {b} END"


def _card_breaks(c: op.CardRules, breaks: str, out: str) -> str:
    """Breaks that the sightings ``si`` open and close, where ``breaks`` has none."""
    return (
        f"eg AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t0, t1, id) AS n FROM si WHERE ss <= {c.spread} AND es <= {c.spread} AND t1 - t0 >= {c.run}), nx AS (SELECT x.rec_id, x.n, x.t0 - x.so AS a, y.t1 - y.eo AS b, y.n AS till FROM eg x JOIN eg y ON y.rec_id = x.rec_id AND y.n > x.n AND y.t1 - x.t0 BETWEEN {c.shortest} AND {c.longest} QUALIFY row_number() OVER (PARTITION BY x.rec_id, x.n ORDER BY y.t1 DESC, y.n) = 1), "
        f"wc AS (SELECT rec_id, min(n) AS n FROM nx GROUP BY rec_id UNION ALL SELECT w.rec_id, (SELECT min(z.n) FROM nx z WHERE z.rec_id = w.rec_id AND z.n > c.till) FROM wc w JOIN nx c ON c.rec_id = w.rec_id AND c.n = w.n WHERE (SELECT min(z.n) FROM nx z WHERE z.rec_id = w.rec_id AND z.n > c.till) IS NOT NULL), "
        f"{out} AS (SELECT nx.rec_id, a, b FROM wc JOIN nx USING (rec_id, n) WHERE NOT EXISTS (SELECT 1 FROM {breaks} fd WHERE fd.rec_id = nx.rec_id AND least(fd.b, nx.b) - greatest(fd.a, nx.a) > 0))"
    )


def _card_edges(c: op.CardRules, breaks: str, scenes: str, out: str) -> str:
    new_a, new_b = _moved(c)
    return (
        f"nb AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY a, b) AS k, lead(a) OVER (PARTITION BY rec_id ORDER BY a, b) AS nx FROM {breaks}), {_place('a', 't0', 'so', 'ss', 'ASC', 'pa', c, scenes)}, {_place('b', 't1', 'eo', 'es', 'DESC', 'pb', c, scenes)}, rw AS (SELECT nb.*, coalesce(pa.v, a) AS na, coalesce(pb.v, b) AS nb FROM nb LEFT JOIN pa USING (rec_id, k) LEFT JOIN pb USING (rec_id, k)), "
        f"we AS (SELECT DISTINCT rec_id, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS pe, 0::BIGINT AS moved FROM rw UNION ALL SELECT x.rec_id, x.k, {new_a}, {new_b}, {new_b}, (({new_a}) <> x.a)::BIGINT + (({new_b}) <> x.b)::BIGINT FROM we w JOIN rw x ON x.rec_id = w.rec_id AND x.k = w.k + 1), {out} AS (SELECT rec_id, a, b, moved FROM we WHERE k > 0)"
    )


_SCENES = "(SELECT rec_id, b AS t FROM cuts WHERE id % 2 = 0)"
_MARKERS = (
    "hi AS (SELECT l_suppkey AS rec_id, l_linenumber % 2 AS side, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, l_partkey % 4 AS project, l_orderkey % 13 - 6 AS off FROM lineitem), "
    "se AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id, side ORDER BY t) <= 1 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT rec_id, side, t FROM hi)), fi AS (SELECT rec_id, side, min(t) AS t FROM (SELECT *, sum(new) OVER (PARTITION BY rec_id, side ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM se) GROUP BY rec_id, side, run), "
    "us AS (SELECT rec_id, side, t, t - median(off) AS pat FROM (SELECT rec_id, side, t, project, min(off) AS off FROM hi JOIN fi USING (rec_id, side, t) GROUP BY ALL) GROUP BY rec_id, side, t), "
    "td AS (SELECT s_suppkey AS rec_id, side, s_suppkey * 37 % 300 + 100 + side * 1900 AS today FROM supplier, (SELECT unnest([0, 1]) AS side)), "
    "nr AS (SELECT rec_id, side, pat AS predicted FROM us JOIN td USING (rec_id, side) WHERE abs(pat - today) <= 20 QUALIFY row_number() OVER (PARTITION BY rec_id, side ORDER BY abs(pat - today), t) = 1), "
    "me AS (SELECT rec_id // 15 AS rec_id, a AS t, id % 4 / 2.0 AS score FROM cuts WHERE id % 3 = 0), "
    "ed AS (SELECT rec_id, side::BIGINT AS side, coalesce((SELECT t FROM me WHERE me.rec_id = nr.rec_id AND abs(t - predicted) <= 3 ORDER BY round(score - abs(t - predicted) * 0.04::DOUBLE, 9) DESC, t LIMIT 1), predicted)::DOUBLE AS edge, predicted::DOUBLE AS predicted FROM nr)"
)
_ALL = "SELECT fo.rec_id, fo.a, CASE WHEN fo.a = start THEN tl.duration ELSE fo.b END AS b FROM fo LEFT JOIN tl USING (rec_id) WHERE start IS NULL OR fo.a <= start"
_M, _H = PLACED_MARKERS, HOUR
_PLACED = ", ".join([
    _DETECT, f"b0 AS ({_ALL})", "sm AS (SELECT rec_id, i, t - st0 AS t, width, aspect FROM samples JOIN st USING (rec_id))",
    f"si AS (SELECT rec_id, i AS id, t AS t0, t + width % 6 * {_H} AS t1, CASE WHEN i % 5 > 0 THEN (i % 3 - 1) * {_H} END AS so, CASE WHEN i % 5 > 0 THEN i % 3 / 4.0 END AS ss, CASE WHEN i % 7 > 0 THEN (i % 4 - 2) * {_H} END AS eo, CASE WHEN i % 7 > 0 THEN i % 5 / 8.0 END AS es FROM sm WHERE aspect = 'purchase')",
    "sc AS (SELECT s.rec_id, t0 - st0 AS t FROM signals s JOIN st USING (rec_id) WHERE kind = 'scene')", _card_breaks(PLACED_CARDS, "b0", "cb"), "b1 AS (SELECT * FROM b0 UNION ALL SELECT * FROM cb)", _card_edges(PLACED_CARDS, "b1", "sc", "b2"),
    f"hd AS (SELECT rec_id, a, b FROM b2 WHERE a <= {60 * _H} QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY b DESC, a) = 1)", f"ta AS (SELECT rec_id, a, b FROM (SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY a DESC, b DESC) = 1) JOIN fin USING (rec_id) WHERE duration - b <= {24 * _H})",
    "ht AS (SELECT rec_id FROM hd JOIN ta USING (rec_id, a, b))", "td AS (SELECT rec_id, 0 AS side, b AS today FROM hd WHERE rec_id NOT IN (SELECT rec_id FROM ht) UNION ALL SELECT rec_id, 1, a FROM ta WHERE rec_id NOT IN (SELECT rec_id FROM ht))",
    "fr AS (SELECT rec_id, i, t, width % 100 AS x, i % 50 AS y, width * 7 % 90 AS z FROM sm)", f"mr AS (SELECT i % 2 AS side, rec_id AS project, (i % 7 - 3) * {_H} AS off, x, y, z FROM fr WHERE rec_id % 10 = 0 AND i % 11 < 4)",
    f"hi AS (SELECT f.rec_id, td.side, f.t, m.project, m.off FROM fr f JOIN td ON td.rec_id = f.rec_id AND abs(f.t - td.today) <= {30 * _H} JOIN mr m ON m.side = td.side AND m.project <> f.rec_id WHERE (abs(f.x - m.x) + abs(f.y - m.y) + abs(f.z - m.z)) / 3.0::DOUBLE < {NEAR})",
    f"se AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id, side ORDER BY t) <= {_M.run_gap} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT rec_id, side, t FROM hi))", "fi AS (SELECT rec_id, side, min(t) AS t FROM (SELECT *, sum(new) OVER (PARTITION BY rec_id, side ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM se) GROUP BY rec_id, side, run)",
    "us AS (SELECT rec_id, side, t, t - median(off) AS pat FROM (SELECT rec_id, side, t, project, min(off) AS off FROM hi JOIN fi USING (rec_id, side, t) GROUP BY ALL) GROUP BY rec_id, side, t)",
    f"nr AS (SELECT rec_id, side, pat AS predicted FROM us JOIN td USING (rec_id, side) WHERE abs(pat - today) <= {_M.search} QUALIFY row_number() OVER (PARTITION BY rec_id, side ORDER BY abs(pat - today), t) = 1)",
    f"ed AS (SELECT rec_id, side, coalesce((SELECT t FROM rv WHERE rv.rec_id = nr.rec_id AND abs(t - predicted) <= {_M.snap} ORDER BY round(score - abs(t - predicted) * {_M.cost!r}::DOUBLE, 9) DESC, t LIMIT 1), predicted)::DOUBLE AS edge FROM nr)",
    "e0 AS (SELECT b2.rec_id, b2.a, b2.b, row_number() OVER w AS n, lead(b2.a) OVER w AS behind, lag(b2.b) OVER w AS ahead, duration, hd.a AS ha, hd.b AS hb, ta.a AS xa, ta.b AS xb, (SELECT edge FROM ed WHERE ed.rec_id = b2.rec_id AND side = 0) AS es, (SELECT edge FROM ed WHERE ed.rec_id = b2.rec_id AND side = 1) AS ee FROM b2 JOIN fin USING (rec_id) LEFT JOIN hd USING (rec_id) LEFT JOIN ta USING (rec_id) WINDOW w AS (PARTITION BY b2.rec_id ORDER BY b2.a, b2.b))",
    "e1 AS (SELECT *, CASE WHEN a = ha AND b = hb AND es > a AND es < coalesce(behind, duration) THEN es ELSE b END::DOUBLE AS nb FROM e0)",
    "e2 AS (SELECT rec_id, CASE WHEN a = xa AND b = xb AND ee > coalesce(lag(nb) OVER (PARTITION BY rec_id ORDER BY n), 0) AND ee < b THEN ee ELSE a END::DOUBLE AS a, nb AS b FROM e1)",
])
ORACLES = {
    "detect_all": with_tables("signals samples", f"WITH {_DETECT} {_ALL}").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "detect_placed": with_tables("signals samples", f"WITH {_PLACED} SELECT * FROM e2").replace("WITH ev AS", "WITH RECURSIVE ev AS"),
    "mask_readings": "WITH f AS (SELECT label::BIGINT AS rec_id, vec_id AS i, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 400) AS BIGINT) % 256) AS v FROM embeddings), "
        "m AS (SELECT DISTINCT rec_id, CAST(round_even(rec_id % 2 + px / 4.0::DOUBLE * 6, 0) AS BIGINT) AS x, CAST(round_even(1 + py / 4.0::DOUBLE * 5, 0) AS BIGINT) AS y FROM (SELECT DISTINCT rec_id FROM f), (SELECT unnest(range(3)) AS px), (SELECT unnest([1, 2]) AS py) WHERE px >= rec_id % 3), "
        "b AS (SELECT rec_id, min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM m WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 6 GROUP BY rec_id), "
        "p AS (SELECT b.rec_id, x, y, (b.rec_id, x, y) IN (SELECT (rec_id, x, y) FROM m) AS inside FROM b, (SELECT unnest(range(7)) AS x), (SELECT unnest(range(7)) AS y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), "
        "c AS (SELECT f.rec_id, i, inside, (abs(v[y * 8 + x + 2] - v[y * 8 + x + 1]) + abs(v[y * 8 + x + 9] - v[y * 8 + x + 1]) > 18)::INT AS edge, v[y * 8 + x + 1] AS l FROM f JOIN p USING (rec_id)) "
        "SELECT rec_id, i, round(avg(edge) FILTER (inside) - avg(edge) FILTER (NOT inside), 6) AS edges, round(avg(l) FILTER (inside) - avg(l) FILTER (NOT inside), 6) AS light FROM c GROUP BY rec_id, i",
    "marker_onsets": "WITH RECURSIVE f AS (SELECT label::BIGINT AS rec_id, vec_id % 3 AS place, vec_id AS i, vec_id % 11 = 0 AS known, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 400) AS BIGINT) % 256) AS fp FROM embeddings), "
        "n AS (SELECT *, known OR list_sum(fp) / 64.0::DOUBLE < 31 AS none, row_number() OVER (PARTITION BY rec_id, place ORDER BY i) AS r FROM f), "
        "w AS (SELECT rec_id, place, r, i, NOT none AS kept, CASE WHEN none THEN NULL ELSE fp END AS last FROM n WHERE r = 1 UNION ALL "
        "SELECT n.rec_id, n.place, n.r, n.i, NOT none AND (w.last IS NULL OR list_sum(list_transform(list_zip(n.fp, w.last), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE >= 32), CASE WHEN none THEN NULL WHEN w.last IS NULL OR list_sum(list_transform(list_zip(n.fp, w.last), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE >= 32 THEN n.fp ELSE w.last END FROM w JOIN n ON n.rec_id = w.rec_id AND n.place = w.place AND n.r = w.r + 1) "
        "SELECT rec_id, place, i, i / 2.0::DOUBLE AS offset FROM w WHERE kept QUALIFY row_number() OVER (PARTITION BY rec_id, place ORDER BY i) <= 12",
    "mask_scores": with_tables("samples", f"WITH {_TRACK}, en AS (SELECT rec_id, max(t) AS duration FROM tk GROUP BY rec_id), ct AS (SELECT rec_id, t AS a, t + i % 11 * {6 * HOUR} AS b FROM tk WHERE i % 23 = 5), {_runs('mk', 'tk', 'v > 0.3', 8 * HOUR, 4 * HOUR)}, {_runs('aw', 'tk', 'NOT v > 0.3', 16 * HOUR, 12 * HOUR)}, "
        f"pg AS (SELECT rec_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM mk WHERE mk.rec_id = tk.rec_id AND tk.t >= t0 AND tk.t < t1) THEN 1.0 ELSE 0.0 END), 6) AS prog FROM tk WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.rec_id = tk.rec_id AND ((tk.t >= a AND tk.t < b) OR abs(tk.t - a) <= {3 * HOUR} OR abs(tk.t - b) <= {3 * HOUR})) GROUP BY rec_id), "
        f"fa AS (SELECT aw.rec_id, count(*) AS n FROM aw JOIN en USING (rec_id) WHERE t0 > {24 * HOUR} AND t1 < duration - {24 * HOUR} AND coalesce((SELECT sum(greatest(0, least(mk.t1, aw.t1) - greatest(mk.t0, aw.t0))) FROM mk WHERE mk.rec_id = aw.rec_id), 0) <= (t1 - t0) * 0.5 AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.rec_id = aw.rec_id AND least(b, t1) - greatest(a, t0) > 0) GROUP BY aw.rec_id) "
        "SELECT en.rec_id, coalesce(prog, 0) AS prog, coalesce(n, 0) AS \"false\", duration > 0 AND coalesce((SELECT sum(t1 - t0) FROM mk WHERE mk.rec_id = en.rec_id), 0) / duration >= 0.25 AS fitted FROM en LEFT JOIN pg USING (rec_id) LEFT JOIN fa USING (rec_id)"),
    "mask_tiers": f"WITH {_TIERS} SELECT key, model, place, tier, projects FROM ti",
    "mask_active": f"WITH RECURSIVE {_TIERS}, {_BEATS}, rk AS (SELECT ti.*, coalesce(beaten, []) AS beaten, row_number() OVER (PARTITION BY key ORDER BY place) AS r FROM ti LEFT JOIN be USING (key, model)), cu AS (SELECT key, coalesce(min(r) FILTER (current), 1) AS c FROM rk GROUP BY key), "
        "wk AS (SELECT key, 0::BIGINT AS r, c AS best, tier AS bt, model AS bm FROM cu JOIN rk USING (key) WHERE rk.r = c UNION ALL SELECT w.key, x.r, CASE WHEN x.r <> w.best AND (x.tier > w.bt OR (x.tier = w.bt AND list_contains(x.beaten, w.bm))) THEN x.r ELSE w.best END, CASE WHEN x.r <> w.best AND (x.tier > w.bt OR (x.tier = w.bt AND list_contains(x.beaten, w.bm))) THEN x.tier ELSE w.bt END, CASE WHEN x.r <> w.best AND (x.tier > w.bt OR (x.tier = w.bt AND list_contains(x.beaten, w.bm))) THEN x.model ELSE w.bm END FROM wk w JOIN rk x ON x.key = w.key AND x.r = w.r + 1), "
        "fn AS (SELECT key, best FROM wk QUALIFY r = max(r) OVER (PARTITION BY key)) SELECT key, model, place, r = best AS used, r = best OR row_number() OVER (PARTITION BY key, r = best ORDER BY tier, projects, r DESC) > count(*) OVER (PARTITION BY key) - 4 AS kept FROM rk JOIN fn USING (key)",
    "mask_results": f"WITH {_REC}, {_MASKS}, r AS (SELECT key, model, 'p' || project AS project, good, bad, fit, model * 10 + 2 AS o FROM rc), n AS (SELECT key, model, CASE WHEN key % 2 = 0 THEN project || 'x' ELSE project END AS project, good, bad, fit, o + 100 AS o FROM r WHERE bad = 0 AND key % 7 > 0 AND (key, model) IN (SELECT (key, model) FROM ms)), u AS (SELECT *, 0 AS fr FROM r UNION ALL SELECT *, 1 FROM n), f AS (SELECT key, model, project, max({{'fr': fr, 'o': o, 'good': good, 'bad': bad, 'fit': fit}}) AS x, min({{'fr': fr, 'o': o}}) AS fi FROM u GROUP BY key, model, project) SELECT key, model, project, x.good AS good, x.bad AS \"false\", x.fit AS fit, fi.o AS \"order\" FROM f QUALIFY row_number() OVER (PARTITION BY key, model ORDER BY fi DESC, project) <= 4",
    "card_breaks": with_tables("cuts", f"WITH {_SIGHT}, {_card_breaks(CARDS, 'fd', 'cb')} SELECT * FROM cb").replace("WITH cuts", "WITH RECURSIVE cuts"),
    "card_edges": with_tables("cuts", f"WITH {_SIGHT}, {_card_edges(CARDS, 'fd', _SCENES, 'ce')} SELECT * FROM ce").replace("WITH cuts", "WITH RECURSIVE cuts"),
    "card_added": "WITH e AS (SELECT label::BIGINT AS key, vec_id AS o, embedding AS fp FROM embeddings), n AS (SELECT * FROM e QUALIFY o = max(o) OVER (PARTITION BY key)), k AS (SELECT e.key, e.o FROM e JOIN n USING (key) WHERE e.o = n.o OR list_sum(list_transform(list_zip(e.fp, n.fp), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 64 >= 0.13) SELECT key, o AS \"order\" FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY o DESC) <= 5",
    "marker_predictions": with_tables("cuts", f"WITH {_MARKERS} SELECT * FROM ed"),
    "marker_edges": with_tables("cuts", f"WITH {_MARKERS}, b0 AS (SELECT s_suppkey AS rec_id, unnest([{{'a': 0, 'b': s_suppkey * 37 % 300 + 100}}, {{'a': s_suppkey % 400 + 300, 'b': s_suppkey % 400 + 380}}, {{'a': s_suppkey * 37 % 300 + 2000, 'b': 2600}}]) AS x FROM supplier), b1 AS (SELECT rec_id, x.a AS a, x.b AS b FROM b0 WHERE rec_id % 5 > 0 OR x.a = 0), b2 AS (SELECT *, row_number() OVER w AS n, lead(a) OVER w AS behind, rec_id % 90 + 2600 AS duration, count(*) OVER (PARTITION BY rec_id) AS last FROM b1 WINDOW w AS (PARTITION BY rec_id ORDER BY a, b)), b3 AS (SELECT *, min(CASE WHEN a <= 60 THEN n END) OVER (PARTITION BY rec_id) AS head, max(CASE WHEN n = last AND duration - b <= 60 THEN n END) OVER (PARTITION BY rec_id) AS tail FROM b2), b4 AS (SELECT *, (SELECT edge FROM ed WHERE ed.rec_id = b3.rec_id AND side = 0) AS es, (SELECT edge FROM ed WHERE ed.rec_id = b3.rec_id AND side = 1) AS ee FROM b3), b5 AS (SELECT *, CASE WHEN head IS DISTINCT FROM tail AND n = head AND es > a AND es < coalesce(behind, duration) THEN es ELSE b END::DOUBLE AS nb FROM b4) SELECT rec_id, CASE WHEN head IS DISTINCT FROM tail AND n = tail AND ee > coalesce(lag(nb) OVER (PARTITION BY rec_id ORDER BY n), 0) AND ee < b THEN ee ELSE a END::DOUBLE AS a, nb AS b FROM b5"),
}
