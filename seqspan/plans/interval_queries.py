"""Registered queries over ranges, cuts and markers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import intervals as op
from . import adapters as src
from .adapters import with_tables

DURATION = 2600


def _line(spark, sf_dir, *lines):
    return src.ranges(spark, sf_dir).where(F.col("line").isin(*lines)).select("rec_id", "start_f", "end_f")


def _first(spark, sf_dir):
    return op.union(_line(spark, sf_dir, 1))


def _durations(spark, sf_dir):
    c = src.cuts(spark, sf_dir).groupBy("rec_id").agg(F.max("b").alias("m"))
    return c.select("rec_id", (F.col("m") * (F.col("rec_id") % 3 + 1) - F.col("rec_id") % 7).alias("duration"))


def range_union(spark, sf_dir):
    return op.union(src.ranges(spark, sf_dir))


def range_intersect(spark, sf_dir):
    return op.intersect(_first(spark, sf_dir), op.union(_line(spark, sf_dir, 2, 3)))


def range_subtract(spark, sf_dir):
    return op.subtract(_first(spark, sf_dir), _line(spark, sf_dir, 2, 3))


def _bounds(spark, sf_dir):
    return src.ranges(spark, sf_dir).select("rec_id").distinct().withColumn("n", F.lit(2000).cast("long"))


def range_complement(spark, sf_dir):
    return op.complement(_line(spark, sf_dir, 1, 2), _bounds(spark, sf_dir))


def _spans(spark, sf_dir):
    return src.ranges(spark, sf_dir).where("line = 7").groupBy("rec_id").agg(F.min("start_f").alias("start_f"), F.min(F.col("start_f") + 40).alias("end_f"))


def range_commit(spark, sf_dir):
    return op.commit(_first(spark, sf_dir), _spans(spark, sf_dir))


def range_replace(spark, sf_dir):
    return op.replace_cuts(_first(spark, sf_dir), _line(spark, sf_dir, 4), _line(spark, sf_dir, 5))


def _points(spark, sf_dir):
    return src.ranges(spark, sf_dir).where("line = 6").select("rec_id", "id", F.col("end_f").alias("at")).distinct()


def point_in_range(spark, sf_dir):
    return op.containing(_points(spark, sf_dir), _first(spark, sf_dir))


def remove_ranges(spark, sf_dir):
    numbers = src.ranges(spark, sf_dir).where("line = 2").select("rec_id", (F.col("id") % 50).alias("range_no"))
    return op.remove_numbered(_first(spark, sf_dir), numbers)


def marker_nav(spark, sf_dir):
    return op.neighbours(src.markers(spark, sf_dir), _points(spark, sf_dir))


def marker_toggle(spark, sf_dir):
    return op.toggled(src.markers(spark, sf_dir), _points(spark, sf_dir).select("rec_id", F.col("at").alias("frame")))


def mismatch_audit(spark, sf_dir):
    return op.mismatch(src.cuts(spark, sf_dir), _durations(spark, sf_dir))


def split_padding(spark, sf_dir):
    return op.split_padding(src.cuts(spark, sf_dir), _durations(spark, sf_dir))


def learnable_gate(spark, sf_dir):
    return op.learnable(split_padding(spark, sf_dir), _durations(spark, sf_dir), 0, 29, 0.05)


def edit_log(spark, sf_dir):
    r = src.ranges(spark, sf_dir).withColumn("rec_id", F.floor(F.col("id") / 25).cast("long"))
    action = F.when(F.col("id") % 11 == 3, "undo").when(F.col("id") % 11 == 5, "redo").when(F.col("line") % 2 == 0, "remove").otherwise("add")
    seq = F.row_number().over(W.partitionBy("rec_id").orderBy("id", "line", "start_f", "end_f")).cast("long")
    return op.edit_log(r.select("rec_id", seq.alias("seq"), action.alias("action"), "start_f", (F.col("end_f") + 20).alias("end_f")))


QUERIES = {f.__name__: f for f in (range_union, range_intersect, range_subtract, range_complement, range_commit, range_replace, point_in_range, remove_ranges, marker_nav, marker_toggle, mismatch_audit, split_padding, learnable_gate, edit_log)}


def _islands(name: str, source: str) -> str:
    return (
        f"{name}_m AS (SELECT rec_id, start_f, end_f, CASE WHEN start_f > 1 + max(end_f) OVER (PARTITION BY rec_id ORDER BY start_f, end_f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {source}), "
        f"{name} AS (SELECT rec_id, min(start_f) AS start_f, max(end_f) AS end_f FROM (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY start_f, end_f ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m) GROUP BY rec_id, g)"
    )


def _lines(*lines: int) -> str:
    return f"(SELECT rec_id, start_f, end_f FROM ranges WHERE line IN ({', '.join(map(str, lines))}))"


# day by day: a frame is kept or it isn't, and runs of frames are ranges
def _days(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT rec_id, unnest(generate_series(start_f, end_f)) AS d FROM {source})"


def _runs(source: str) -> str:
    return f"SELECT rec_id, min(d) AS start_f, max(d) AS end_f FROM (SELECT rec_id, d, d - row_number() OVER (PARTITION BY rec_id ORDER BY d) AS g FROM {source}) GROUP BY rec_id, g"


_DUR = "dur AS (SELECT rec_id, m * (rec_id % 3 + 1) - rec_id % 7 AS duration FROM (SELECT rec_id, max(b) AS m FROM cuts GROUP BY rec_id))"
_SPLIT = "split AS (SELECT c.rec_id, c.id, c.a, c.b, CASE WHEN c.a <= 5 OR c.b >= greatest(l.last, d.duration) - 5 THEN 'padding' ELSE 'advert' END AS kind FROM cuts c JOIN (SELECT rec_id, max(b) AS last FROM cuts GROUP BY rec_id) l USING (rec_id) JOIN dur d USING (rec_id))"
_POINTS = "points AS (SELECT DISTINCT rec_id, id, end_f AS pos FROM ranges WHERE line = 6)"
_FIRST = _islands("firsts", _lines(1))
#: The log as a recursion over lists: the ranges, and the states before and after that undo and redo go back to.
_EDITS = (
    "lg AS (SELECT id // 25 AS rec_id, row_number() OVER (PARTITION BY id // 25 ORDER BY id, line, start_f, end_f) AS r, CASE WHEN id % 11 = 3 THEN 'undo' WHEN id % 11 = 5 THEN 'redo' WHEN line % 2 = 0 THEN 'remove' ELSE 'add' END AS act, start_f AS s, end_f + 20 AS e FROM ranges), "
    "wk AS (SELECT rec_id, 0::BIGINT AS r, []::STRUCT(a BIGINT, b BIGINT)[] AS now, []::STRUCT(a BIGINT, b BIGINT)[][] AS un, []::STRUCT(a BIGINT, b BIGINT)[][] AS re FROM (SELECT DISTINCT rec_id FROM lg) UNION ALL "
    "SELECT rec_id, r, CASE act WHEN 'undo' THEN coalesce(un[-1], now) WHEN 'redo' THEN coalesce(re[-1], now) ELSE new END, "
    "CASE act WHEN 'undo' THEN un[:-2] WHEN 'redo' THEN CASE WHEN len(re) > 0 THEN list_append(un, now) ELSE un END ELSE CASE WHEN new = now THEN un ELSE list_append(un, now) END END, "
    "CASE act WHEN 'undo' THEN CASE WHEN len(un) > 0 THEN list_append(re, now) ELSE re END WHEN 'redo' THEN re[:-2] ELSE CASE WHEN new = now THEN re ELSE [] END END FROM ("
    "SELECT w.rec_id, l.r, l.act, w.now, w.un, w.re, list_sort(CASE WHEN l.act = 'add' THEN list_append(list_filter(w.now, lambda x: x.b < l.s - 1 OR x.a > l.e + 1), {'a': least(l.s, list_min(list_transform(list_filter(w.now, lambda x: NOT (x.b < l.s - 1 OR x.a > l.e + 1)), lambda x: x.a))), 'b': greatest(l.e, list_max(list_transform(list_filter(w.now, lambda x: NOT (x.b < l.s - 1 OR x.a > l.e + 1)), lambda x: x.b)))}) "
    "ELSE list_concat(list_filter(w.now, lambda x: x.b < l.s OR x.a > l.e), list_concat(list_transform(list_filter(w.now, lambda x: NOT (x.b < l.s OR x.a > l.e) AND x.a < l.s), lambda x: {'a': x.a, 'b': l.s - 1}), list_transform(list_filter(w.now, lambda x: NOT (x.b < l.s OR x.a > l.e) AND x.b > l.e), lambda x: {'a': l.e + 1, 'b': x.b}))) END) AS new "
    "FROM wk w JOIN lg l ON l.rec_id = w.rec_id AND l.r = w.r + 1))"
)
ORACLES = {
    "edit_log": with_tables("ranges", f"WITH {_EDITS} SELECT rec_id, array_to_string(list_transform(now, lambda x: x.a || '-' || x.b), ',') AS ranges, len(un) AS undos, len(re) AS redos FROM wk QUALIFY r = max(r) OVER (PARTITION BY rec_id)").replace("WITH ranges", "WITH RECURSIVE ranges"),
    "range_union": with_tables("ranges", f"WITH {_islands('u', 'ranges')} SELECT * FROM u"),
    "range_intersect": with_tables("ranges", f"WITH {_FIRST}, {_islands('other', _lines(2, 3))} SELECT a.rec_id, greatest(a.start_f, b.start_f) AS start_f, least(a.end_f, b.end_f) AS end_f FROM firsts a JOIN other b ON a.rec_id = b.rec_id AND a.start_f <= b.end_f AND b.start_f <= a.end_f"),
    "range_subtract": with_tables("ranges", f"WITH {_days('x', _lines(1))}, {_days('y', _lines(2, 3))}, z AS (SELECT * FROM x EXCEPT SELECT * FROM y) {_runs('z')}"),
    "range_complement": with_tables("ranges", f"WITH {_days('y', _lines(1, 2))}, x AS (SELECT rec_id, unnest(generate_series(0, 1999)) AS d FROM (SELECT DISTINCT rec_id FROM ranges)), z AS (SELECT * FROM x EXCEPT SELECT * FROM y) {_runs('z')}"),
    "range_commit": with_tables("ranges", f"WITH {_FIRST}, span AS (SELECT rec_id, min(start_f) AS s, min(start_f) + 40 AS e FROM ranges WHERE line = 7 GROUP BY rec_id), hit AS (SELECT f.* FROM firsts f JOIN span USING (rec_id) WHERE start_f <= e AND end_f >= s), added AS (SELECT * FROM firsts EXCEPT SELECT * FROM hit UNION ALL SELECT rec_id, s, e FROM span), {_islands('joined', '(SELECT * FROM added WHERE rec_id NOT IN (SELECT rec_id FROM hit))')} SELECT * FROM added WHERE rec_id IN (SELECT rec_id FROM hit) UNION ALL SELECT * FROM joined"),
    "range_replace": with_tables("ranges", f"WITH {_days('x', _lines(1, 4))}, {_days('y', _lines(5))}, z AS (SELECT * FROM x EXCEPT SELECT * FROM y) {_runs('z')}"),
    "point_in_range": with_tables("ranges", f"WITH {_FIRST}, {_POINTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_f) - 1 AS range_no FROM firsts) SELECT p.rec_id, p.id, min(range_no) AS range_no FROM points p JOIN numbered n ON n.rec_id = p.rec_id AND pos BETWEEN start_f AND end_f GROUP BY p.rec_id, p.id"),
    "remove_ranges": with_tables("ranges", f"WITH {_FIRST}, numbered AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_f) - 1 AS range_no FROM firsts) SELECT rec_id, start_f, end_f FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.line = 2 AND r.rec_id = n.rec_id AND r.id % 50 = n.range_no)"),
    "marker_nav": with_tables("markers", f"WITH {_POINTS} SELECT p.rec_id, p.id, coalesce((SELECT min(frame) FROM markers m WHERE m.rec_id = p.rec_id AND frame > pos), (SELECT min(frame) FROM markers m WHERE m.rec_id = p.rec_id), pos) AS following, coalesce((SELECT max(frame) FROM markers m WHERE m.rec_id = p.rec_id AND frame < pos), (SELECT max(frame) FROM markers m WHERE m.rec_id = p.rec_id), pos) AS preceding FROM points p"),
    "marker_toggle": with_tables("markers", f"WITH {_POINTS}, u AS (SELECT rec_id, frame FROM markers UNION ALL SELECT rec_id, pos FROM points) SELECT rec_id, frame FROM u GROUP BY ALL HAVING count(*) % 2 = 1"),
    "mismatch_audit": with_tables("cuts", f"WITH {_DUR}, e AS (SELECT rec_id, max(b) AS last, max(b) - min(a) AS span FROM cuts GROUP BY rec_id) SELECT rec_id, last, span, CASE WHEN last > duration + 1 THEN 'error' WHEN span > 0 AND duration > last * 2 THEN 'warning' ELSE 'fine' END AS verdict FROM e JOIN dur USING (rec_id)"),
    "split_padding": with_tables("cuts", f"WITH {_DUR}, {_SPLIT} SELECT * FROM split"),
    "learnable_gate": with_tables("cuts", f"WITH {_DUR}, {_SPLIT}, f AS (SELECT rec_id, count(*) FILTER (kind = 'advert') AS adverts, count(*) FILTER (kind = 'advert' AND (b - a < 0 OR b - a > 29)) AS odd, coalesce(sum(b - a) FILTER (kind = 'advert'), 0) AS removed FROM split GROUP BY rec_id) SELECT rec_id, CASE WHEN adverts IS NULL THEN 'no cuts' WHEN adverts = 0 THEN 'only padding' WHEN odd > 0 THEN 'length' WHEN duration > 0 AND removed > duration * 0.05 THEN 'too much' ELSE 'ok' END AS reason FROM dur LEFT JOIN f USING (rec_id)"),
}
