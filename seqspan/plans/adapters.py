"""Domain tables derived from the generic star schema, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Event types in the order of their codes.
EVENT_CODES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("user_id").alias("rec_id"), "event_type", "value")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, seq, pts, size, is_key, config: a packet without pts carries its bytes to the next one."""
    code = F.lit(0)
    for i, name in enumerate(EVENT_CODES):
        code = F.when(F.col("event_type") == name, i + 1).otherwise(code)
    seq = F.row_number().over(W.partitionBy("rec_id").orderBy("ms", "event_id")).cast("long")
    return _events(spark, sf_dir).select(
        "rec_id", seq.alias("seq"), F.when(F.col("event_type") != "signup", F.col("ms")).alias("pts"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "view").alias("is_key"), code.cast("int").alias("config"),
    )


def long_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one recording: rec_id, seq, pts, size, is_key."""
    e = _events(spark, sf_dir)
    pts = F.when(F.col("event_type") != "signup", F.col("ms"))
    return e.select(F.lit(0).cast("long").alias("rec_id"), F.col("event_id").alias("seq"), pts.alias("pts"), F.floor(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "view").alias("is_key"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, i, t (ms), on, width, aspect."""
    i = F.row_number().over(W.partitionBy("rec_id").orderBy("ms", "event_id")).cast("long") - 1
    return _events(spark, sf_dir).select("rec_id", i.alias("i"), F.col("ms").alias("t"), (F.col("value") >= 20).alias("on"), F.floor("value").cast("long").alias("width"), F.col("event_type").alias("aspect"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, kind (black, silence, scene), t0, t1 (ms), id."""
    kind = F.when(F.col("event_type") == "error", "black").when(F.col("event_type") == "purchase", "silence").when(F.col("event_type") == "signup", "scene")
    rows = _events(spark, sf_dir).select("rec_id", kind.alias("kind"), F.col("ms").alias("t0"), (F.col("ms") + F.floor(F.col("value") * 1000).cast("long")).alias("t1"), F.col("event_id").alias("id"))
    return rows.where("kind IS NOT NULL")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, id, q (ms): instants to look up."""
    return _events(spark, sf_dir).where("event_type = 'signup'").select("rec_id", F.col("event_id").alias("id"), F.col("ms").alias("q"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, start_f, end_f (days, inclusive), line."""
    start = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec_id"), start.alias("start_f"), (start + F.floor(F.col("l_quantity") / 10).cast("long")).alias("end_f"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_orderkey").alias("id"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, id, a, b (days)."""
    a = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("id"), a.alias("a"), (a + F.col("o_orderkey") % 30).alias("b"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, frame."""
    return ranges(spark, sf_dir).where("line = 1").select("rec_id", F.col("start_f").alias("frame")).distinct()


def frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, id, a, b: spans of frame numbers; some reach beyond the last frame, some are reversed."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).cast("long").alias("rec_id"), key.alias("id"), (key % 60).alias("a"), (key % 60 + key % 23 - 2).alias("b"))


def keep_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, s, e (ms): disjoint spans to keep, a day in three of each recording."""
    p = packets(spark, sf_dir).where("pts IS NOT NULL").groupBy("rec_id").agg(F.min("pts").alias("lo"), F.max("pts").alias("hi"))
    k = F.explode(F.sequence(F.lit(0), F.expr("CAST((hi - lo) div 259200000 AS INT)")))
    return p.withColumn("k", k).select("rec_id", (F.col("lo") + F.col("k").cast("long") * 259_200_000 + 40_000_000).cast("long").alias("s"), (F.col("lo") + F.col("k").cast("long") * 259_200_000 + 126_400_000).cast("long").alias("e"), F.col("k").cast("long").alias("k"))


_CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(EVENT_CODES)) + " ELSE 0 END"
CTES = {
    "ev": "SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id AS rec_id, event_type, value FROM events",
    "packets": f"SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY ms, event_id) AS seq, CASE WHEN event_type <> 'signup' THEN ms END AS pts, CAST(floor(value * 100) AS BIGINT) AS size, event_type = 'view' AS is_key, CAST({_CODE_SQL} AS INTEGER) AS config FROM ev",
    "samples": "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY ms, event_id) - 1 AS i, ms AS t, value >= 20 AS \"on\", CAST(floor(value) AS BIGINT) AS width, event_type AS aspect FROM ev",
    "signals": "SELECT rec_id, CASE event_type WHEN 'error' THEN 'black' WHEN 'purchase' THEN 'silence' WHEN 'signup' THEN 'scene' END AS kind, ms AS t0, ms + CAST(floor(value * 1000) AS BIGINT) AS t1, event_id AS id FROM ev WHERE event_type IN ('error', 'purchase', 'signup')",
    "probes": "SELECT rec_id, event_id AS id, ms AS q FROM ev WHERE event_type = 'signup'",
    "ranges": "SELECT l_suppkey AS rec_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start_f, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + floor(l_quantity / 10) AS BIGINT) AS end_f, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS id FROM lineitem",
    "cuts": "SELECT o_custkey AS rec_id, o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS BIGINT) AS b FROM orders",
    "markers": "SELECT DISTINCT rec_id, start_f AS frame FROM ranges WHERE line = 1",
    "frame_spans": "SELECT o_custkey // 10 AS rec_id, o_orderkey AS id, o_orderkey % 60 AS a, o_orderkey % 60 + o_orderkey % 23 - 2 AS b FROM orders",
    "frames": "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY pts, g) - 1 AS frame_no, pts, bytes, CAST(sum(bytes) OVER (PARTITION BY rec_id ORDER BY pts, g ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_bytes, is_key FROM (SELECT rec_id, g, max(pts) AS pts, CAST(sum(size) AS BIGINT) AS bytes, bool_or(is_key AND pts IS NOT NULL) AS is_key FROM (SELECT *, count(pts) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, -count(pts) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM packets) WHERE ahead > 0 GROUP BY rec_id, g)",
    "keep_spans": "SELECT rec_id, lo + k * 259200000 + 40000000 AS s, lo + k * 259200000 + 126400000 AS e, k FROM (SELECT rec_id, lo, unnest(generate_series(0, (hi - lo) // 259200000)) AS k FROM (SELECT rec_id, min(pts) AS lo, max(pts) AS hi FROM packets WHERE pts IS NOT NULL GROUP BY rec_id))",
}
CTES["long_packets"] = "SELECT 0::BIGINT AS rec_id, event_id AS seq, CASE WHEN event_type <> 'signup' THEN ms END AS pts, CAST(floor(value * 100) AS BIGINT) AS size, event_type = 'view' AS is_key FROM ev"
CTES["long_frames"] = CTES["frames"].replace("FROM packets", "FROM long_packets")
_NEEDS = {"long_packets": ["ev"], "long_frames": ["long_packets"], "packets": ["ev"], "samples": ["ev"], "signals": ["ev"], "probes": ["ev"], "markers": ["ranges"], "frames": ["packets"], "keep_spans": ["packets"]}


def with_tables(names: str, sql: str) -> str:
    """``sql`` with the common table expressions it reads in front of it; it may begin with more of its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for below in _NEEDS.get(name, []):
            need(below)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
