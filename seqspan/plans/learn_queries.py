"""Registered queries of the learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as op
from ..operators import runs
from . import adapters as src
from .adapters import table, with_tables


def _prints(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("channel"), F.col("embedding").alias("fp"))


def _cards(prints):
    """The stated query set: every fingerprint whose id is divisible by 50."""
    return prints.where("id % 50 = 0").select(F.col("id").alias("card"), F.col("fp").alias("card_fp"))


def card_distance(spark, sf_dir):
    e = _prints(spark, sf_dir)
    return op.sightings(e, _cards(e), 0.12)


def card_sightings(spark, sf_dir):
    e = _prints(spark, sf_dir)
    met = op.sightings(e, _cards(e), 0.12).where("id <> card").select("id").distinct().withColumn("met", F.lit(True))
    seen = e.join(met, "id", "left").select(F.col("channel").alias("rec_id"), F.col("id").alias("i"), (F.col("id") * 500).alias("t"), F.coalesce("met", F.lit(False)).alias("on"))
    return runs.consecutive_runs(seen, 500)


def card_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return op.offsets(e.select(F.col("user_id").alias("key"), "value"))


def _pixels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("key"), (F.col("l_partkey") % 160).alias("pixel"), (F.col("l_linestatus") == "O").alias("inside"), (F.col("l_quantity") > 25).alias("edge"))


def pixel_contrast(spark, sf_dir):
    return op.contrast_mask(_pixels(spark, sf_dir), 0.05)


def compact_masks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_suppkey")
    mask = li.select(key.alias("key"), (F.col("l_partkey") % (key % 7 * 4 + 6) + key % 40).alias("x"), (F.col("l_orderkey") % (key % 5 * 3 + 4) + key % 30).alias("y"))
    boxes = li.select(key.alias("key")).distinct().selectExpr("key", "key % 5 AS left", "key % 3 AS top", "90 + key % 9 AS w", "60 + key % 11 AS h")
    return op.compact(mask, boxes)


def pixel_cluster(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    return op.correlated(e.select((F.col("label") % 4).cast("long").alias("key"), F.col("vec_id").alias("t"), v.alias("v")), 0.02)


def mask_learned(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("pixel"), (F.col("l_quantity") / 50).alias("contrast"))
    return op.learned_mask(c, 0.75, 4, 30, 0.88)


def sign_clusters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_suppkey")
    pixel = (F.col("l_partkey") % (key % 5 * 3 + 1)) * 16 + F.col("l_orderkey") % (key % 7 + 1)
    readings = li.select(key.alias("key"), F.col("l_orderkey").alias("t"), (F.col("l_quantity") / (key % 9 * 8 + 35)).alias("v"))
    return op.sign_clusters(li.select(key.alias("key"), pixel.alias("pixel")).distinct(), readings, 16, 6)


def _records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("long").alias("model"), (F.col("l_partkey") % 30).alias("project")).agg(F.round(F.max("l_discount"), 4).alias("good"), F.sum(F.when(F.col("l_tax") > 0.07, 1).otherwise(0)).alias("false"))


def mask_beats(spark, sf_dir):
    return op.beats(_records(spark, sf_dir))


def newest_cards(spark, sf_dir):
    return op.newest(_prints(spark, sf_dir).select("channel", F.col("id").alias("order")), ["channel"], 4)


def _store(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entry"), F.array("p_brand", F.concat(F.lit("t:"), F.col("p_type")), F.concat(F.lit("k:"), (F.col("p_partkey") % 400).cast("string"))).alias("keys"))


def _wanted(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("k:"), (F.col("p_partkey") % 500).cast("string")), F.concat(F.lit("z:"), F.col("p_size").cast("string"))).alias("keys"))


def store_by_alias(spark, sf_dir):
    return op.by_alias(_wanted(spark, sf_dir), _store(spark, sf_dir))


def cards_without_store(spark, sf_dir):
    return op.not_in_store(_wanted(spark, sf_dir).withColumnRenamed("id", "card"), _store(spark, sf_dir))


def store_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    store = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), (F.col("c_custkey") % 5).alias("version"))
    return op.upsert(store, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lower("c_mktsegment").alias("value")))


def store_filed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    store = c.where("c_custkey % 3 = 0").select(k.alias("entry"), F.array(F.concat(F.lit("n"), k.cast("string")), F.concat(F.lit("sid:"), (k % 200).cast("string"))).alias("keys"), F.col("c_mktsegment").alias("value"))
    new = c.where("c_custkey % 5 = 0").select(k.alias("order"), F.when(k % 2 == 0, F.concat(F.lit("sid:"), (k % 300).cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("key"), F.concat(F.lit("new"), k.cast("string")).alias("value"))
    return op.filed(store, new).select(F.array_join("keys", "|").alias("keys"), "value")


def store_migrated(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = F.concat(F.lit('{"version": 1, "chan'), k.cast("string"), F.lit('": {"count": '), (k % 9).cast("string"), F.lit('}, "x": 3}'))
    new = F.concat(F.lit('{"version": 2, "channels": [{"keys": ["sid:'), k.cast("string"), F.lit('", " ", "chan'), k.cast("string"), F.lit('"], "count": 2}, {"keys": [" "]}, {"count": 1}]}'))
    out = op.migrated(c.select(k.alias("store"), F.when(k % 2 == 0, old).when(k % 11 == 0, "no document").otherwise(new).alias("document")))
    return out.select("store", "name", F.array_join("keys", "|").alias("keys"), F.get_json_object("entry", "$.count").alias("count"))


def sync_lag(spark, sf_dir):
    s = src.samples(spark, sf_dir)
    from pyspark.sql import Window as W

    y = F.coalesce(F.lag("width", 3).over(W.partitionBy("rec_id").orderBy("i")), F.lit(0))
    return op.best_lag(s.select(F.col("rec_id").alias("key"), F.col("i").alias("t"), F.col("width").cast("double").alias("x"), y.cast("double").alias("y")), 8)


QUERIES = {f.__name__: f for f in (card_distance, card_sightings, card_offsets, pixel_contrast, compact_masks, pixel_cluster, mask_learned, sign_clusters, mask_beats, newest_cards, store_by_alias, cards_without_store, store_upsert, store_filed, store_migrated, sync_lag)}

_DIST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 64"
_STORE = "st AS (SELECT p_partkey AS entry, unnest([p_brand, 't:' || p_type, 'k:' || (p_partkey % 400)]) AS alias FROM part WHERE p_partkey % 3 = 0), wa AS (SELECT p_partkey AS id, unnest(['k:' || (p_partkey % 500), 'z:' || p_size]) AS alias FROM part WHERE p_partkey % 3 = 1)"
ORACLES = {
    "card_distance": f"SELECT e.vec_id AS id, c.vec_id AS card, round({_DIST.format('e.embedding', 'c.embedding')}, 6) AS distance FROM embeddings e, embeddings c WHERE c.vec_id % 50 = 0 AND {_DIST.format('e.embedding', 'c.embedding')} < 0.12",
    "card_sightings": f"WITH m AS (SELECT DISTINCT e.vec_id FROM embeddings e, embeddings c WHERE c.vec_id % 50 = 0 AND c.vec_id <> e.vec_id AND {_DIST.format('e.embedding', 'c.embedding')} < 0.12), s AS (SELECT label::BIGINT AS rec_id, vec_id AS i, vec_id * 500 AS t, vec_id IN (SELECT vec_id FROM m) AS hit FROM embeddings), g AS (SELECT *, sum(ch) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY rec_id ORDER BY i) THEN 0 ELSE 1 END AS ch FROM s)) SELECT rec_id, min(t) AS t0, max(t) + 500 AS t1, count(*) AS n FROM g WHERE hit GROUP BY rec_id, island",
    "card_offsets": "SELECT user_id AS key, round_even(median(value), 3) AS offset, round_even(max(value) - min(value), 3) AS spread, count(*) AS n FROM events GROUP BY user_id",
    "pixel_contrast": "WITH e AS (SELECT l_returnflag AS key, l_partkey % 160 AS pixel, avg((l_quantity > 25)::INT::DOUBLE) FILTER (l_linestatus = 'O') - avg((l_quantity > 25)::INT::DOUBLE) FILTER (l_linestatus <> 'O') AS raw FROM lineitem GROUP BY ALL), u AS (SELECT key, greatest(0, median(raw)) AS usual FROM e WHERE raw IS NOT NULL GROUP BY key) SELECT key, pixel, round(raw - usual, 6) AS contrast FROM e JOIN u USING (key) WHERE round(raw - usual, 6) >= 0.05",
    "compact_masks": "WITH m AS (SELECT DISTINCT l_suppkey AS key, l_partkey % (l_suppkey % 7 * 4 + 6) + l_suppkey % 40 AS x, l_orderkey % (l_suppkey % 5 * 3 + 4) + l_suppkey % 30 AS y FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS key, l_suppkey % 5 AS bl, l_suppkey % 3 AS bt, 90 + l_suppkey % 9 AS w, 60 + l_suppkey % 11 AS h FROM lineitem), i AS (SELECT key, x, y FROM m JOIN b USING (key) WHERE abs(x - bl) > 2 AND abs(x - bl - w + 1) > 2 AND abs(y - bt) > 2 AND abs(y - bt - h + 1) > 2), z AS (SELECT key, count(x) AS pixels, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM b LEFT JOIN i USING (key) GROUP BY key) SELECT key, pixels, CASE WHEN pixels < 4 THEN 'few' WHEN bw > w * 0.25 OR bh > h * 0.25 THEN 'wide' WHEN pixels < bw * bh * 0.25 THEN 'sparse' ELSE 'compact' END AS verdict FROM z JOIN b USING (key)",
    "pixel_cluster": "WITH s AS (SELECT label::BIGINT % 4 AS key, vec_id AS t, unnest(range(64)) AS pixel, unnest(list_transform(embedding, lambda x: round(x::DOUBLE * 1000))) AS v FROM embeddings), c AS (SELECT a.key, a.pixel, b.pixel AS p2, round((count(*) * sum(a.v * b.v) - sum(a.v) * sum(b.v)) / sqrt((count(*) * sum(a.v * a.v) - sum(a.v) ** 2) * (count(*) * sum(b.v * b.v) - sum(b.v) ** 2)), 6) AS r FROM s a JOIN s b USING (key, t) GROUP BY a.key, a.pixel, b.pixel), k AS (SELECT * FROM c WHERE r >= 0.02), sd AS (SELECT key, pixel AS seed FROM k GROUP BY key, pixel QUALIFY row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, pixel) = 1) SELECT k.key, p2 AS pixel, seed, r FROM k JOIN sd ON k.key = sd.key AND k.pixel = seed",
    "mask_learned": "WITH c AS (SELECT l_suppkey AS key, l_returnflag AS kind, l_quantity / 50::DOUBLE AS contrast FROM lineitem), e AS (SELECT key, kind, count(*) AS pixels, round(avg(contrast), 6) AS mean FROM c WHERE contrast > 0.75 GROUP BY ALL) SELECT * FROM e WHERE pixels >= 4 AND (pixels >= 30 OR mean >= 0.88) QUALIFY row_number() OVER (PARTITION BY key ORDER BY mean DESC, kind) = 1",
    "sign_clusters": "WITH p AS (SELECT DISTINCT l_suppkey AS key, (l_partkey % (l_suppkey % 5 * 3 + 1)) * 16 + l_orderkey % (l_suppkey % 7 + 1) AS pixel FROM lineitem), b AS (SELECT key, count(*) AS pixels, max(pixel % 16) - min(pixel % 16) + 1 AS w, max(pixel // 16) - min(pixel // 16) + 1 AS h FROM p GROUP BY key), r AS (SELECT l_suppkey AS key, round(avg((l_quantity / (l_suppkey % 9 * 8 + 35)::DOUBLE > 0.5)::INT::DOUBLE), 6) AS share FROM lineitem GROUP BY ALL) SELECT key, pixels, w, h, share, CASE WHEN pixels < 6 THEN 'small' WHEN least(w, h) < 2 OR greatest(w, h) > least(w, h) * 10 THEN 'line' WHEN share NOT BETWEEN 0.3 AND 0.97 THEN 'share' ELSE 'sign' END AS verdict FROM b JOIN r USING (key)",
    "mask_beats": "WITH r AS (SELECT l_suppkey AS key, l_linenumber::BIGINT AS model, l_partkey % 30 AS project, round(max(l_discount), 4) AS good, CAST(count(*) FILTER (l_tax > 0.07) AS BIGINT) AS bad FROM lineitem GROUP BY ALL), t AS (SELECT a.key, a.model, b.model AS other, sum(a.bad) AS f1, sum(b.bad) AS f2, sum(a.good) AS g1, sum(b.good) AS g2, count(*) AS n FROM r a JOIN r b ON a.key = b.key AND a.project = b.project AND a.model <> b.model GROUP BY ALL) SELECT key, model AS better, other AS worse, n FROM t WHERE f1 < f2 OR (f1 = f2 AND round(g1 - g2, 9) > round(n * 0.01::DOUBLE, 9))",
    "newest_cards": "SELECT label::BIGINT AS channel, vec_id AS \"order\" FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 4",
    "store_by_alias": f"WITH {_STORE} SELECT id, min(entry) AS entry FROM wa JOIN st USING (alias) GROUP BY id",
    "cards_without_store": f"WITH {_STORE} SELECT DISTINCT id AS card FROM wa WHERE id NOT IN (SELECT id FROM wa JOIN st USING (alias))",
    "store_upsert": "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 + 1 ELSE 1 END AS version FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 = 0",
    "store_filed": "WITH s AS (SELECT c_custkey AS entry, ['n' || c_custkey, 'sid:' || c_custkey % 200] AS keys, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'sid:' || c_custkey % 300 ELSE 'n' || c_custkey END AS key, max(c_custkey) AS o FROM customer WHERE c_custkey % 5 = 0 GROUP BY key), w AS (SELECT k AS key, min(entry) AS entry FROM (SELECT entry, unnest(keys) AS k FROM s) GROUP BY k), m AS (SELECT u.*, w.entry FROM u LEFT JOIN w USING (key)) SELECT array_to_string(keys, '|') AS keys, coalesce('new' || (SELECT max(o) FROM m WHERE m.entry = s.entry), value) AS value FROM s UNION ALL SELECT key, 'new' || o FROM m WHERE entry IS NULL",
    "store_migrated": "SELECT c_custkey AS store, 'chan' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'chan' || c_custkey ELSE 'sid:' || c_custkey || '|chan' || c_custkey END AS keys, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 9)::VARCHAR ELSE '2' END AS count FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 11 > 0",
    "sync_lag": with_tables("samples", "WITH p AS (SELECT rec_id AS key, i AS t, width::DOUBLE AS x, coalesce(lag(width, 3) OVER (PARTITION BY rec_id ORDER BY i), 0)::DOUBLE AS y FROM samples), f AS (SELECT key, t, x - avg(x) OVER (PARTITION BY key) AS x, y - avg(y) OVER (PARTITION BY key) AS y FROM p), s AS (SELECT a.key, lag, round(sum(a.x * b.y), 3) AS score FROM f a, (SELECT unnest(range(-8, 9)) AS lag), f b WHERE a.key = b.key AND b.t = a.t + lag GROUP BY a.key, lag) SELECT key, lag, score FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, lag) = 1"),
}
