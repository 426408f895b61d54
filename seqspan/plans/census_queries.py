"""Registered queries over tracks, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import census as op
from . import adapters as src
from .adapters import table, with_tables

DAY = 86_400_000


def dominant_config(spark, sf_dir):
    p = src.packets(spark, sf_dir).withColumn("config", F.when(F.col("config") != 3, F.col("config")))
    return op.dominant_config(p, 1024, 48_000)


def commonest_box(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return op.commonest_box(li.select(F.col("l_suppkey").alias("rec_id"), F.col("l_linenumber").cast("long").alias("w"), F.floor(F.col("l_quantity") / 10).cast("long").alias("h")))


def track_census(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec_id"), F.concat("l_returnflag", "l_linestatus").alias("track"), "l_tax")
    return op.track_census(li, li.where("l_tax < 0.075"))


def silent_tracks(spark, sf_dir):
    p = src.packets(spark, sf_dir).where("pts IS NOT NULL").select("rec_id", F.col("config").alias("track"), "pts")
    return op.silent_tracks(p, src.keep_spans(spark, sf_dir), DAY)


def usable_tracks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").cast("long").alias("track"), (F.col("l_quantity") % 3).cast("long").alias("channels"), F.floor(F.col("l_discount") * 100).cast("long").alias("rate"), (F.col("l_quantity") > 48).alias("decodes"))
    return op.usable_tracks(t)


def _entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    size = F.length("text").cast("long")
    return c.select(
        F.col("conv_id").alias("list_id"), F.col("turn").alias("seq"), size.alias("duration"), F.substring("role", 1, 1).alias("codec"), (size % 3 * 320 + 640).alias("w"), (size % 2 * 360 + 360).alias("h"),
        (size % 4 * 5 + 25).cast("double").alias("fps"), F.lit("aac").alias("audio"), (size % 90).alias("fade_in"), (size % 200).alias("fade_out"),
    )


def join_target(spark, sf_dir):
    return op.join_target(_entries(spark, sf_dir))


def join_signatures(spark, sf_dir):
    return op.join_signatures(_entries(spark, sf_dir))


def joiner_offsets(spark, sf_dir):
    return op.laid_end_to_end(_entries(spark, sf_dir))


def export_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    fps = F.when(key % 11 > 0, (key % 3 * 25 + 25).cast("double"))
    return op.export_drift(o.select(key.alias("rec_id"), (key * 7 + key % 5 - 2).alias("produced"), (key * 7).alias("expected"), F.when(key % 17 > 0, F.bround(key * 7 / (key % 3 * 25 + 25) + (key % 41 - 20) / 8, 3)).alias("actual"), fps.alias("fps"), (key % 90).alias("scenes"), (key % 13 == 0).alias("collapsed")))


def bitrate_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    files = o.select(key.alias("rec_id"), F.when(key % 3 != 0, key % 6_000_000).alias("rate"), F.floor("o_totalprice").cast("long").alias("size"), (key % 7).alias("duration"))
    audio = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec_id"), F.floor(F.col("l_quantity") * 8000 + 7).cast("long").alias("rate"))
    return op.bitrate_budget(files, audio)


def _files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", "://([^/]*)", 1).alias("root"), F.col("url").alias("path"), (F.col("page_id") * 3600).alias("mtime"), F.length("html").cast("long").alias("size"))


def retention(spark, sf_dir):
    return op.retained(_files(spark, sf_dir), F.lit(100 * 3600), 5)


def _keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mods = F.when(F.col("p_size") % 4 == 0, "Ctrl + shift").when(F.col("p_size") % 4 == 1, "SHIFT+ctrl").when(F.col("p_size") % 4 == 2, "alt+Meta")
    return p.select(F.concat_ws("+", mods, F.substring("p_brand", -2, 2)).alias("keys"), F.col("p_partkey").alias("action"))


def _known_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size % 5 > 0").select(F.substring("p_brand", -2, 2).alias("key")).where("key NOT LIKE '%3'")


def shared_bindings(spark, sf_dir):
    return op.shared_bindings(_keys(spark, sf_dir), _known_keys(spark, sf_dir))


def unknown_bindings(spark, sf_dir):
    return op.unknown_bindings(_keys(spark, sf_dir), _known_keys(spark, sf_dir))


def first_streams(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("rec_id"), (F.col("l_linenumber") % 3).cast("long").alias("index"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_shipdate").isNotNull().alias("seen"))
    return op.first_per_index(rows)


def channel_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").cast("long").alias("seq"), F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Service 0"), F.col("l_partkey").cast("string"))).otherwise(F.col("l_returnflag"))).alias("service"), F.floor(F.col("l_quantity") / 20).cast("long").alias("number"))
    return op.channel_keys(rows)


QUERIES = {f.__name__: f for f in (dominant_config, commonest_box, track_census, silent_tracks, usable_tracks, join_target, join_signatures, joiner_offsets, export_drift, bitrate_budget, retention, shared_bindings, unknown_bindings, first_streams, channel_keys)}

_ENTRIES = "en AS (SELECT conv_id AS list_id, turn AS seq, CAST(length(text) AS BIGINT) AS duration, substr(role, 1, 1) AS codec, CAST(length(text) % 3 * 320 + 640 AS BIGINT) AS w, CAST(length(text) % 2 * 360 + 360 AS BIGINT) AS h, CAST(length(text) % 4 * 5 + 25 AS DOUBLE) AS fps, 'aac' AS audio, CAST(length(text) % 90 AS BIGINT) AS fade_in, CAST(length(text) % 200 AS BIGINT) AS fade_out FROM conversations)"
ORACLES = {
    "dominant_config": with_tables("packets", "WITH c AS (SELECT rec_id, config, count(*) AS n, sum(size) AS bytes, min(seq) AS first FROM packets WHERE config <> 3 AND size >= 7 GROUP BY rec_id, config), t AS (SELECT *, sum(n) OVER (PARTITION BY rec_id) AS total FROM c) SELECT rec_id, config, n, CAST(total - n AS BIGINT) AS minority, CAST(floor(bytes * 8 * 48000 / (n * 1024)) AS BIGINT) AS bitrate FROM t QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, first) = 1"),
    "commonest_box": "WITH c AS (SELECT l_suppkey AS rec_id, CAST(l_linenumber AS BIGINT) AS w, CAST(floor(l_quantity / 10) AS BIGINT) AS h, count(*) AS n FROM lineitem GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, w * h DESC, w DESC) = 1",
    "track_census": "WITH e AS (SELECT l_suppkey AS rec_id, l_returnflag || l_linestatus AS track, count(*) AS expected FROM lineitem GROUP BY ALL), g AS (SELECT l_suppkey AS rec_id, l_returnflag || l_linestatus AS track, count(*) AS got FROM lineitem WHERE l_tax < 0.075 GROUP BY ALL), e2 AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY track) AS p FROM e), g2 AS (SELECT rec_id, got, row_number() OVER (PARTITION BY rec_id ORDER BY track) AS p FROM g) SELECT rec_id, track, expected, coalesce(got, 0) AS got, coalesce(got, 0) >= expected * 0.9 AS passed FROM e2 LEFT JOIN g2 USING (rec_id, p)",
    "silent_tracks": with_tables("packets keep_spans", "SELECT DISTINCT rec_id, config AS track FROM packets p WHERE pts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM packets q JOIN keep_spans k ON k.rec_id = q.rec_id AND q.pts BETWEEN k.s AND k.e WHERE q.rec_id = p.rec_id AND q.config = p.config)"),
    "usable_tracks": "WITH t AS (SELECT l_orderkey AS rec_id, CAST(l_linenumber AS BIGINT) AS track, (CAST(l_quantity AS BIGINT) % 3 > 0 AND floor(l_discount * 100) > 0) OR l_quantity > 48 AS good FROM lineitem) SELECT rec_id, track FROM t QUALIFY good OR (NOT bool_or(good) OVER (PARTITION BY rec_id) AND track = min(track) OVER (PARTITION BY rec_id))",
    "join_target": f"WITH {_ENTRIES} SELECT list_id, arg_min(w, -(w * h) * 1000 + seq) AS w, arg_min(h, -(w * h) * 1000 + seq) AS h, max(fps) AS fps, CAST(sum(duration) AS BIGINT) AS duration FROM en GROUP BY list_id",
    "join_signatures": f"WITH {_ENTRIES} SELECT list_id, count(DISTINCT (codec, w, h, audio)) AS signatures, min(seq) AS first_example, count(DISTINCT (codec, w, h, audio)) <= 1 AS ok FROM en GROUP BY list_id",
    "joiner_offsets": f"WITH {_ENTRIES} SELECT list_id, seq, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY list_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, least(fade_in, duration) AS fade_in, least(fade_out, duration - least(fade_in, duration)) AS fade_out FROM en",
    "export_drift": "WITH j AS (SELECT o_orderkey AS k, o_orderkey % 3 * 25 + 25 AS rate, CASE WHEN o_orderkey % 17 > 0 THEN round_even(o_orderkey * 7 / (o_orderkey % 3 * 25 + 25)::DOUBLE + (o_orderkey % 41 - 20) / 8.0::DOUBLE, 3) END AS actual FROM orders), d AS (SELECT *, k % 11 > 0 AS rated, round(CASE WHEN k % 11 > 0 AND coalesce(actual, 0) <> 0 THEN actual - k * 7 / rate::DOUBLE ELSE 0 END, 6) AS drift, round(greatest(1.0, greatest(1, k % 90) * 2.0 / CASE WHEN k % 11 > 0 THEN rate ELSE 25 END::DOUBLE), 6) AS tolerance FROM j) SELECT k AS rec_id, CASE WHEN k % 13 = 0 THEN k * 7 ELSE k * 7 + k % 5 - 2 END AS reported, drift, tolerance, abs(drift) <= tolerance AS fine FROM d",
    "bitrate_budget": "WITH w AS (SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 6000000 // 1000 > 0 THEN o_orderkey % 6000000 // 1000 WHEN o_orderkey % 7 > 0 THEN floor(floor(o_totalprice) * 8 / (o_orderkey % 7) / 1000) ELSE 8000 END AS whole FROM orders) SELECT rec_id, CAST(greatest(500, whole - coalesce((SELECT CAST(sum(floor(l_quantity * 8000 + 7)) AS BIGINT) // 1000 FROM lineitem WHERE l_orderkey = rec_id), 0)) AS BIGINT) AS kbps FROM w",
    "retention": "WITH f AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS root, url AS path, page_id * 3600 AS mtime, CAST(length(html) AS BIGINT) AS size FROM pages) SELECT * FROM f WHERE mtime >= 360000 QUALIFY row_number() OVER (PARTITION BY root ORDER BY mtime DESC, path) <= 5",
    "shared_bindings": "WITH k AS (SELECT p_partkey AS action, CASE p_size % 4 WHEN 0 THEN 'Ctrl + shift+' WHEN 1 THEN 'SHIFT+ctrl+' WHEN 2 THEN 'alt+Meta+' ELSE '' END || right(p_brand, 2) AS keys, CASE p_size % 4 WHEN 0 THEN 'ctrl+shift+' WHEN 1 THEN 'ctrl+shift+' WHEN 2 THEN 'alt+' ELSE '' END || lower(right(p_brand, 2)) AS combo, right(p_brand, 2) AS key FROM part), kn AS (SELECT DISTINCT right(p_brand, 2) AS key FROM part WHERE p_size % 5 > 0 AND right(p_brand, 1) <> '3') SELECT combo, count(*) AS actions FROM k WHERE key IN (SELECT key FROM kn) GROUP BY combo HAVING count(*) > 1",
    "unknown_bindings": "WITH k AS (SELECT p_partkey AS action, CASE p_size % 4 WHEN 0 THEN 'Ctrl + shift+' WHEN 1 THEN 'SHIFT+ctrl+' WHEN 2 THEN 'alt+Meta+' ELSE '' END || right(p_brand, 2) AS keys, CASE p_size % 4 WHEN 0 THEN 'ctrl+shift+' WHEN 1 THEN 'ctrl+shift+' WHEN 2 THEN 'alt+' ELSE '' END || lower(right(p_brand, 2)) AS combo, right(p_brand, 2) AS key FROM part), kn AS (SELECT DISTINCT right(p_brand, 2) AS key FROM part WHERE p_size % 5 > 0 AND right(p_brand, 1) <> '3') SELECT action, keys FROM k WHERE key NOT IN (SELECT key FROM kn)",
    "first_streams": "SELECT l_orderkey AS rec_id, CAST(l_linenumber % 3 AS BIGINT) AS index, min(CAST(l_linenumber AS BIGINT)) AS seq, true AS seen FROM lineitem GROUP BY ALL",
    "channel_keys": "WITH p AS (SELECT l_orderkey AS rec_id, l_linenumber AS seq, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS service, CAST(floor(l_quantity / 20) AS BIGINT) AS number FROM lineitem) SELECT rec_id, coalesce((min({'s': seq, 'v': service}) FILTER (service IS NOT NULL AND service <> 'N')).v, (min({'s': seq, 'v': 'sid:' || number}) FILTER (number NOT IN (0, 1))).v, '') AS channel FROM p GROUP BY rec_id",
}
