"""Registered queries over byte plans, lookups and decision ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, plansize as op
from . import adapters as src
from .adapters import table, with_tables


def byte_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    mode = F.when(k % 3 == 0, "beginning").when(k % 3 == 1, "end").otherwise("at")
    return op.byte_plan(o.select(k.alias("id"), (k * 99_991).alias("size"), mode.alias("mode"), (k % 40 / 2).alias("n_mb"), (k % 90).alias("start_mb")))


def keyframe_bytes(spark, sf_dir):
    marks = src.keep_spans(spark, sf_dir).select("rec_id", F.col("k").alias("id"), F.col("s").alias("a"), F.col("e").alias("b"))
    return op.keyframe_bytes(frames.frame_index(src.packets(spark, sf_dir)), marks)


def clamped_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise((F.col("p_size") * 2 - 20).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), op.clamped(raw, 0, 51, 18).alias("crf"), op.one_of(F.col("p_brand"), ("Brand#11", "Brand#12", "Brand#13"), "match").alias("mode"))


def resolved_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    c = p.select(F.col("page_id").alias("id"), F.posexplode(F.array("url", F.concat("url", F.lit("/x")), F.regexp_replace("url", "^https:", "http:"))).alias("order", "path"))
    return op.resolved(c, p.where("page_id % 3 = 0").select(F.col("url").alias("path")))


def content_prints(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), op.fingerprint(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("print"))


def incompatible_streams(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("container"))
    return op.incompatible(s, spark.createDataFrame([("O", "N"), ("O", "R"), ("F", "A")], "container string, codec string"))


def even_boxes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    box = op.even_box(k % 1900 + 11, k % 1050 + 13, k % 31 - 3, k % 17, k % 29, k % 700, k % 3 == 0)
    return o.select(k.alias("id"), box.alias("b")).select("id", "b.*")


def picture_kinds(spark, sf_dir):
    p = src.packets(spark, sf_dir)
    return p.select("rec_id", "seq", op.key_kinds(F.col("size") % 24, (5, 19, 20), (6, 7, 8, 9)).alias("kind"))


def subtitle_defaults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 1, "audio").otherwise("subtitles")
    language = F.when(F.col("l_quantity") % 5 == 0, " UND ").when(F.col("l_quantity") % 7 == 0, None).otherwise(F.col("l_returnflag"))
    t = li.select(F.col("l_orderkey").alias("rec_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), kind.alias("kind"), language.alias("language"), (F.col("l_discount") > 0.04).alias("marked"), (F.col("l_quantity") > 45).alias("forced"))
    return op.default_subtitles(t)


def film_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    wanted = p.where("p_partkey % 2 = 0").select(k.alias("id"), F.concat("p_type", F.lit(" "), (k % 60).cast("string")).alias("title"), (k % 5).alias("year"))
    have = p.where("p_partkey % 2 = 1 OR p_partkey % 10 = 4").select(F.concat("p_type", F.lit(" "), (k % 60).cast("string")).alias("title"), (k % 7).alias("year"), k.alias("rank"), k.alias("hit"))
    return op.first_hit(wanted, have)


def match_cache(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    row = lambda used: (F.col("c_mktsegment").alias("shelf"), k.alias("key"), (k * 3).alias("size"), used.alias("used"))
    return op.cache_put(c.select(*row(F.when(k % 9 > 0, k % 1000))), c.where("c_custkey % 4 = 0").select(*row(k % 500 + 900)), 60, 100)


def segment_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "/a/b#c.mkv").when(k % 3 == 1, "/a.d/film.mkv").otherwise("/a.d/film")
    return o.select(k.alias("id"), op.segment_name(path, k % 30, F.lit(120)).alias("name"))


QUERIES = {f.__name__: f for f in (byte_plan, keyframe_bytes, clamped_settings, resolved_sources, content_prints, incompatible_streams, even_boxes, picture_kinds, subtitle_defaults, film_match, match_cache, segment_names)}

ORACLES = {
    "byte_plan": "WITH j AS (SELECT o_orderkey AS id, o_orderkey * 99991 AS size, o_orderkey % 3 AS m, CAST(round_even(o_orderkey % 40 / 2.0 * 1048576, 0) AS BIGINT) AS want, o_orderkey % 90 * 1048576 AS st FROM orders), f AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 1 THEN least((greatest(0, size - want) + 187) // 188 * 188, size) ELSE least((st + 187) // 188 * 188, size) END AS first FROM j) SELECT id, CAST(first AS BIGINT) AS first, CAST(first + CASE WHEN m = 1 THEN size - first ELSE least(want, size - first) END // 188 * 188 AS BIGINT) AS last FROM f",
    "keyframe_bytes": with_tables("frames keep_spans", "SELECT k.rec_id, k.k AS id, coalesce((SELECT arg_max(cum_bytes - bytes, pts) FROM frames f WHERE f.rec_id = k.rec_id AND is_key AND pts <= k.s), 0) // 188 * 188 AS from_byte, coalesce((SELECT arg_min(cum_bytes - bytes, pts) FROM frames f WHERE f.rec_id = k.rec_id AND is_key AND pts > k.e), (SELECT max(cum_bytes) FROM frames f WHERE f.rec_id = k.rec_id)) // 188 * 188 AS to_byte FROM keep_spans k"),
    "clamped_settings": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 18.0 ELSE greatest(0, least(51, p_size * 2 - 20))::DOUBLE END::DOUBLE AS crf, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN p_brand ELSE 'match' END AS mode FROM part",
    "resolved_sources": "WITH f AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0) SELECT page_id AS id, CASE WHEN url IN (SELECT url FROM f) THEN url WHEN url || '/x' IN (SELECT url FROM f) THEN url || '/x' WHEN regexp_replace(url, '^https:', 'http:') IN (SELECT url FROM f) THEN regexp_replace(url, '^https:', 'http:') ELSE '' END AS path FROM pages",
    # no text of the tables is longer than the window, so the whole text is hashed here
    "content_prints": "SELECT doc_id AS id, 'sha256:' || sha256(strlen(t) || t) AS print FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "incompatible_streams": "SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, l_returnflag AS codec, l_linestatus AS container FROM lineitem WHERE (l_linestatus, l_returnflag) NOT IN (('O', 'N'), ('O', 'R'), ('F', 'A'))",
    "even_boxes": "WITH m AS (SELECT o_orderkey AS id, o_orderkey % 1900 + 11 AS sw, o_orderkey % 1050 + 13 AS sh, greatest(0, o_orderkey % 31 - 3) // 2 * 2 AS t, o_orderkey % 17 // 2 * 2 AS b, o_orderkey % 29 // 2 * 2 AS l, o_orderkey % 700 // 2 * 2 AS r, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END AS n FROM orders), z AS (SELECT *, sw - l - r AS aw, sh - t - b AS ah FROM m) SELECT id, CASE WHEN aw < 2 OR ah < n THEN sw // 2 * 2 ELSE aw // 2 * 2 END AS w, CASE WHEN aw < 2 OR ah < n THEN sh // n * n ELSE ah // n * n END AS h, CASE WHEN aw < 2 OR ah < n THEN 0 ELSE l END AS x, CASE WHEN aw < 2 OR ah < n THEN 0 ELSE t END AS y FROM z",
    "picture_kinds": with_tables("packets", "SELECT rec_id, seq, CASE WHEN size % 24 IN (5, 19, 20) THEN 'safe' WHEN size % 24 BETWEEN 6 AND 9 THEN 'leading' ELSE 'other' END AS kind FROM packets"),
    "subtitle_defaults": "WITH t AS (SELECT l_orderkey AS rec_id, (l_linenumber, l_partkey, l_suppkey) AS seq, l_linenumber % 3 = 1 AS audio, CASE WHEN l_quantity % 5 = 0 OR l_quantity % 7 = 0 THEN '' ELSE lower(l_returnflag) END AS lang, l_discount > 0.04 AS marked, l_quantity > 45 AS forced FROM lineitem), a AS (SELECT rec_id, lang AS sound FROM t WHERE audio QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY marked DESC, seq) = 1), s AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq) AS number FROM t WHERE NOT audio), d AS (SELECT s.rec_id, number, CASE WHEN forced THEN 'forced' WHEN sound IS NULL THEN 'no sound' WHEN sound = '' THEN 'sound not labelled' WHEN lang = '' THEN 'subtitles not labelled' WHEN lang <> sound THEN 'other language' ELSE 'same language' END AS reason FROM s LEFT JOIN a USING (rec_id) WHERE marked) SELECT rec_id, number, reason = 'same language' AS change, reason FROM d",
    "film_match": "WITH w AS (SELECT p_partkey AS id, p_type || ' ' || (p_partkey % 60) AS title, p_partkey % 5 AS year FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_type || ' ' || (p_partkey % 60) AS title, p_partkey % 7 AS made, p_partkey AS hit FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 10 = 4), m AS (SELECT id, min(hit) FILTER (made = year) AS e, min(hit) AS l FROM w LEFT JOIN c USING (title) GROUP BY id) SELECT id, coalesce(e, l, -1) AS hit, CASE WHEN e IS NOT NULL THEN '' WHEN l IS NOT NULL THEN '' ELSE 'no match' END AS note FROM m",
    "match_cache": "WITH r AS (SELECT c_mktsegment AS shelf, c_custkey AS key, c_custkey * 3 AS size, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 500 + 900 WHEN c_custkey % 9 > 0 THEN c_custkey % 1000 END AS used FROM customer) SELECT shelf, key, size, coalesce(used, -1) AS used FROM r WHERE used IS NULL OR used >= 100 QUALIFY row_number() OVER (PARTITION BY shelf ORDER BY used DESC NULLS LAST, key) <= 60",
    "segment_names": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '/a/b' || n || 'c.mkv' WHEN 1 THEN '/a.d/film' || n || '.mkv' ELSE '/a.d/film' || n END AS name FROM (SELECT o_orderkey, printf('%03d', o_orderkey % 30) AS n FROM orders)",
}
