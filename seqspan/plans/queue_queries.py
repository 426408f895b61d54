"""Registered queries over queues, staged files, registers, presets and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library, queues as op, registry
from . import adapters as src
from .adapters import table, with_tables
from .text_queries import _patterns

NOW = 2_000_000


def _queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 9 == 0, "done").when(k % 9 == 1, "review").when(k % 9 == 2, "failed").when(k % 9 == 3, "running").otherwise("queued")
    result = F.when(k % 7 == 0, "review").when(k % 7 == 1, "failed").when(k % 7 == 2, "cancelled").otherwise("done")
    rows = o.select(F.floor(F.col("o_custkey") / 15).cast("long").alias("owner"), k.alias("id"), status.alias("status"), F.when(k % 17 != 1, k % 13 == 0).alias("external"), result.alias("result"), F.when(k % 101 == 5, True).alias("stop"), (k % 103 == 7).alias("finish"))
    return op._numbered(rows, F.col("id"))


def queue_run(spark, sf_dir):
    return op.run_queue(_queue(spark, sf_dir)).select("owner", "ord", "id", "status")


def queue_totals(spark, sf_dir):
    return op.run_totals(op.run_queue(_queue(spark, sf_dir)))


def queue_removed(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return op.removed(q, q.where("id % 4 = 0").select("owner", "ord"))


def _one(spark, sf_dir):
    return _queue(spark, sf_dir).groupBy("owner").agg((F.max("ord") / 2).cast("long").alias("ord"))


def queue_to_end(spark, sf_dir):
    return op.to_end(_queue(spark, sf_dir), _one(spark, sf_dir))


def queue_moved(spark, sf_dir):
    return op.moved(_queue(spark, sf_dir), _one(spark, sf_dir).withColumn("delta", F.col("owner") % 7 - 3))


def path_counts(spark, sf_dir):
    q = _queue(spark, sf_dir)
    path = F.concat(F.lit("/TV"), F.when(F.col("id") % 2 == 0, "//").when(F.col("id") % 3 == 0, "/./").otherwise("/"), (F.col("id") % 500).cast("string"), F.lit(".ts"))
    return op.path_counts(q.select("status", "external", path.alias("path")))


def queue_worth_keeping(spark, sf_dir):
    q = _queue(spark, sf_dir)
    name = lambda kind: F.concat(F.lit(f"/{kind}/"), F.col("id").cast("string"))
    files = q.where("id % 2 = 0").select(name("out").alias("path")).unionByName(q.where("id % 5 = 0").select(name("project").alias("path")))
    return op.worth_keeping(q.select("id", "status", F.when(F.col("id") % 3 > 0, name("out")).alias("result"), name("project").alias("project")), files)


def staging_sweep(spark, sf_dir):
    q = _queue(spark, sf_dir)
    path = F.concat(F.lit("/stage/"), F.col("id").cast("string"), F.when(F.col("id") % 11 == 0, ".txt").when(F.col("id") % 2 == 0, ".VPRJ").otherwise(".swproj"))
    staged = q.select(path.alias("path"), (F.lit(NOW) - F.col("id") % 7200).alias("mtime"))
    jobs = q.select(F.when(F.col("id") % 10 > 1, F.concat(F.lit("/Stage//"), F.substring_index(path, "/", -1))).alias("path"), "id")
    return op.orphaned(staged, jobs.where("id % 3 = 0"), jobs.where("id % 3 = 1"), F.lit(NOW), 3600)


def latest_requests(spark, sf_dir):
    s = src.samples(spark, sf_dir)
    return op.latest(s.select(F.col("rec_id").alias("key"), F.col("i").alias("seq"), F.col("width").alias("value"), F.col("t").alias("at")), F.lit(1_706_000_000_000))


def _lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("# "), name)).when(k % 6 == 2, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).otherwise(name)
    return p.select(k.alias("line_no"), text.alias("text"))


def _dropped(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size < 20").select(F.concat(F.lit(" "), "p_name").alias("pattern"))


def ignore_rewrite(spark, sf_dir):
    return op.kept_lines(_lines(spark, sf_dir), _dropped(spark, sf_dir))


def ignore_prune(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    patterns = _patterns(spark, sf_dir)
    files = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    matches = library.ignored(files, patterns).select(F.col("id").cast("string").alias("path"), "pattern")
    lines = patterns.select(F.lit(0).alias("line_no"), F.col("pattern").alias("text"))
    done = files.where("id % 3 = 0").select(F.col("id").cast("string").alias("path"))
    return op.pruned_patterns(lines, patterns.where("length(trim(pattern)) < 4"), matches, done)


def print_register(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    row = lambda at: (F.col("c_mktsegment").alias("shelf"), F.md5((k % 1000).cast("string")).alias("print"), at.alias("at"))
    old = c.where("c_custkey % 2 = 0").groupBy("c_mktsegment", (k % 1000).alias("m")).agg(F.max("c_custkey").alias("c_custkey")).select(F.col("c_mktsegment").alias("shelf"), F.md5(F.col("m").cast("string")).alias("print"), F.col("c_custkey").alias("at"))
    return registry.registered(old, c.where("c_custkey % 5 = 0").select(*row(k + 50)), 70, 100)


def _copies(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    name = F.concat(F.lit("/tmp/p"), k.cast("string"), F.when(k % 3 > 0, "_fixed").otherwise(""), F.when(k % 5 == 0, ".txt").when(k % 5 == 1, ".MKV").otherwise(".ts"))
    files = p.select(name.alias("path"), F.length("html").cast("long").alias("size"), (k * 60).alias("mtime"))
    return registry.working_copies(files, "_fixed", (".ts", ".mkv"))


def working_copies(spark, sf_dir):
    return _copies(spark, sf_dir)


def stale_copies(spark, sf_dir):
    c = _copies(spark, sf_dir)
    return registry.stale_copies(c, c.where("size % 4 = 0"), F.lit(30_000))


def usable_presets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pair = F.when(k % 5 == 0, F.array("p_name")).when(k % 5 == 1, F.array("p_name", F.lit("  "))).when(k % 5 == 2, F.array(F.lit(None).cast("string"), F.lit("%N"))).when(k % 5 == 3, F.array("p_name", F.lit("%N - %T"), F.lit("x")))
    return registry.usable_presets(p.select(F.col("p_brand").alias("user"), k.alias("place"), pair.alias("pair")))


def resolved_profiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_custkey") / 25).cast("long").alias("owner"), (F.col("o_orderkey") % 8).cast("string").alias("name"))
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    profiles = c.where("c_custkey % 150 < 125").select(F.floor(k / 25).cast("long").alias("owner"), k.alias("place"), (k % 11).cast("string").alias("name"), (k % 4 == 1).alias("favourite"), (k % 3 > 0).alias("enabled"))
    return registry.resolved_profiles(jobs, profiles, "Match Source")


def varying_configs(spark, sf_dir):
    return registry.varying_configs(src.packets(spark, sf_dir).select("rec_id", "seq", F.when(F.col("size") % 19 == 0, 9).otherwise(F.col("config")).alias("config")), 20)


QUERIES = {
    f.__name__: f
    for f in (queue_run, queue_totals, queue_removed, queue_to_end, queue_moved, path_counts, queue_worth_keeping, staging_sweep, latest_requests, ignore_rewrite, ignore_prune, print_register, working_copies, stale_copies, usable_presets, resolved_profiles, varying_configs)
}

_Q = "q AS (SELECT o_custkey // 15 AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey // 15 ORDER BY o_orderkey) - 1 AS ord, CASE o_orderkey % 9 WHEN 0 THEN 'done' WHEN 1 THEN 'review' WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'queued' END AS status, o_orderkey % 17 <> 1 AND o_orderkey % 13 = 0 AS ext, CASE o_orderkey % 7 WHEN 0 THEN 'review' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' ELSE 'done' END AS result, o_orderkey % 101 = 5 AS stop, o_orderkey % 103 = 7 AS fin FROM orders)"
_RUN = f"{_Q}, tr AS (SELECT *, NOT ext AND status NOT IN ('done', 'review') AS tried FROM q), en AS (SELECT *, coalesce(ord > (SELECT min(ord) FROM tr x WHERE x.owner = tr.owner AND x.tried AND (x.stop OR x.fin)), false) AS over FROM tr), ru AS (SELECT *, CASE WHEN over OR NOT tried THEN status WHEN stop THEN 'cancelled' ELSE result END AS after FROM en)"
_LIST = "l AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN '*' || right(p_name, 2) WHEN p_partkey % 5 = 1 THEN '# note' WHEN p_partkey % 25 = 2 THEN '*' WHEN p_partkey % 25 = 7 THEN ' *  ' || substr(p_name, 2, 3) WHEN p_partkey % 25 = 12 THEN '  ' ELSE upper(left(p_name, 4)) END AS pattern FROM part)"
_COPIES = "c AS (SELECT '/tmp/p' || page_id || '_fixed' || CASE page_id % 5 WHEN 1 THEN '.MKV' ELSE '.ts' END AS path, CAST(length(html) AS BIGINT) AS size, page_id * 60 AS mtime FROM pages WHERE page_id % 3 > 0 AND page_id % 5 > 0)"
ORACLES = {
    "queue_run": f"WITH {_RUN} SELECT owner, ord, id, after AS status FROM ru",
    "queue_totals": f"WITH {_RUN} SELECT owner, count(*) FILTER (after = 'done') AS completed, count(*) FILTER (tried AND after = 'failed') AS failed, count(*) FILTER (after = 'review') AS held FROM ru WHERE NOT over AND NOT ext GROUP BY owner",
    "queue_removed": f"WITH {_Q} SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY ord) - 1 AS ord, id, status FROM q WHERE id % 4 > 0 OR status = 'running' OR ext",
    "queue_to_end": f"WITH {_Q}, m AS (SELECT *, ord = max(ord) OVER (PARTITION BY owner) // 2 AND status NOT IN ('running', 'done') AND NOT ext AS back FROM q) SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY back, ord) - 1 AS ord, id, status FROM m",
    "queue_moved": f"WITH {_Q}, s AS (SELECT owner, max(ord) // 2 AS x, max(ord) // 2 + owner % 7 - 3 AS y FROM q GROUP BY owner), p AS (SELECT s.* FROM s JOIN q a ON a.owner = s.owner AND a.ord = x JOIN q b ON b.owner = s.owner AND b.ord = y WHERE a.status NOT IN ('running', 'done') AND b.status NOT IN ('running', 'done')) SELECT q.owner, CASE WHEN ord = x THEN y WHEN ord = y THEN x ELSE ord END AS ord, id, status FROM q LEFT JOIN p USING (owner)",
    "path_counts": f"WITH {_Q} SELECT '/tv/' || id % 500 || '.ts' AS path, count(*) AS n, count(*) FILTER (status NOT IN ('done', 'review') AND NOT ext) AS pending, count(*) FILTER (status = 'review') AS held FROM q GROUP BY id % 500",
    "queue_worth_keeping": f"WITH {_Q} SELECT id, status FROM q WHERE status <> 'done' OR CASE WHEN id % 3 > 0 THEN id % 2 = 0 ELSE id % 5 = 0 END",
    "staging_sweep": f"WITH {_Q}, s AS (SELECT id, '/stage/' || id || CASE WHEN id % 11 = 0 THEN '.txt' WHEN id % 2 = 0 THEN '.VPRJ' ELSE '.swproj' END AS path FROM q) SELECT path FROM s WHERE id % 11 > 0 AND id % 7200 >= 3600 AND NOT (id % 10 > 1 AND id % 3 < 2)",
    "latest_requests": with_tables("samples", "SELECT rec_id AS key, max(i) AS seq, arg_max(width, i) AS value FROM samples WHERE t <= 1706000000000 GROUP BY rec_id"),
    "ignore_rewrite": "WITH t AS (SELECT p_partkey AS line_no, p_name, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '# ' || p_name WHEN 2 THEN '  ' || upper(p_name) || ' ' ELSE p_name END AS text FROM part) SELECT line_no, text FROM t WHERE line_no % 6 < 2 OR lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 20)",
    "ignore_prune": f"WITH {_LIST}, d AS (SELECT pattern FROM l WHERE length(trim(pattern)) < 4), w AS (SELECT starts_with(trim(pattern), '*') AS star, lower(CASE WHEN starts_with(trim(pattern), '*') THEN trim(substr(trim(pattern), 2)) ELSE trim(pattern) END) AS needle FROM d) SELECT DISTINCT 'marked' AS kind, p_partkey::VARCHAR AS text FROM part, w WHERE needle <> '' AND p_partkey % 3 > 0 AND CASE WHEN star THEN contains(lower(p_name), needle) ELSE starts_with(lower(p_name), needle) END UNION ALL SELECT 'line', pattern FROM l WHERE trim(pattern) = '' OR starts_with(trim(pattern), '#') OR length(trim(pattern)) >= 4",
    "print_register": "WITH o AS (SELECT c_mktsegment AS shelf, c_custkey % 1000 AS m, max(c_custkey) AS \"at\" FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), n AS (SELECT c_mktsegment AS shelf, c_custkey % 1000 AS m, max(c_custkey) + 50 AS \"at\" FROM customer WHERE c_custkey % 5 = 0 GROUP BY ALL), u AS (SELECT shelf, md5(m::VARCHAR) AS print, \"at\" FROM n UNION ALL SELECT shelf, md5(m::VARCHAR), \"at\" FROM o WHERE (shelf, m) NOT IN (SELECT (shelf, m) FROM n)), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY shelf ORDER BY \"at\" DESC, print) <= 70) SELECT * FROM k WHERE \"at\" >= 100",
    "working_copies": f"WITH {_COPIES} SELECT * FROM c",
    "stale_copies": f"WITH {_COPIES} SELECT path, size FROM c WHERE mtime < 30000 AND size % 4 > 0",
    "usable_presets": "SELECT p_brand AS user, p_partkey AS place, p_name AS label, '%N - %T' AS pattern FROM part WHERE p_partkey % 5 = 3",
    "resolved_profiles": "WITH p AS (SELECT c_custkey // 25 AS owner, c_custkey AS place, (c_custkey % 11)::VARCHAR AS name, c_custkey % 4 = 1 AND c_custkey % 3 > 0 AS good FROM customer WHERE c_custkey % 150 < 125), s AS (SELECT owner, name AS spare FROM p QUALIFY row_number() OVER (PARTITION BY owner ORDER BY good DESC, place) = 1) SELECT o_orderkey AS id, coalesce((SELECT min(name) FROM p WHERE p.owner = o_custkey // 25 AND p.name = (o_orderkey % 8)::VARCHAR), (SELECT spare FROM s WHERE s.owner = o_custkey // 25), 'Match Source') AS profile FROM orders",
    "varying_configs": with_tables("packets", "WITH f AS (SELECT rec_id, seq, CASE WHEN size % 19 = 0 THEN 9 ELSE config END AS config FROM packets), c AS (SELECT rec_id, config, count(*) AS n, min(seq) AS first FROM f GROUP BY rec_id, config) SELECT rec_id, (list(config ORDER BY n DESC, first))[1] AS usual, count(*) FILTER (n >= 20) AS sustained, CAST(coalesce(sum(n) FILTER (n < 20), 0) AS BIGINT) AS isolated, count(*) FILTER (n >= 20) > 1 AS varies FROM c GROUP BY rec_id"),
}
