"""Registered queries over names, titles and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, timecode
from ..operators import library as op
from .adapters import table


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, show = F.col("p_partkey"), F.regexp_replace("p_name", " ", ".")
    e = F.format_string("%02d", k % 24 + 1)
    name = (
        F.when(k % 7 == 0, F.concat("p_name", F.lit(" 1x"), e, F.lit("-"), F.format_string("%02d", k % 24 + 2), F.lit(".ts")))
        .when(k % 7 == 1, F.concat(show, F.lit(".S"), F.format_string("%02d", k % 5), F.lit("E"), e, F.lit("E"), F.format_string("%02d", k % 24 + 2), F.lit("E01.MKV")))
        .when(k % 7 == 2, F.concat("p_name", F.lit(" (2001) - S01E02 S01E03 - E2.mkv")))
        .when(k % 7 == 3, F.concat("p_name", F.lit(" 1920x1080.mkv")))
        .when(k % 7 == 4, F.concat(F.lit("/a/b/"), "p_name", F.lit(" 1999 film.mp4")))
        .when(k % 7 == 5, F.concat(show, F.lit("_noext")))
        .otherwise(F.concat(show, F.lit("_s"), F.format_string("%02d", k % 3), F.lit(" e"), e, F.lit(".mkv")))
    )
    return p.select(k.alias("id"), name.alias("name"), "p_name", "p_size", "p_brand", "p_type")


def parse_filename(spark, sf_dir):
    p = _names(spark, sf_dir).select("id", names.parse(F.col("name")).alias("x"))
    return p.select("id", "x.show", F.coalesce("x.season", F.lit(-1)).cast("long").alias("season"), F.array_join("x.episodes", ",").alias("episodes"), F.coalesce("x.year", F.lit(-1)).cast("long").alias("year"), "x.ext", "x.matched")


def _meta():
    k = F.col("p_partkey")
    return {
        "name": F.col("p_name"), "year": F.when(k % 3 > 0, (F.lit(1990) + k % 30)), "season": F.when(k % 5 < 4, k % 4), "episodes": F.when(k % 2 == 0, F.array((k % 20).cast("int"), (k % 20 + 1).cast("int"))).otherwise(F.array((k % 9).cast("int"))),
        "title": F.when(k % 6 > 0, F.concat(F.lit("What? "), F.col("p_type"), F.lit(" / end."))), "id": F.when(k % 4 == 0, k),
    }


def render_path(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), names.render_path("%NY/Season %S/%N - S%SZE%EZ - %T [%TMDBID]", _meta()).alias("path"))


def combine_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    two = F.array(F.concat("p_name", F.lit(" ("), (k % 4).cast("string"), F.lit(")")), F.concat("p_name", F.when(k % 3 == 0, " - Part Two").when(k % 3 == 1, ", pt. 2").otherwise(" Again")), F.lit("Part 1"))
    return p.select(k.alias("id"), names.combined_title(two).alias("title"))


def timecodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    frame, text = k * 37, F.format_string("%02d:%02d:%02d.%02d", k % 30, k % 60, k % 59, k % 25)
    return o.select(
        k.alias("id"), timecode.frame_timecode(frame, 25).alias("code"), timecode.seconds_timecode(k * 0.97 - 2, 25).alias("from_seconds"), timecode.parse_timecode(text, 25).alias("parsed"),
        timecode.parse_timecode(k.cast("string"), 25).alias("short"), F.coalesce(timecode.parse_timecode(F.concat(F.lit("x"), text), 25), F.lit(-1).cast("long")).alias("bad"), timecode.ticks(k / 7.0 - 3).alias("ticks"), timecode.clock_text(k).alias("clock"),
    )


def time_exprs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, "start").when(k % 6 == 1, "END").when(k % 6 == 2, F.concat(F.lit("-"), (k % 100).cast("string"))).when(k % 6 == 3, F.format_string("%d:%02d:%02d.5", k % 9, k % 60, k % 60)).when(k % 6 == 4, F.format_string("%d:%02d", k % 90, k % 60)).otherwise((k % 1000).cast("string"))
    return o.select(k.alias("id"), (timecode.time_expression(text, F.lit(40_000)) * 1000).cast("long").alias("ms"))


def human_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    # whole numbers that outgrow a long from the key 41,874 on; what outgrows 38 digits is taken as it is in double precision
    k = F.col("c_custkey").cast("decimal(38,0)")
    whole = F.try_add(F.try_multiply(F.try_multiply(F.try_multiply(k, k), F.try_multiply(k, k)), F.lit(3)), F.lit(1))
    z = F.coalesce(whole.cast("double"), F.pow(k.cast("double"), F.lit(4)) * 3 + 1)
    return c.select(F.col("c_custkey").alias("id"), timecode.human_size(z).alias("size"), timecode.media_size(z).alias("media"))


def version_compare(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    v = F.when(k % 7 == 0, F.concat(F.lit("release "), k % 9)).when(k % 2 == 0, F.format_string("v%d.%d", k % 4, k % 3)).otherwise(F.format_string("v%d.%d.%d-beta%d.5", k % 4, k % 3, k % 5, k % 6))
    return c.select(k.alias("id"), F.coalesce(F.array_join(names.version(v), "."), F.lit("")).alias("version"), names.is_newer(v, F.lit("2.1.0")).alias("newer"))


def show_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return op.shows(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.regexp_replace("p_type", " ", "-")).alias("show")))


def episode_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    catalog = p.where("p_partkey % 3 > 0").select(F.col("p_brand").alias("series"), (k % 7).alias("season"), k.alias("episode"), F.col("p_name").alias("title"))
    out = op.titled(p.select(k.alias("id"), F.col("p_brand").alias("show"), (k % 7).alias("season"), k.alias("episode")), catalog)
    return out.select("id", F.coalesce("title", F.lit("")).alias("title"), "note")


def _patterns(spark, sf_dir):
    p, k, name = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    piece = (
        F.when(k % 5 == 0, F.concat(F.lit("*"), F.substring(name, -2, 2))).when(k % 5 == 1, "# note").when(k % 25 == 2, "*").when(k % 25 == 7, F.concat(F.lit(" *  "), F.substring(name, 2, 3)))
        .when(k % 25 == 12, "  ").otherwise(F.upper(F.substring(name, 1, 4)))
    )
    return p.select(piece.alias("pattern")).distinct()


def ignore_match(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/watched/a b/"), "p_name").alias("name"))
    listed = _patterns(spark, sf_dir)
    mode = lambda anywhere: op.ignored(files, listed, anywhere).withColumn("anywhere", F.lit(anywhere))
    return mode(False).unionByName(mode(True))


def settings_pick(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    settings = table(spark, sf_dir, "part").groupBy(F.substring_index("p_type", " ", -1).alias("setting")).agg(F.min("p_partkey").alias("order"))
    return op.longest_name_held(files, settings.where("length(setting) > 4"), "default")


def dest_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = names.with_modifier(names.safe(F.col("p_type")), F.when(F.col("p_partkey") % 2 == 0, "-cut").otherwise("New "))
    files = p.select(F.col("p_partkey").alias("id"), F.lit("/out").alias("folder"), base.alias("base"), F.lit("mkv").alias("ext"))
    k = F.col("id")
    there = files.where("id % 4 = 0").select(F.concat(F.lit("/out/"), "base", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" ("), (k % 5 + 2).cast("string"), F.lit(")"))), F.lit(".mkv")).alias("path"))
    return op.numbered_paths(files, there.distinct())


def discovered_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.concat(F.lit("/tv/"), (k % 700).cast("string"), F.when(k % 3 == 0, ".TS").when(k % 3 == 1, ".ts").otherwise(".tsx"))
    return op.discovered(p.select(k.alias("order"), F.regexp_extract("url", "://([^/]*)", 1).alias("root"), path.alias("path")), "?*5.t?")


QUERIES = {f.__name__: f for f in (parse_filename, render_path, combine_titles, timecodes, time_exprs, human_sizes, version_compare, show_groups, episode_join, ignore_match, settings_pick, dest_paths, discovered_files)}

ORACLES = {
    "timecodes": "SELECT o_orderkey AS id, printf('%02d:%02d:%02d.%02d', (o_orderkey * 37) // 90000, (o_orderkey * 37) // 1500 % 60, (o_orderkey * 37) // 25 % 60, (o_orderkey * 37) % 25) AS code, printf('%02d:%02d:%02d.%02d', (w + c) // 3600, (w + c) // 60 % 60, (w + c) % 60, CASE WHEN c = 1 THEN 0 ELSE f END) AS from_seconds, ((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59) * 25 + o_orderkey % 25 AS parsed, (o_orderkey // 1000000 * 3600 + o_orderkey // 10000 % 100 * 60 + o_orderkey // 100 % 100) * 25 + o_orderkey % 100 AS short, -1::BIGINT AS bad, greatest(0, CAST(round_even((o_orderkey / 7.0::DOUBLE - 3) * 10000000, 0) AS BIGINT)) AS ticks, CASE WHEN o_orderkey >= 3600 THEN printf('%d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60) ELSE printf('%d:%02d', o_orderkey // 60, o_orderkey % 60) END AS clock FROM (SELECT *, CASE WHEN f >= 25 THEN 1 ELSE 0 END AS c FROM (SELECT o_orderkey, CAST(floor(s) AS BIGINT) AS w, CAST(round_even((s - floor(s)) * 25, 0) AS BIGINT) AS f FROM (SELECT o_orderkey, greatest(0, o_orderkey * 0.97::DOUBLE - 2) AS s FROM orders)))",
    "time_exprs": "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 40000 WHEN 2 THEN CASE WHEN o_orderkey % 100 = 0 THEN 40000 ELSE 40000 - o_orderkey % 100 END WHEN 3 THEN o_orderkey % 9 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 60 + 0.5 WHEN 4 THEN o_orderkey % 90 * 60 + o_orderkey % 60 ELSE o_orderkey % 1000 END * 1000 AS BIGINT) AS ms FROM orders",
    "human_sizes": "SELECT c_custkey AS id, CASE WHEN z < 1024 THEN printf('%d bytes', z) WHEN z < 1048576 THEN printf('%.1f KB', z / 1024.0::DOUBLE) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576.0::DOUBLE) WHEN z < 1099511627776 THEN printf('%.1f GB', z / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', z / 1099511627776.0::DOUBLE) END AS size, CASE WHEN z >= 1073741824 THEN printf('%.3f GB', z / 1073741824.0::DOUBLE) WHEN z >= 1048576 THEN printf('%.3f MB', z / 1048576.0::DOUBLE) ELSE printf('%.1f KB', z / 1024.0::DOUBLE) END AS media FROM (SELECT c_custkey, c_custkey * c_custkey * c_custkey * c_custkey * 3 + 1 AS z FROM customer)",
    "version_compare": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat_ws('.', c_custkey % 4, c_custkey % 3, 0) ELSE concat_ws('.', c_custkey % 4, c_custkey % 3, c_custkey % 5) END AS version, c_custkey % 7 > 0 AND (c_custkey % 4, c_custkey % 3, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 5 END) > (2, 1, 0) AS newer FROM customer",
    "show_groups": "SELECT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key, count(*) AS n, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE replace(p_type, ' ', '-') END, p_partkey) AS first_name FROM part GROUP BY key",
    "episode_join": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 3 > 0 THEN '' ELSE 'no title' END AS note FROM part",
    "ignore_match": "WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN '*' || right(p_name, 2) WHEN p_partkey % 5 = 1 THEN '# note' WHEN p_partkey % 25 = 2 THEN '*' WHEN p_partkey % 25 = 7 THEN ' *  ' || substr(p_name, 2, 3) WHEN p_partkey % 25 = 12 THEN '  ' ELSE upper(left(p_name, 4)) END AS pattern FROM part), w AS (SELECT pattern, starts_with(trim(pattern), '*') AS star, lower(CASE WHEN starts_with(trim(pattern), '*') THEN trim(substr(trim(pattern), 2)) ELSE trim(pattern) END) AS needle FROM l WHERE NOT starts_with(trim(pattern), '#')), m AS (SELECT unnest([true, false]) AS anywhere) SELECT p_partkey AS id, pattern, anywhere FROM part, w, m WHERE needle <> '' AND CASE WHEN star OR anywhere THEN contains(lower(p_name), needle) ELSE starts_with(lower(p_name), needle) END",
    "settings_pick": "WITH s AS (SELECT string_split(p_type, ' ')[-1] AS setting, min(p_partkey) AS o FROM part GROUP BY ALL HAVING length(setting) > 4) SELECT p_partkey AS id, coalesce((SELECT setting FROM s WHERE contains(lower(p_type), lower(setting)) ORDER BY length(setting) DESC, o LIMIT 1), 'default') AS setting FROM part",
    "dest_paths": "WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type || '-cut' ELSE 'New' || p_type END AS base FROM part), e AS (SELECT DISTINCT base, CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5 + 2 END AS k FROM b WHERE id % 4 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b), c AS (SELECT base, unnest(generate_series(1, (SELECT max(n) + 10 FROM n))) AS k FROM (SELECT DISTINCT base FROM b)), f AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM c WHERE (base, k) NOT IN (SELECT (base, k) FROM e)) SELECT id, '/out/' || base || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.mkv' AS path FROM n JOIN f USING (base, n)",
    "discovered_files": "WITH l AS (SELECT page_id AS o, regexp_extract(url, '://([^/]*)', 1) AS root, '/tv/' || page_id % 700 || CASE page_id % 3 WHEN 0 THEN '.TS' WHEN 1 THEN '.ts' ELSE '.tsx' END AS path, page_id % 700 AS m FROM pages) SELECT path, arg_min(root, o) AS root FROM l WHERE m % 10 = 5 AND m > 9 AND NOT ends_with(path, 'x') GROUP BY path",
    "combine_titles": "WITH t AS (SELECT p_partkey AS id, p_name AS a, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE p_name || ' Again' END AS b FROM part) SELECT id, CASE WHEN a = b THEN a ELSE a || ' & ' || b END || ' & Part 1' AS title FROM t",
    "render_path": "WITH m AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN 1990 + p_partkey % 30 END AS year, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 4 END AS season, CASE WHEN p_partkey % 2 = 0 THEN printf('%02d-%02d', p_partkey % 20, p_partkey % 20 + 1) ELSE printf('%02d', p_partkey % 9) END AS ez, CASE WHEN p_partkey % 6 > 0 THEN 'What ' || p_type || ' end.' ELSE '' END AS title, CASE WHEN p_partkey % 4 = 0 AND p_partkey <> 0 THEN p_partkey::VARCHAR ELSE '' END AS mid FROM part) SELECT k AS id, name || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END || '/' || CASE WHEN season IS NULL THEN 'Season' WHEN season = 0 THEN 'Specials' ELSE 'Season ' || season END || '/' || regexp_replace(name || ' - S' || coalesce(printf('%02d', season), '') || 'E' || ez || ' - ' || title || ' [' || mid || ']', '\\s+', ' ', 'g') AS path FROM m",
    "parse_filename": "WITH p AS (SELECT p_partkey AS k, p_name, trim(replace(p_name, '.', ' ')) AS nm FROM part) SELECT k AS id, CASE k % 7 WHEN 3 THEN nm || ' 1920x1080' WHEN 5 THEN string_split(p_name, ' ')[1] ELSE nm END AS \"show\", CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN k % 5 WHEN 2 THEN 1 WHEN 6 THEN k % 3 ELSE -1 END AS season, CASE k % 7 WHEN 0 THEN (k % 24 + 1) || ',' || (k % 24 + 2) WHEN 1 THEN (k % 24 + 1) || ',' || (k % 24 + 2) WHEN 2 THEN '2,3' WHEN 6 THEN (k % 24 + 1)::VARCHAR ELSE '' END AS episodes, CASE k % 7 WHEN 2 THEN 2001 WHEN 4 THEN 1999 ELSE -1 END AS year, CASE k % 7 WHEN 0 THEN 'ts' WHEN 4 THEN 'mp4' WHEN 5 THEN lower(string_split(p_name, ' ')[2]) || '_noext' ELSE 'mkv' END AS ext, k % 7 NOT IN (3, 4, 5) AS matched FROM p",
}
