"""Registers by content, working copies, presets, profiles and configuration summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def registered(entries: DataFrame, new: DataFrame, most: int, oldest: int | None = None) -> DataFrame:
    """shelf, print, at: a register after new entries: one a print, the latest; the ``most`` newest of each shelf, none too old."""
    rows = entries.join(new.select("shelf", "print"), ["shelf", "print"], "left_anti").unionByName(new.groupBy("shelf", "print").agg(F.max("at").alias("at")))
    rank = F.row_number().over(W.partitionBy("shelf").orderBy(F.desc("at"), "print"))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return kept if oldest is None else kept.where(F.col("at") >= oldest)


def working_copies(files: DataFrame, marker: str, kinds: tuple[str, ...]) -> DataFrame:
    """path, size, mtime of files (path, size, mtime) whose name without the extension holds the marker, of a video's extension."""
    name = F.substring_index("path", "/", -1)
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return files.where(stem.contains(marker) & ext.isin(*kinds))


def stale_copies(copies: DataFrame, keep: DataFrame, cutoff: Column) -> DataFrame:
    """path, size of working copies older than the cutoff that aren't kept (path)."""
    return copies.where(F.col("mtime") < cutoff).join(keep.select("path").distinct(), "path", "left_anti").select("path", "size")


def usable_presets(presets: DataFrame) -> DataFrame:
    """user, place, label, pattern: the saved pairs (``pair``, an array) that have both, each more than blanks."""
    at = lambda i: F.get("pair", F.lit(i))
    rows = presets.where("pair IS NOT NULL AND size(pair) >= 2").select("user", "place", at(0).alias("label"), at(1).alias("pattern"))
    return rows.where("trim(label) <> '' AND trim(pattern) <> ''")


def resolved_profiles(jobs: DataFrame, profiles: DataFrame, builtin: str) -> DataFrame:
    """id, profile: the profile a job (id, owner, name) gets: the one of that name, else the first enabled favourite, the first, the built-in.

    ``profiles`` has owner, place, name, favourite, enabled.
    """
    rank = F.when(F.col("favourite") & F.col("enabled"), 0).otherwise(1)
    spare = profiles.groupBy("owner").agg(F.min(F.struct(rank.alias("r"), "place", "name"))["name"].alias("spare"))
    own = profiles.groupBy("owner", "name").agg(F.min("place").alias("there"))
    rows = jobs.join(own, ["owner", "name"], "left").join(spare, "owner", "left")
    return rows.select("id", F.coalesce(F.when(F.col("there").isNotNull(), F.col("name")), "spare", F.lit(builtin)).alias("profile"))


def varying_configs(frames: DataFrame, least: int) -> DataFrame:
    """rec_id, usual, sustained, isolated, varies: whether a track changes its configuration for good.

    A configuration of ``least`` frames or more is sustained; frames of others are damage and don't count.  The usual one is
    the commonest, the first seen of equals.
    """
    counted = frames.where("config IS NOT NULL").groupBy("rec_id", "config").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "config"))["config"]
    held = counted.groupBy("rec_id").agg(best.alias("usual"), F.count(F.when(F.col("n") >= least, 1)).alias("sustained"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)).alias("isolated"))
    return held.withColumn("varies", F.col("sustained") > 1)
