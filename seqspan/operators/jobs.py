"""Jobs and watched files: queue merging, outcomes, settling, ageing, retention of state, time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merge_queues(mine: DataFrame, disk: DataFrame, known: DataFrame) -> DataFrame:
    """id, status, ord, origin: a queue in memory merged with the one on disk; ``known`` holds the ids seen on disk before.

    Mine win.  Jobs on disk that I never knew are foreign and stay, in front; those I knew and dropped go.  Jobs without an
    id go.
    """
    foreign = disk.where("id IS NOT NULL").join(mine.select("id"), "id", "left_anti").join(known.select("id").distinct(), "id", "left_anti")
    rows = foreign.select("id", "status", "ord", F.lit(0).alias("side")).unionByName(mine.where("id IS NOT NULL").select("id", "status", "ord", F.lit(1).alias("side")))
    return rows.select("id", "status", "ord", F.when(F.col("side") == 0, "disk").otherwise("mine").alias("origin"))


def outcomes(jobs: DataFrame) -> DataFrame:
    """id, outcome, reason of jobs (id, source, found, error, sound_broken, recode_failed): the first rule that holds.

    Failed without a recorded source or where it isn't found, and on any error of the export but that it has no readable
    video: that is held for review, as is a result whose sound couldn't be rebuilt or that couldn't be coded anew.
    """
    error = F.coalesce("error", F.lit(""))
    rules = [
        (F.coalesce("source", F.lit("")) == "", "failed", "no source recorded"), (~F.col("found"), "failed", "source not found"), (F.lower(error).contains("no readable video"), "review", "no readable video"),
        (error != "", "failed", "export"), (F.col("sound_broken"), "review", "sound"), (F.col("recode_failed"), "review", "recode"),
    ]
    told = F.struct(F.lit("done").alias("outcome"), F.lit("").alias("reason"))
    for holds, outcome, reason in reversed(rules):
        told = F.when(holds, F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))).otherwise(told)
    return jobs.select("id", told.alias("x")).select("id", "x.outcome", "x.reason")


def status_counts(jobs: DataFrame) -> DataFrame:
    """status, n, first_ord."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def without_finished(jobs: DataFrame) -> DataFrame:
    """id, status, ord: unfinished jobs, held ones queued again, in order without gaps in each owner's queue."""
    left = jobs.where("status <> 'done'")
    place = F.row_number().over(W.partitionBy("owner").orderBy("ord")) - 1
    return left.select("owner", "id", F.when(F.col("status") == "held", "queued").otherwise(F.col("status")).alias("status"), place.cast("long").alias("ord"))


def settled(files: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Files not changed for so many minutes; all of them if 0 or less; files without a time aren't settled."""
    return files.where(F.lit(minutes <= 0) | (now - F.col("mtime") >= minutes * 60))


def to_process(files: DataFrame, ignored: DataFrame, processed: DataFrame, now: Column, minutes: int, by: str = "path") -> DataFrame:
    """path, state of each file: ignored, processed, unsettled or ready, by the first that holds.

    ``by`` is the column that tells files apart, where several may have one path.
    """
    flagged = lambda rows, name: rows.select(by).distinct().withColumn(name, F.lit(True))
    rows = files.join(flagged(ignored, "ig"), by, "left").join(flagged(processed, "pr"), by, "left")
    fresh = F.lit(minutes > 0) & (F.col("mtime").isNull() | (now - F.col("mtime") < minutes * 60))
    return rows.select("path", F.when(F.col("ig"), "ignored").when(F.col("pr"), "processed").when(fresh, "unsettled").otherwise("ready").alias("state"))


def pruned_log(log: DataFrame, files: DataFrame, roots: DataFrame, now: Column, grace: int) -> DataFrame:
    """path, missing_since, action for each processed path (path, root, missing_since).

    A present file's timer is cleared; one under a root that can't be reached keeps its state; a missing one starts its timer
    or, once that has run for ``grace`` (at once if 0), is forgotten.
    """
    rows = log.join(files.select("path").distinct().withColumn("present", F.lit(True)), "path", "left").join(roots.where("reachable").select("root", F.lit(True).alias("reachable")), "root", "left")
    since = F.coalesce("missing_since", now)
    action = F.when(F.col("present"), "keep").when(F.col("reachable").isNull(), "unreachable").when((now - since >= grace), "forget").otherwise("wait")
    out = rows.withColumn("action", action)
    kept = F.when(F.col("action") == "wait", since).when(F.col("action") == "unreachable", F.col("missing_since"))
    return out.select("path", F.coalesce(kept, F.lit(-1)).cast("long").alias("missing_since"), "action")


def last_seen(old: DataFrame, sightings: DataFrame, patterns: DataFrame, today: Column) -> DataFrame:
    """pattern, seen: the latest date a pattern was met on; new patterns count as met today, removed ones are forgotten."""
    met = old.select("pattern", "seen").unionByName(sightings.select("pattern", F.least("seen", today).alias("seen")))
    latest = met.groupBy("pattern").agg(F.max("seen").alias("seen"))
    return patterns.select("pattern").distinct().join(latest, "pattern", "left").select("pattern", F.coalesce("seen", today).alias("seen"))


def stale(seen: DataFrame, today: Column, months: int) -> DataFrame:
    """pattern, seen, age (whole months): patterns not met for so many months, the oldest first by date and then name."""
    age = F.greatest(F.lit(0), (F.year(today) * 12 + F.month(today)) - (F.year("seen") * 12 + F.month("seen")) - F.when(F.dayofmonth(today) < F.dayofmonth("seen"), 1).otherwise(0))
    return seen.where(F.col("seen") < F.add_months(today, -months)).select("pattern", "seen", age.cast("long").alias("age"))


#: Phases that are timed from their own start.
OWN_CLOCK = ("recode_audio", "recode_full", "rebuild_audio", "crop", "repair_audio")


def time_left(progress: DataFrame) -> DataFrame:
    """job, seq, left: time left by the progress so far; -1 where nothing can be told.

    ``progress`` has job, seq, at, phase, percent.  The clock starts at the first percent above 0; phases in ``OWN_CLOCK``
    have one of their own, which starts anew after any other phase.  A percent below 0 counts nothing and stops no clock;
    nothing can be told at it, at 0, from 100 on, or while no time has passed.  Without a percent the last estimate stands.
    """
    own = F.col("phase").isin(*OWN_CLOCK)
    w = W.partitionBy("job").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = F.col("percent") >= 0
    moved = F.when(F.col("percent") > 0, F.col("at"))
    rows = progress.withColumn("run", F.count(F.when(counted & ~own, 1)).over(w)).withColumn("start", F.first(moved, ignorenulls=True).over(w))
    of_run = W.partitionBy("job", "run").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.when(own, F.first(F.when(own, moved), ignorenulls=True).over(of_run)).otherwise(F.col("start"))
    rows = rows.withColumn("elapsed", F.col("at") - base)
    told = (F.col("percent") > 0) & (F.col("percent") < 100) & (F.col("elapsed") > 0)
    left = F.when(told, F.greatest(F.lit(0.0), F.round(F.col("elapsed") / (F.col("percent") / 100) - F.col("elapsed"), 3))).otherwise(-1.0)
    rows = rows.withColumn("own_left", F.when(F.col("percent").isNotNull(), left))
    return rows.select("job", "seq", F.coalesce(F.last("own_left", ignorenulls=True).over(w), F.lit(-1.0)).alias("left"))


def cache_keys(files: DataFrame, schema: int) -> DataFrame:
    """path, key: names a file's cached index by path, time and size, and the version of its schema."""
    return files.select("path", F.md5(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string"), F.lit(str(schema)))).alias("key"))
