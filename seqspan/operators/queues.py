"""A batch queue: what a run does to it, edits of its order, staged files, latest requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Statuses that a run passes by.
PASSED_BY = ("done", "review")


def _flags(jobs: DataFrame, *names: str) -> DataFrame:
    """``jobs`` with null flags as false."""
    return jobs.withColumns({c: F.coalesce(c, F.lit(False)) for c in names})


def _fixed(*statuses: str) -> Column:
    """Rows that edits leave where they are: those exported elsewhere, and those in one of the statuses."""
    return F.coalesce("external", F.lit(False)) | F.coalesce(F.col("status").isin(*statuses), F.lit(False))


def run_queue(jobs: DataFrame) -> DataFrame:
    """owner, ord, id, status after a run over each owner's queue, in order.

    ``jobs`` has owner, ord, id, status, external (exported elsewhere), result (done, review, failed or cancelled, if it is
    tried), stop (the run is stopped while it is tried) and finish (the run is asked to end after it).  Jobs exported
    elsewhere, done and held ones are passed by; the one that a stop meets is cancelled, and what follows stays as it was.
    Null flags count as false.
    """
    jobs = _flags(jobs, "external", "stop", "finish")
    tried = ~F.col("external") & ~F.coalesce(F.col("status").isin(*PASSED_BY), F.lit(False))
    before = W.partitionBy("owner").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    ends = F.max((tried & (F.col("stop") | F.col("finish"))).cast("int")).over(before)
    rows = jobs.withColumn("tried", tried).withColumn("over", F.coalesce(ends, F.lit(0)) > 0)
    status = F.when(F.col("over") | ~F.col("tried"), F.col("status")).when(F.col("stop"), "cancelled").otherwise(F.col("result"))
    return rows.select("owner", "ord", "id", status.alias("status"), (F.col("tried") & ~F.col("over")).alias("tried"), "over", "external")


def run_totals(after: DataFrame) -> DataFrame:
    """owner, completed, failed, held of a run's result (:func:`run_queue`); what comes after its end doesn't count."""
    seen = _flags(after, "external").where("NOT over AND NOT external")
    n = lambda status: F.count(F.when(F.col("status") == status, 1))
    return seen.groupBy("owner").agg(n("done").alias("completed"), F.count(F.when(F.col("tried") & (F.col("status") == "failed"), 1)).alias("failed"), n("review").alias("held"))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("ord", (F.row_number().over(W.partitionBy("owner").orderBy(*order)) - 1).cast("long"))


def removed(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """owner, ord, id, status without the given rows (owner, ord), but for those that run, here or elsewhere."""
    left = jobs.join(rows.distinct().withColumn("gone", F.lit(True)), ["owner", "ord"], "left").where(F.col("gone").isNull() | _fixed("running"))
    return _numbered(left.drop("gone"), F.col("ord")).select("owner", "ord", "id", "status")


def to_end(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """owner, ord, id, status with one row of each owner (owner, ord) at the end; running and done ones stay where they are."""
    marked = jobs.join(rows.withColumn("moves", F.lit(True)), ["owner", "ord"], "left").withColumn("back", F.coalesce("moves", F.lit(False)) & ~_fixed("running", "done"))
    return _numbered(marked, F.col("back"), F.col("ord")).select("owner", "ord", "id", "status")


def moved(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """owner, ord, id, status after one row of each owner (owner, ord, delta) has changed places with the one ``delta`` away.

    Nothing changes where either is running or done, or where there is none.
    """
    state = jobs.select("owner", "ord", "status")
    other = steps.withColumn("to", F.col("ord") + F.col("delta"))
    pair = other.join(state.withColumnRenamed("status", "one"), ["owner", "ord"]).join(state.select("owner", F.col("ord").alias("to"), F.col("status").alias("two")), ["owner", "to"])
    stays = lambda c: F.coalesce(F.col(c).isin("running", "done"), F.lit(False))
    pair = pair.where(~stays("one") & ~stays("two") & (F.col("to") != F.col("ord")))
    swaps = pair.select("owner", "ord", "to").unionByName(pair.select("owner", F.col("to").alias("ord"), F.col("ord").alias("to")))
    return jobs.join(swaps, ["owner", "ord"], "left").select("owner", F.coalesce("to", "ord").alias("ord"), "id", "status")


def same_path(path: Column) -> Column:
    """A path without doubled slashes, single dots and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/\.(?=/)", ""), "/+", "/"), "(?<=.)/$", ""))


def path_counts(jobs: DataFrame) -> DataFrame:
    """path, n, pending, held: jobs by the recording they are for, whatever way its path is written."""
    pending = ~F.col("status").isin(*PASSED_BY) & ~F.coalesce("external", F.lit(False))
    return jobs.groupBy(same_path(F.col("path")).alias("path")).agg(F.count("*").alias("n"), F.count(F.when(pending, 1)).alias("pending"), F.count(F.when(F.col("status") == "review", 1)).alias("held"))


def worth_keeping(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """id, status: jobs without the done ones of which what they refer to (the result, else the project) is gone."""
    ref = jobs.withColumn("path", F.coalesce(F.when(F.col("result") != "", F.col("result")), F.col("project")))
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    return ref.join(there, "path", "left").where((F.col("status") != "done") | F.col("there")).select("id", "status")


def orphaned(staged: DataFrame, mine: DataFrame, disk: DataFrame, now: Column, age: int) -> DataFrame:
    """path of staged projects (path, mtime) of no job in either queue (path) that are at least ``age`` seconds old."""
    used = mine.select(same_path(F.col("path")).alias("key")).unionByName(disk.select(same_path(F.col("path")).alias("key"))).where("key IS NOT NULL").distinct()
    rows = staged.where(F.lower("path").rlike(r"\.(vprj|swproj|vjr)$") & (F.col("mtime") <= now - age)).withColumn("key", same_path(F.col("path")))
    return rows.join(used, "key", "left_anti").select("path")


def latest(requests: DataFrame, target: Column | None = None) -> DataFrame:
    """key, seq, value: the newest request of each key (seq), of those whose ``at`` isn't past ``target`` where that is given."""
    rows = requests if target is None else requests.where(F.col("at") <= target)
    best = rows.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("x"))
    return best.select("key", "x.seq", "x.value")


def pruned_patterns(patterns: DataFrame, dropped: DataFrame, matches: DataFrame, processed: DataFrame) -> DataFrame:
    """kind, text: what a list of patterns (line_no, text) leaves behind once some are dropped.

    ``marked`` are files that a dropped pattern matches (``matches``: path, pattern) and that weren't processed: they count as
    processed from now on, so that dropping a pattern doesn't bring back what it held off.  ``line`` are the lines that stay.
    """
    marked = matches.join(dropped.select("pattern").distinct(), "pattern", "left_semi").select("path").distinct().join(processed.select("path"), "path", "left_anti")
    return marked.select(F.lit("marked").alias("kind"), F.col("path").alias("text")).unionByName(kept_lines(patterns, dropped).select(F.lit("line").alias("kind"), "text"))


def kept_lines(lines: DataFrame, dropped: DataFrame) -> DataFrame:
    """line_no, text of a list without the dropped entries; notes, blank lines and the order stay.  Case and blanks round them don't count."""
    wanted = dropped.select(F.lower(F.trim("pattern")).alias("entry")).where("entry <> ''").distinct()
    entry = F.lower(F.trim("text"))
    rows = lines.withColumn("entry", F.when((F.trim("text") != "") & ~F.trim("text").startswith("#"), entry))
    return rows.join(wanted, "entry", "left_anti").select("line_no", "text")
