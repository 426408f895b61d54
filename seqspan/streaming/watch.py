"""Watched folders as Structured Streaming jobs: files seen once, files settled, patterns last met, sessions of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A listing event: a file as a scan of the watched roots found it.
LISTING = "path string, root string, mtime long, size long, at timestamp"


def listings(spark: SparkSession, folder: str, schema: str = LISTING) -> DataFrame:
    """A stream of listing events that scans write as Parquet to ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(files: DataFrame) -> DataFrame:
    """Each path once, for ever: its state is the paths met so far.  :func:`scan` keeps them in a table instead."""
    return files.dropDuplicates(["path"])


#: What a scan has dealt with: the batch that did, the path and when it was seen.
DONE = "path string, mtime long, size long, at timestamp"


def scan(files: DataFrame, ignored: DataFrame, folder: str, checkpoint: str, minutes: int, interval: str | None = None) -> StreamingQuery:
    """Deals with each settled file once: a stream of listings against a table of what was dealt with.

    Every batch is a scan: its newest listing of each path is left alone if the path is ignored (``ignored``: path) or was
    dealt with before, or has changed within ``minutes`` of the listing; the rest is added to ``folder``, a table by batch.  A
    batch that is repeated after a failure replaces what it wrote, so that nothing is dealt with twice, and files that come
    back much later aren't either.  The table is what grows; the stream itself keeps no state.  With an ``interval`` the
    scans go on, else they take what is there and stop.
    """
    spark = files.sparkSession
    left_out = ignored.select("path").distinct()

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max(F.struct("at", "mtime", "size")).alias("x")).select("path", "x.mtime", "x.size", "x.at")
        fresh = newest.join(left_out, "path", "left_anti")
        before = spark.read.schema(f"{DONE}, batch long").parquet(folder) if _exists(spark, folder) else None
        if before is not None:
            fresh = fresh.join(before.where(F.col("batch") != number).select("path"), "path", "left_anti")
        ready = fresh.where(F.lit(minutes <= 0) | (F.unix_seconds("at") - F.col("mtime") >= minutes * 60))
        ready.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dealt_with(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime, size, at of what scans to ``folder`` dealt with."""
    return spark.read.schema(f"{DONE}, batch long").parquet(folder).drop("batch")


def _exists(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def settled(files: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """path, root, mtime, size of each file once it hasn't changed for ``seconds``: state by path, timers in event time.

    A change starts the wait again; a file is given once for each time it settles, and a row of state for each path
    remembers that it was.  For folders whose files come and go without end, :func:`scan` keeps that in a table.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        if state.hasTimedOut:
            # the state stays, so that the same file isn't given again
            if known and not known[3]:
                state.update((*known[:3], True))
                yield pd.DataFrame({"path": [key[0]], "root": [known[0]], "mtime": [known[1]], "size": [known[2]]})
            return
        newest = known
        latest = 0
        for rows in batches:
            for r in rows.sort_values("at").itertuples():
                latest = max(latest, int(pd.Timestamp(r.at).timestamp() * 1000))
                if newest is None or newest[1] != r.mtime or newest[2] != r.size:
                    newest = (r.root, int(r.mtime), int(r.size), False)
        due = newest[1] * 1000 + seconds * 1000
        if not newest[3] and latest >= due:
            yield pd.DataFrame({"path": [key[0]], "root": [newest[0]], "mtime": [newest[1]], "size": [newest[2]]})
            newest = (*newest[:3], True)
        state.update(newest)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return files.withWatermark("at", delay).groupBy("path").applyInPandasWithState(
        step, "path string, root string, mtime long, size long", "root string, mtime long, size long, given boolean", "append", "EventTimeTimeout"
    )


def sessions(samples: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """rec_id, t0, t1, n of runs of flagged samples (rec_id, ts, on) without a gap above ``gap``, once they are over.

    A run ends at its last sample, which the window's end lies one gap behind.
    """
    window = F.session_window("ts", gap)
    runs = samples.withWatermark("ts", delay).where("on").groupBy("rec_id", window).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))
    return runs.select("rec_id", "t0", "t1", "n")


def last_met(matches: DataFrame) -> DataFrame:
    """pattern, seen: the latest date on which each pattern (pattern, seen) was met, for update mode."""
    return matches.groupBy("pattern").agg(F.max("seen").alias("seen"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a later run goes on from the checkpoint, so nothing is given twice."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: A scan's rows: the files it found, and for each root, with a null path, whether it could be reached.
SCANNED = "path string, root string, reachable boolean, at timestamp"
#: What was processed, and since when it has been missing (seconds; null while it isn't).
KNOWN = "path string, root string, missing_since long"


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of scans, one file each, in the order in which they were written."""
    return spark.readStream.schema(SCANNED).option("maxFilesPerTrigger", 1).parquet(folder)


def known_after(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, int]:
    """(path, root, missing_since; the scan) as the last scan left them, or the last one in front of ``before``."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = []
    for status in fs.listStatus(fs_path):
        name = status.getPath().getName()
        marked = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("scan=") and fs.exists(marked):
            done.append(int(name.removeprefix("scan=")))
    number = max(n for n in done if before is None or n < before)
    return spark.read.schema(KNOWN).parquet(f"{folder}/scan={number}"), number


def start_known(processed: DataFrame, folder: str) -> None:
    """Begins a table of what was processed (path, root), for :func:`absences`."""
    processed.select("path", "root", F.lit(None).cast("long").alias("missing_since")).write.parquet(f"{folder}/scan=-1")


def absences(scanned: DataFrame, folder: str, checkpoint: str, grace: int, interval: str | None = None) -> StreamingQuery:
    """Forgets processed files that have been missing for ``grace`` seconds, scan by scan.

    A file that a scan doesn't name starts its time, one that is named again has none, and while its root can't be reached it
    keeps what it had.  The state is a table by scan in ``folder`` (:func:`start_known` begins it), of which each scan writes
    the next version from the one before: a scan that is repeated after a failure, or a restart, gives the same.  Only the
    newest two versions stay.  It follows :func:`operators.jobs.pruned_log`.
    """
    from ..operators.jobs import pruned_log

    spark = scanned.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(F.unix_seconds("at"))).first()[0]
        if now is None:
            return
        log, last = known_after(spark, folder, number)
        roots = batch.where("path IS NULL").groupBy("root").agg(F.bool_and("reachable").alias("reachable"))
        told = pruned_log(log, batch.where("path IS NOT NULL").select("path"), roots, F.lit(now), grace).where("action <> 'forget'")
        kept = log.select("path", "root").join(told, "path").select("path", "root", F.when(F.col("missing_since") >= 0, F.col("missing_since")).alias("missing_since"))
        kept.write.mode("overwrite").parquet(f"{folder}/scan={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scan={last - 1}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    writer = scanned.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def reordered(packets: DataFrame, depth: int = 15) -> DataFrame:
    """rec_id, seq, pts of a stream of pictures (rec_id, seq, pts, dts, last) as :func:`operators.carry.reordered` lets go of them.

    The state of a recording is what its buffer holds; ``last`` marks its last picture, with which the others leave.  A
    recording's pictures have to come in order, batch by batch.
    """
    from ..operators.carry import ReorderBuffer

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, now = state.get if state.exists else ([], None)
        buffer = ReorderBuffer(depth, [(x["pts"], x["seq"], x["known"]) if isinstance(x, dict) else tuple(x) for x in held], now)
        whole = lambda x: None if pd.isna(x) else int(x)
        rows = pd.concat(list(batches)).sort_values("seq")
        left: list[tuple] = []
        for r in rows.itertuples():
            left += buffer.push(int(r.seq), whole(r.pts), whole(r.dts))
        if rows["last"].any():
            left += buffer.flush()
            state.remove()
        else:
            state.update(([(int(p), int(s), bool(k)) for p, s, k in buffer.held], buffer.now))
        if left:
            yield pd.DataFrame({"rec_id": [key[0]] * len(left), "seq": [s for s, _ in left], "pts": pd.array([p for _, p in left], dtype="Int64")})

    return packets.groupBy("rec_id").applyInPandasWithState(step, "rec_id long, seq long, pts long", "held array<struct<pts: bigint, seq: bigint, known: boolean>>, now long", "append", "NoTimeout")
