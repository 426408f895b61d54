import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from seqspan.operators import carry, jobs
from seqspan.streaming import watch

T0 = datetime(2024, 1, 1)


def scan(spark, folder, minute, files):
    at = T0 + timedelta(minutes=minute)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    rows = [(p, "r", base + m * 60, s, at) for p, m, s in files]
    spark.createDataFrame(rows, watch.LISTING).coalesce(1).write.mode("append").parquet(folder)


def test_each_path_once_over_several_runs(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    scan(spark, folder, 0, [("a", 0, 1), ("b", 0, 1)])
    watch.run_available(watch.first_seen(watch.listings(spark, folder)), out, state)
    scan(spark, folder, 10, [("a", 0, 1), ("c", 9, 1)])
    watch.run_available(watch.first_seen(watch.listings(spark, folder)), out, state)
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_files_settle(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for minute, files in ((1, [("a", 0, 1), ("b", 0, 1)]), (6, [("a", 5, 2), ("b", 0, 1)]), (30, [("a", 5, 2), ("b", 0, 1)])):
        scan(spark, folder, minute, files)
        watch.run_available(watch.settled(watch.listings(spark, folder), 300, "0 seconds"), out, state)
    got = sorted((r.path, r.size) for r in spark.read.parquet(out).collect())
    assert got == [("a", 2), ("b", 1)]


def test_sessions_end_by_the_gap(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, T0 + timedelta(seconds=s), True) for s in (0, 8, 16, 25, 2000)]
    spark.createDataFrame(rows, "rec_id long, ts timestamp, on boolean").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("rec_id long, ts timestamp, on boolean").parquet(folder)
    watch.run_available(watch.sessions(stream, "9 seconds", "1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.n, (r.t1 - r.t0).seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(4, 25)]


def test_a_scan_deals_with_each_settled_file_once(spark, tmp_path):
    folder, done, state = (str(tmp_path / x) for x in ("in", "done", "state"))
    ignored = spark.createDataFrame([("skip",)], "path string")
    run = lambda: watch.scan(watch.listings(spark, folder), ignored, done, state, 5).awaitTermination()
    scan(spark, folder, 1, [("a", -10, 1), ("b", 0, 1), ("skip", -60, 1)])
    run()
    assert sorted(r.path for r in watch.dealt_with(spark, done).collect()) == ["a"]
    scan(spark, folder, 20, [("a", 15, 2), ("b", 18, 2), ("c", 2, 1)])
    run()
    assert sorted(r.path for r in watch.dealt_with(spark, done).collect()) == ["a", "c"]
    scan(spark, folder, 60 * 24 * 3, [("a", 15, 2), ("b", 18, 2)])
    run()
    assert sorted((r.path, r.size) for r in watch.dealt_with(spark, done).collect()) == [("a", 1), ("b", 2), ("c", 1)]


def test_absences_follow_the_log_across_restarts(spark, tmp_path):
    folder, known, state = (str(tmp_path / x) for x in ("in", "known", "state"))
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    log = [("a", "r"), ("b", "r"), ("c", "q"), ("d", "r")]
    watch.start_known(spark.createDataFrame(log, "path string, root string"), known)
    want = {p: (r, None) for p, r in log}
    steps = [(0, "ab", "rq"), (10, "a", "r"), (20, "abd", "q"), (50, "a", "rq"), (75, "abc", "rq"), (200, "", ""), (300, "c", "rq")]
    for n, (minute, there, up) in enumerate(steps):
        at = T0 + timedelta(minutes=minute)
        rows = [(p, None, None, at) for p in there] + [(None, r, r in up, at) for r in "rq"]
        spark.createDataFrame(rows, watch.SCANNED).coalesce(1).write.mode("append").parquet(folder)
        # every run is a restart; some scans come two to a run
        if n % 3 != 1:
            watch.absences(watch.scans(spark, folder), known, state, 3600).awaitTermination()
            got = {r.path: (r.root, r.missing_since) for r in watch.known_after(spark, known)[0].collect()}
        rows = spark.createDataFrame([(p, r, m) for p, (r, m) in want.items()], watch.KNOWN)
        roots = spark.createDataFrame([(r, r in up) for r in "rq"], "root string, reachable boolean")
        told = jobs.pruned_log(rows, spark.createDataFrame([(p,) for p in there] or [("-",)], "path string"), roots, F.lit(base + minute * 60), 3600).collect()
        want = {r.path: (want[r.path][0], r.missing_since if r.missing_since >= 0 else None) for r in told if r.action != "forget"}
        if n % 3 != 1:
            assert got == want
    assert set(want) == {"a", "b", "c"}  # d was gone for over an hour


def test_a_stream_reorders_as_the_batch_does(spark, tmp_path):
    random.seed(4)
    rows = []
    for rec in range(3):
        for seq in range(120):
            pts = None if rec == 1 and seq % 31 == 5 else seq * 40 + random.choice([0, 0, 80, -1500 if rec == 2 else 200])
            rows.append((rec, seq, pts, seq * 40 if seq % 6 else None, seq == 119))
    packets = spark.createDataFrame(rows, "rec_id long, seq long, pts long, dts long, last boolean")
    want = [(r.rec_id, r.seq, r.pts) for r in carry.reordered(packets).orderBy("rec_id", "place").collect()]
    assert [x[1] for x in want if x[0] == 2] != sorted((x[1] for x in want if x[0] == 2), key=lambda s: rows[240 + s][2])
    folder, state = (str(tmp_path / x) for x in ("in", "state"))
    got = {rec: [] for rec in range(3)}
    for a in (0, 25, 26, 90):
        b = {0: 25, 25: 26, 26: 90, 90: 120}[a]
        packets.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(packets.schema).parquet(folder)
        keep = lambda batch, _: [got[r.rec_id].append(tuple(r)) for r in batch.collect()]
        # every run is a restart
        watch.reordered(stream).writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert [x for rec in range(3) for x in got[rec]] == want
