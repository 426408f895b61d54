"""Censuses and audits over tracks, streams and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_by(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def dominant_config(frames: DataFrame, samples_per_frame: int, rate: int) -> DataFrame:
    """rec_id, config, n, minority, bitrate: the commonest configuration, the one seen first of equals.

    Frames of under 7 bytes or without a configuration don't count.  Bits a second are cut to a whole number.
    """
    counted = frames.where("config IS NOT NULL AND size >= 7").groupBy("rec_id", "config").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("seq").alias("first"))
    total = F.sum("n").over(W.partitionBy("rec_id"))
    best = top_by(counted.withColumn("total", total), ["rec_id"], F.desc("n"), F.col("first"))
    bitrate = F.floor(F.col("bytes") * 8 * rate / (F.col("n") * samples_per_frame)).cast("long")
    return best.select("rec_id", "config", "n", (F.col("total") - F.col("n")).alias("minority"), bitrate.alias("bitrate"))


def commonest_box(rows: DataFrame) -> DataFrame:
    """rec_id, w, h, n: the commonest pair, the one of most area of equals, then the wider one."""
    counted = rows.groupBy("rec_id", "w", "h").agg(F.count("*").alias("n"))
    return top_by(counted, ["rec_id"], F.desc("n"), F.desc(F.col("w") * F.col("h")), F.desc("w"))


def track_census(expected: DataFrame, got: DataFrame, least: float = 0.9) -> DataFrame:
    """rec_id, track, expected, got, passed: frames of each track in the source and the result, matched by their order.

    Tracks without frames in the source are left out so that the rest line up.
    """
    counted = lambda rows, name: rows.groupBy("rec_id", "track").agg(F.count("*").alias(name))
    placed = lambda rows: rows.withColumn("place", F.row_number().over(W.partitionBy("rec_id").orderBy("track")))
    left, right = placed(counted(expected, "expected")), placed(counted(got, "got")).drop("track")
    joined = left.join(right, ["rec_id", "place"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return joined.select("rec_id", "track", "expected", "got", (F.col("got") >= F.col("expected") * least).alias("passed"))


def silent_tracks(packets: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """rec_id, track of tracks without a packet in any span (ends included)."""
    from .segments import in_spans

    heard = in_spans(packets, spans, "pts", width, closed=True).select("rec_id", "track").distinct()
    return packets.select("rec_id", "track").distinct().join(heard, ["rec_id", "track"], "left_anti")


def usable_tracks(tracks: DataFrame) -> DataFrame:
    """rec_id, track with channels and a rate, or that decode; where there is none the first track."""
    good = (F.col("channels") > 0) & (F.col("rate") > 0) | F.col("decodes")
    any_ = F.max(good.cast("int")).over(W.partitionBy("rec_id"))
    first = F.min("track").over(W.partitionBy("rec_id"))
    return tracks.withColumn("any", any_).withColumn("first", first).where(good | ((F.col("any") == 0) & (F.col("track") == F.col("first")))).select("rec_id", "track")


def join_target(entries: DataFrame, width: int = 1920, height: int = 1080, fps: float = 25.0) -> DataFrame:
    """list_id, w, h, fps, duration: the largest picture (the first of equals), the highest rate, the summed duration."""
    best = F.min(F.struct((-(F.col("w") * F.col("h"))).alias("area"), "seq", "w", "h"))
    agg = entries.groupBy("list_id").agg(best.alias("x"), F.max("fps").alias("fps"), F.sum("duration").alias("duration"))
    known = lambda c, other: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(other))
    return agg.select("list_id", known("x.w", width).alias("w"), known("x.h", height).alias("h"), known("fps", fps).alias("fps"), "duration")


def join_signatures(entries: DataFrame) -> DataFrame:
    """list_id, signatures, first_example, ok: distinct (codec, w, h, audio); a list joins without loss if it has one at most."""
    each = entries.groupBy("list_id", "codec", "w", "h", "audio").agg(F.min("seq").alias("example"))
    return each.groupBy("list_id").agg(F.count("*").alias("signatures"), F.min("example").alias("first_example")).withColumn("ok", F.col("signatures") <= 1)


def laid_end_to_end(entries: DataFrame) -> DataFrame:
    """list_id, seq, duration, start: where each entry begins in the joined result, and fades that fit into it."""
    before = F.sum("duration").over(W.partitionBy("list_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    fade_in = F.least("fade_in", "duration")
    return entries.select("list_id", "seq", "duration", F.coalesce(before, F.lit(0)).alias("start"), fade_in.alias("fade_in"), F.least(F.col("fade_out"), F.col("duration") - fade_in).alias("fade_out"))


def export_drift(jobs: DataFrame) -> DataFrame:
    """rec_id, reported, drift, tolerance, fine: how long a result is (``actual``, seconds) against what its frames should last.

    ``jobs`` has rec_id, produced, expected (frames), actual, fps, scenes, collapsed.  Of recordings whose half pictures were
    joined the expected number is reported.  Two frames a scene may differ, and a second always; without a rate there is no
    drift, and 25 counts for the tolerance.
    """
    rate = F.when(F.col("fps") > 0, F.col("fps"))
    wanted = F.coalesce(F.col("expected") / rate, F.lit(0.0))
    known = (F.coalesce("actual", F.lit(0.0)) != 0) & (wanted != 0)
    drift = F.when(known, F.col("actual") - wanted).otherwise(0.0)
    tolerance = F.greatest(F.lit(1.0), F.greatest(F.lit(1), F.col("scenes")) * 2.0 / F.coalesce(rate, F.lit(25.0)))
    reported = F.when(F.col("collapsed"), F.col("expected")).otherwise(F.col("produced"))
    return jobs.select("rec_id", reported.alias("reported"), F.round(drift, 6).alias("drift"), F.round(tolerance, 6).alias("tolerance"), (F.abs(F.round(drift, 6)) <= F.round(tolerance, 6)).alias("fine"))


def bitrate_budget(files: DataFrame, audio: DataFrame, least: int = 500, unknown: int = 8000) -> DataFrame:
    """rec_id, kbps: what a container's rate leaves for pictures, ``least`` at least.

    ``files`` has rec_id, rate (bits a second), size and duration; where no rate is told, size and duration give it, or it is
    ``unknown``.  ``audio`` has rec_id and rate; all rates are cut to whole thousands.
    """
    sound = audio.groupBy("rec_id").agg(F.floor(F.sum("rate") / 1000).cast("long").alias("sound"))
    told = F.floor(F.col("rate") / 1000).cast("long")
    made = F.floor(F.col("size") * 8 / F.when(F.col("duration") > 0, F.col("duration")) / 1000).cast("long")
    whole = F.when(told > 0, told).otherwise(F.coalesce(made, F.lit(unknown)))
    return files.join(sound, "rec_id", "left").select("rec_id", F.greatest(F.lit(least), whole - F.coalesce("sound", F.lit(0))).cast("long").alias("kbps"))


def retained(files: DataFrame, cutoff: Column, newest: int) -> DataFrame:
    """Files (root, path, mtime) no older than the cutoff, and of those the ``newest`` of each root."""
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("mtime"), "path"))
    return files.where(F.col("mtime") >= cutoff).withColumn("rank", rank).where(F.col("rank") <= newest).drop("rank")


#: Modifiers of key combinations.
MODIFIERS = ("ctrl", "shift", "alt")


def _bindings(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    parts = F.transform(F.split("keys", r"\+"), lambda x: F.trim(x))
    mods = F.array_sort(F.array_distinct(F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.lower(x)), lambda x: x.isin(*MODIFIERS))))
    named = bindings.where("trim(keys) <> ''").withColumns({"mods": mods, "key": F.lower(F.element_at(parts, -1))})
    return named.join(keys.select(F.lower("key").alias("key")).distinct().withColumn("known", F.lit(True)), "key", "left")


def shared_bindings(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """combo, actions: key combinations that more than one action (action, keys) is bound to.

    Modifiers count in any order and case and once, what isn't one doesn't; the key is the last part.  Keys that aren't in
    the table of keys (key) are left to :func:`unknown_bindings`.
    """
    known = _bindings(bindings, keys).where("known").withColumn("combo", F.concat_ws("+", "mods", "key"))
    return known.groupBy("combo").agg(F.count("action").alias("actions")).where("actions > 1")


def unknown_bindings(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """action, keys of combinations whose key isn't known, which would never be met."""
    return _bindings(bindings, keys).where("known IS NULL").select("action", "keys")


def first_per_index(streams: DataFrame) -> DataFrame:
    """One row per stream index of a file: the first one listed."""
    return top_by(streams, ["rec_id", "index"], F.col("seq"))


#: A service name that a remuxer makes up.
GENERIC_SERVICE = r"(?i)^service\s*0*\d+$"


def channel_keys(programmes: DataFrame) -> DataFrame:
    """rec_id, channel: the first service name that isn't generic, else the first programme number over 1 as ``sid:n``, else empty."""
    name = F.trim(F.coalesce("service", F.lit("")))
    named = F.min(F.when((name != "") & ~name.rlike(GENERIC_SERVICE), F.struct("seq", name.alias("v"))))
    numbered = F.min(F.when(F.col("number").isNotNull() & ~F.col("number").isin(0, 1), F.struct("seq", F.concat(F.lit("sid:"), F.col("number").cast("string")).alias("v"))))
    return programmes.groupBy("rec_id").agg(F.coalesce(named["v"], numbered["v"], F.lit("")).alias("channel"))
