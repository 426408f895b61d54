"""Byte plans, source lookup, validation tables and decision ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sized import small

PACKET = 188
MB = 1 << 20


def byte_plan(jobs: DataFrame) -> DataFrame:
    """id, first, last: bytes to copy of a file (id, size, mode, n_mb, start_mb).

    Mode is beginning, end or at.  A start that isn't the file's goes up to a whole packet, and the length down to whole
    packets, so what is copied may be a little less than was asked for.
    """
    down = lambda c: c - F.pmod(c, F.lit(PACKET))
    up = lambda c: down(c + PACKET - 1)
    size = F.col("size")
    want = F.greatest(F.lit(0), F.bround(F.col("n_mb").cast("double") * MB)).cast("long")
    begin = F.floor(F.greatest(F.lit(0.0), F.col("start_mb").cast("double")) * MB).cast("long")
    first = F.when(F.col("mode") == "beginning", 0).when(F.col("mode") == "end", F.least(up(F.greatest(F.lit(0), size - want)), size)).otherwise(F.least(up(begin), size))
    length = down(F.when(F.col("mode") == "end", size - first).otherwise(F.least(want, size - first)))
    return jobs.select("id", first.cast("long").alias("first"), (first + length).cast("long").alias("last"))


def keyframe_bytes(index: DataFrame, marks: DataFrame) -> DataFrame:
    """rec_id, id, from_byte, to_byte: where the last keyframe at or before a mark (a) begins, and the first one after its end (b), whole packets.

    ``index`` has rec_id, pts, cum_bytes, bytes, is_key; without an earlier keyframe 0, without a later one the end.
    """
    begin = F.col("cum_bytes") - F.col("bytes")
    down = lambda c: c - F.pmod(c, F.lit(PACKET))
    keys = index.where("is_key").select("rec_id", F.col("pts").alias("at"), begin.alias("byte"))
    total = index.groupBy("rec_id").agg(F.max("cum_bytes").alias("total"))
    null = F.lit(None).cast("long")
    rows = keys.select("rec_id", "at", "byte", null.alias("id"), F.lit(0).alias("kind"))
    rows = rows.unionByName(marks.select("rec_id", F.col("a").alias("at"), null.alias("byte"), "id", F.lit(1).alias("kind"))).unionByName(marks.select("rec_id", F.col("b").alias("at"), null.alias("byte"), "id", F.lit(-1).alias("kind")))
    # at the same time an end mark comes before nothing: keyframes at it don't count
    before = F.last("byte", ignorenulls=True).over(W.partitionBy("rec_id").orderBy("at", F.abs(F.col("kind"))).rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.last("byte", ignorenulls=True).over(W.partitionBy("rec_id").orderBy(F.desc("at"), F.desc(F.abs(F.col("kind")))).rowsBetween(W.unboundedPreceding, W.currentRow))
    both = rows.withColumn("before", before).withColumn("after", after).where("kind <> 0")
    out = both.groupBy("rec_id", "id").agg(F.max(F.when(F.col("kind") == 1, F.col("before"))).alias("f"), F.max(F.when(F.col("kind") == -1, F.col("after"))).alias("t"))
    return out.join(total, "rec_id").select("rec_id", "id", down(F.coalesce("f", F.lit(0))).alias("from_byte"), down(F.coalesce("t", "total")).alias("to_byte"))


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """A setting as a number within its bounds; what isn't a number is the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def resolved(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """id, path: the first existing candidate (id, order, path) of each source, by order; empty if none exists."""
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    rows = candidates.join(there, "path", "left")
    best = F.min(F.when(F.col("there"), F.struct("order", "path")))
    return rows.groupBy("id").agg(F.coalesce(best["path"], F.lit("")).alias("path"))


def fingerprint(content: Column, window: int = 4 << 20) -> Column:
    """sha256 over the size in digits and the first and last ``window`` bytes of binary content, which don't overlap."""
    n = F.octet_length(content)
    tail = F.greatest(F.lit(0), F.least(F.lit(window), n - window))
    digits = F.encode(n.cast("string"), "UTF-8")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(digits, F.substring(content, 1, window), F.when(tail > 0, content.substr(n - tail + 1, tail)).otherwise(F.lit(b""))), 256))


def incompatible(streams: DataFrame, allowed: DataFrame) -> DataFrame:
    """Streams (id, codec, container) that the table of allowed pairs (container, codec) doesn't hold."""
    return streams.join(small(allowed), ["container", "codec"], "left_anti").select("id", "codec", "container")


def even_box(width: Column, height: Column, top: Column, bottom: Column, left: Column, right: Column, interlaced: Column) -> Column:
    """What margins leave of a picture: struct of w, h, x, y, all even.

    Margins are cut down to even numbers, 0 at least.  Of interlaced pictures the height is a multiple of 4.  Where nothing
    would be left it is the whole picture.
    """
    even = lambda c: c - F.pmod(c, F.lit(2))
    held = lambda c: F.greatest(F.lit(0), even(c))
    rows = lambda c: F.when(interlaced, c - F.pmod(c, F.lit(4))).otherwise(even(c))
    w, h = even(width - held(left) - held(right)), rows(height - held(top) - held(bottom))
    none = (w <= 0) | (h <= 0)
    box = (F.when(none, even(width)).otherwise(w), F.when(none, rows(height)).otherwise(h), F.when(none, 0).otherwise(held(left)), F.when(none, 0).otherwise(held(top)))
    return F.struct(*[c.cast("long").alias(name) for c, name in zip(box, ("w", "h", "x", "y"), strict=True)])


def key_kinds(unit: Column, safe: Sequence[int], leading: Sequence[int]) -> Column:
    """``safe``, ``leading`` or ``other`` for a picture's unit type."""
    return F.when(unit.isin(*safe), "safe").when(unit.isin(*leading), "leading").otherwise("other")


#: Language codes that name no language.
NO_LANGUAGE = ("", "und", "mis", "mul", "zxx")


def default_subtitles(tracks: DataFrame) -> DataFrame:
    """rec_id, number, change, reason for each subtitle track that is shown by default; ``change`` where it should not be.

    ``tracks`` has rec_id, seq, kind (audio or subtitles), language, marked (default), forced.  Subtitles are numbered from
    1.  The sound to compare with is the first default one, else the first.  A forced track stays, as does one where either
    language isn't known or the two differ; the same language as the sound's is to be switched off.
    """
    low = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    told = tracks.withColumn("lang", F.when(low.isin(*NO_LANGUAGE), "").otherwise(low))
    first = F.min(F.struct((~F.col("marked")).alias("later"), "seq", "lang"))
    sound = told.where("kind = 'audio'").groupBy("rec_id").agg(first["lang"].alias("sound"))
    number = F.row_number().over(W.partitionBy("rec_id").orderBy("seq")).cast("long")
    shown = told.where("kind = 'subtitles'").withColumn("number", number).where("marked").join(sound, "rec_id", "left")
    reason = (
        F.when(F.col("forced"), "forced").when(F.col("sound").isNull(), "no sound").when(F.col("sound") == "", "sound not labelled")
        .when(F.col("lang") == "", "subtitles not labelled").when(F.col("lang") != F.col("sound"), "other language").otherwise("same language")
    )
    return shown.select("rec_id", "number", (reason == "same language").alias("change"), reason.alias("reason"))


def first_hit(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, hit, note: the best candidate (title, year, rank, hit) of the same title and year, else of the title alone, or a note.

    The best of each title and year, and of each title, are told before what is wanted meets them: it meets one row of each.
    """
    best = F.struct("rank", "hit")
    exact = candidates.where("title IS NOT NULL AND year IS NOT NULL").groupBy("title", "year").agg(F.min(best).alias("e"))
    loose = candidates.where("title IS NOT NULL AND hit IS NOT NULL").groupBy("title").agg(F.min(best).alias("l"))
    joined = wanted.join(exact, ["title", "year"], "left").join(loose, "title", "left")
    out = joined.groupBy("id").agg(F.min("e").alias("e"), F.min("l").alias("l"))
    note = F.when(F.col("e").isNotNull(), "").when(F.col("l").isNotNull(), "").otherwise("no match")
    return out.select("id", F.coalesce("e.hit", "l.hit", F.lit(-1)).alias("hit"), note.alias("note"))


def cache_put(cache: DataFrame, new: DataFrame, most: int, oldest: int) -> DataFrame:
    """key, size, used: a bounded cache after new entries: they replace their key, the latest ``most`` stay, and old ones go.

    An entry without a time is never too old.
    """
    rows = cache.join(new.select("key"), "key", "left_anti").unionByName(new)
    kept = rows.where(F.col("used").isNull() | (F.col("used") >= oldest))
    rank = F.row_number().over(W.partitionBy("shelf").orderBy(F.desc_nulls_last("used"), "key"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("shelf", "key", "size", F.coalesce("used", F.lit(-1)).alias("used"))


def segment_name(path: Column, number: Column, total: Column) -> Column:
    """A file name with the segment's number, filled with zeros, at the last ``#``, or in front of the extension."""
    digits = F.lpad(number.cast("string"), 9, "0")
    n = F.substring(digits, F.lit(10) - F.length(total.cast("string")), F.length(total.cast("string")))
    at_hash = F.concat(F.regexp_extract(path, r"(?s)^(.*)#[^#]*$", 1), n, F.regexp_extract(path, r"#([^#]*)$", 1))
    plain = F.concat(F.regexp_extract(path, r"(?s)^(.*?)(\.[^./]*)?$", 1), n, F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(path.contains("#"), at_hash).otherwise(plain)


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    """A setting that is one of a few words, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
