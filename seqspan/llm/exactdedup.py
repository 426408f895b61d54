"""Exact dedup by skew-safe combining: local winners, then winners of salted digest groups, then of salts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import row_prints, without_rows, written

_WHITE = bytes([9, 10, 11, 12, 13, 32])
#: Bytes of distinct texts that a task holds while it combines locally.
WINDOW_BYTES = 32 << 20
SALTS = 16


def _prints(text: str | None) -> tuple[bytes, str, int, int]:
    raw = (text or "").encode()
    body = raw.translate(None, _WHITE)
    check = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
    return body, hashlib.sha256(body).hexdigest(), check, len(text or "")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_prints(t)[1:] for t in b.column("text").to_pylist()]
        sha, check, points = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("a"), b.column("b"), pa.array(sha, pa.string()), pa.array(check, pa.int64()), pa.array(points, pa.int64())],
            ["doc_id", "a", "b", "sha", "check", "points"],
        )


def _local_winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(sha, check, order[0], None if order[1] is False else ~order[2], order[3], order[4], n, body) for body, (sha, check, order, n) in held.items()]
        columns = zip(*rows, strict=True) if rows else ((),) * 8
        kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sha", "check", "points", "doc_id", "a", "b", "n", "body"])

    for batch in batches:
        for doc_id, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a", "b", "text")), strict=True):
            body, sha, check, points = _prints(text)
            order = (points, doc_id is not None, ~(doc_id or 0), a, b)
            v = held.get(body)
            if v is None:
                held[body] = [sha, check, order, 1]
                size += len(body)
                if size >= WINDOW_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
                continue
            v[3] += 1
            v[2] = max(v[2], order)
    yield flush()


def _best() -> list[Column]:
    """The winner among equal texts: most code points, then smallest doc_id, null ids last, then the greatest print."""
    order = F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.col("doc_id")).alias("inverse"), "a", "b")
    return [F.max(order).alias("best"), F.sum("n").alias("n")]


def _spread() -> list[Column]:
    return [F.col("best.points").alias("points"), F.bitwise_not(F.col("best.inverse")).alias("doc_id"), F.col("best.a").alias("a"), F.col("best.b").alias("b"), "n"]


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the prints (a, b) of each row over all its columns."""
    a, b = row_prints(docs)
    return docs.select("doc_id", "text", a.alias("a"), b.alias("b"))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text of ``rows`` (doc_id, text, a, b): sha, check, keep_id, win_a, win_b, group_size.

    Texts are grouped by their whole content at each of the three stages: in a task's window, within a digest and salt,
    and over the salts.  A digest of 256 + 64 bits that two contents share would show as two rows and stops the job.
    """
    local = rows.mapInArrow(_local_winners, "sha string, check long, points long, doc_id long, a long, b long, n long, body binary")
    salted = local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("sha", "check", "salt", "body").agg(*_best()).select("sha", "check", "body", *_spread())
    final = merged.groupBy("sha", "check", "body").agg(*_best()).select("sha", "check", *_spread())
    alone = final.groupBy("sha", "check").agg(F.count("*").alias("contents"), F.first(F.struct("doc_id", "a", "b", "n")).alias("x"))
    clash = F.raise_error(F.concat(F.lit("two texts share the digest "), F.col("sha"))).cast("long")
    group_size = F.when(F.col("contents") == 1, F.col("x.n")).otherwise(clash)
    return alone.select("sha", "check", F.col("x.doc_id").alias("keep_id"), F.col("x.a").alias("win_a"), F.col("x.b").alias("win_b"), group_size.alias("group_size"))


def _judged(docs: DataFrame, salts: int) -> DataFrame:
    rows = _printed(docs)
    members = rows.mapInArrow(_members, "doc_id long, a long, b long, sha string, check long, points long")
    best = written(winners(rows, salts), "winners")  # a table of its own: Spark then splits the hot digests of the join
    joined = members.join(best.hint("merge"), ["sha", "check"])
    return joined.withColumn("kept", (F.col("a") == F.col("win_a")) & (F.col("b") == F.col("win_b")))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Groups rows of ``docs`` (doc_id, text; other columns are ignored) by text without ``[\\x20\\x09-\\x0D]``.

    Returns a row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.  Null text counts as empty, and
    empty texts form a group like any other.  The row with the most code points stays, then the smallest doc_id; null ids
    come last.  Rows that repeat an id with equal texts of the same length but other white space are told apart by a hash;
    rows that repeat both the winner's id and its whole text are the same document and carry kept alike.  An empty table
    gives an empty result; very long texts are whole in one row and never cut.
    """
    out = _judged(docs.select("doc_id", "text"), salts)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts; the columns stay as they are.

    Rows are judged one by one, whatever their ids: the row that :func:`exact_dedup` would keep stays, of rows that tie in
    length and id the one with the greatest hash over all columns, and of rows that are equal in all columns one.  So a
    text of a repeated or null doc_id is never lost.  Null texts count as empty; an empty table stays empty.
    """
    judged = written(_judged(docs, SALTS).select("a", "b", "kept"), "judged")
    lost = written(judged.where("NOT kept").select("a", "b").distinct(), "copies")
    repeated = written(judged.where("kept").groupBy("a", "b").count().where("count > 1").select("a", "b"), "repeated")
    return without_rows(docs, lost, repeated)
