"""Broadcasts behind a count, and the choice of rows by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import discard, shared_folder, written

__all__ = ["column", "columns", "discard", "row_prints", "shared_folder", "small_enough", "unused", "without_ids", "without_rows", "written"]

#: Ids up to this many are sent to every executor (16 bytes each or so); beyond it the join shuffles.
BROADCAST_IDS = 500_000


def small_enough(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.  ``df`` should be a written table."""
    return F.broadcast(df) if df.count() <= most else df


def without_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids`` (one column of that name); null keys stay."""
    return docs.join(small_enough(ids), key, "left_anti")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``."""
    return [column(c) for c in df.columns]


def _hashable(field: T.StructField) -> Column:
    name = column(field.name)
    return F.to_json(F.struct(name)) if "map<" in field.dataType.simpleString() else name


def row_prints(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row: equal for equal rows only (128 bits)."""
    cells = [x for f in df.schema.fields for x in (_hashable(f), _hashable(f).isNull())]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def without_rows(docs: DataFrame, lost: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose prints are in ``lost`` (columns a and b), in its own columns.

    Rows whose prints are in ``repeated`` are equal in all columns, and one of each stays.  Both tables are written ones;
    they are broadcast if they are small.
    """
    a, b = unused(docs, "print_a", "print_b")
    first, second = row_prints(docs)
    marked = docs.withColumns({a: first, b: second})
    lost = lost.select(F.col("a").alias(a), F.col("b").alias(b))
    if repeated is None or repeated.isEmpty():
        return marked.join(small_enough(lost), [a, b], "left_anti").drop(a, b)
    again = repeated.select(F.col("a").alias(a), F.col("b").alias(b))
    left = marked.join(small_enough(lost), [a, b], "left_anti")
    # equal rows are combined in the tasks that read them before they are shuffled
    one = left.join(small_enough(again), [a, b], "left_semi").groupBy(a, b).agg(F.first(F.struct(*columns(docs))).alias("row"))
    return left.join(small_enough(again), [a, b], "left_anti").drop(a, b).unionByName(one.select("row.*"))
