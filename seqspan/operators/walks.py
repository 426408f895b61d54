"""Ordered walks over groups of rows, where a step depends on what was kept before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a result batch.
BATCH = 10_000


def by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``step(key, rows)`` over the rows of each key in the given order, as one stream a task.

    Rows are dealt by key and sorted by Spark, and reach ``step`` one at a time, so a group is never held as a whole unless
    ``step`` does.  ``schema`` is that of the tuples ``step`` gives.
    """
    names = [c for c in rows.columns if c not in keys]
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[tuple, tuple]]:
            for b in batches:
                ids = zip(*(b.column(c).to_pylist() for c in keys), strict=True)
                yield from zip(ids, zip(*(b.column(c).to_pylist() for c in names), strict=True), strict=True)

        def made() -> Iterator[tuple]:
            source = stream()
            ahead = next(source, None)
            while ahead is not None:
                key = ahead[0]

                def own(key: tuple = key) -> Iterator[tuple]:
                    nonlocal ahead
                    while ahead is not None and ahead[0] == key:
                        row = ahead[1]
                        ahead = next(source, None)
                        yield row

                group = own()
                yield from step(key, group)
                for _ in group:  # what the step left unread
                    pass

        held: list[tuple] = []
        for row in made():
            held.append(row)
            if len(held) >= BATCH:
                yield _batch(held, out)
                held = []
        yield _batch(held, out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], apart: Callable[[Column], Column], reach: str) -> DataFrame:
    """Adds ``island``: rows of a key in order, a new one wherever ``apart(furthest)`` holds of the greatest ``reach`` before."""
    w = W.partitionBy(*keys).orderBy(*order)
    furthest = F.max(reach).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("furthest", furthest).withColumn("new", F.when(F.col("furthest").isNull() | apart(F.col("furthest")), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("furthest", "new")
