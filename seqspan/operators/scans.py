"""Running aggregates of keys that outgrow a task: two passes over ranges of rows, and the offsets between them.

Rows are dealt by ranges of (key, order), so that a key of any size is spread over tasks.  Each range is summed up by itself;
what the ranges in front of a row's own one hold is a small table, whose running totals are added.  Keys that a task holds
well are walked by one window instead; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import written
from .sized import small

#: Rows of a key that one window walks.
MOST = 2_000_000


class Running(NamedTuple):
    """What is carried along: a ``sum``, a ``count``, a ``max``, a ``min`` or the ``last`` that isn't null, of ``value``.

    It holds for the rows up to and with the present one; ``before`` leaves out the present one, ``backward`` comes from the
    other end.
    """

    value: Column
    kind: str
    backward: bool = False
    before: bool = False


_OVER = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_JOINED = {
    "sum": lambda carried, own: F.when(carried.isNull() | own.isNull(), F.coalesce(carried, own)).otherwise(carried + own),
    "count": lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
    "last": lambda carried, own: F.coalesce(own, carried),
}


def outgrown(rows: DataFrame, by: Sequence[str], most: int = MOST) -> bool:
    """Whether a key of ``rows`` has more than ``most`` rows."""
    return (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > most


def _sorted(order: Sequence[str], backward: bool) -> list[Column]:
    """Columns of an order whose names begin with ``-`` where they descend."""
    return [F.desc(c.lstrip("-")) if c.startswith("-") != backward else F.asc(c.lstrip("-")) for c in order]


def _window(by: Sequence[str], order: Sequence[str], step: Running) -> W:
    return W.partitionBy(*by).orderBy(*_sorted(order, step.backward)).rowsBetween(W.unboundedPreceding, -1 if step.before else W.currentRow)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], ranges: bool, **steps: Running) -> DataFrame:
    """``rows`` with a column for each of ``steps``, along the rows of each key ``by`` in ``order``.

    ``order`` should leave no ties but between rows that are interchangeable.  With ``ranges`` no task holds a key.
    """
    if not ranges:
        return rows.withColumns({name: _OVER[s.kind](s.value).over(_window(by, order, s)) for name, s in steps.items()})
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *[F.asc(c) for c in by], *_sorted(order, False)).withColumn("_range", F.spark_partition_id())
    own = ["_range", *by]
    # a value's place in its range tells the last one; the values themselves are kept for the totals
    place = F.row_number().over(W.partitionBy(*own).orderBy(*_sorted(order, False)))
    local = {f"_own_{n}": _OVER[s.kind](s.value).over(_window(own, order, s)) for n, s in steps.items()} | {f"_value_{n}": s.value for n, s in steps.items()}
    held = written(dealt.withColumns({"_place": place} | local), "ranges")
    total = lambda n, s: (F.max_by if not s.backward else F.min_by)(F.col(f"_value_{n}"), F.when(F.col(f"_value_{n}").isNotNull(), F.col("_place"))) if s.kind == "last" else _OVER[s.kind](F.col(f"_value_{n}"))
    totals = held.groupBy(*own).agg(*[total(n, s).alias(f"_value_{n}") for n, s in steps.items()])
    # a key has as many rows here as there are ranges at most
    carried = {f"_carried_{n}": _OVER[s.kind](F.col(f"_value_{n}")).over(_window(by, ["_range"], s._replace(before=True))) if s.kind != "count" else F.sum(f"_value_{n}").over(_window(by, ["_range"], s._replace(before=True))) for n, s in steps.items()}
    totals = small(written(totals.withColumns(carried).select(*[F.col(c).alias(f"_of{c}") for c in own], *carried), "carried"))
    match = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in own]
    on = match[0]
    for m in match[1:]:
        on = on & m
    met = held.join(totals, on)
    return met.select(*rows.columns, *[_JOINED[s.kind](F.col(f"_carried_{n}"), F.col(f"_own_{n}")).alias(n) for n, s in steps.items()])


def medians(rows: DataFrame, by: Sequence[str], value: str, ranges: bool | None = None) -> DataFrame:
    """by, n, low, high: the number of a key's values that aren't null, and those of rank (n - 1) div 2 and n div 2, from 0.

    Values are counted before they are ranked, and the counts' running totals tell where a rank falls: no key's values meet
    in one place.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    if ranges is None:
        counted = written(counted, "counted")
        ranges = outgrown(counted, by)
    upto = running(counted, by, ["_v"], ranges, _upto=Running(F.col("_n"), "sum"))
    whole = counted.groupBy(*[F.col(c).alias(f"_of{c}") for c in by]).agg(F.sum("_n").alias("n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    met = upto.join(small(whole), on)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    return met.groupBy(*by, "n").agg(at(F.expr("(n - 1) div 2")).alias("low"), at(F.expr("n div 2")).alias("high"))
