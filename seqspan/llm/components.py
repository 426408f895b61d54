"""Connected components of a link table, without gathering any group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, written

#: Parts that the edges of one id are dealt over; at most 64, a bit each.
SALTS = 64


def _part(edge_end: str) -> Column:
    return F.pmod(F.xxhash64(edge_end, F.lit(12)), F.lit(SALTS)).cast("int")


def _joined_minimum(edges: DataFrame, own: bool) -> DataFrame:
    """Edges (u, v) with m, the smallest neighbour of u (with ``own``, or u itself if that is smaller).

    The edges of an id are dealt over parts by a hash of v, and its minimum goes to those parts alone that have edges: the
    aggregation, which combines before it shuffles, notes them as bits.  So the centre of a large star meets no single task.
    """
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _part("v")))
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), bits.alias("bits"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    sent = lowest.select("u", (F.least("u", "m") if own else F.col("m")).alias("m"), F.explode(parts).alias("part"))
    return edges.withColumn("part", _part("v")).join(sent.hint("merge"), ["u", "part"]).select("u", "v", "m")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest id that each linked id can reach: (id, component).

    ``links`` has two id columns a and b, each pair in either direction, any number of times; pairs of equal ids and pairs
    with a null are left out.  Ids without links are not in the result; without links it is empty.  Alternates "large star"
    and "small star" rounds: in each, every id hands its larger (smaller) neighbours over to its smallest one, until all
    edges point at the smallest id of their component.  Each round is an aggregation with map-side combining and a salted
    join; the state is a written table.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u <> v")
    edges = written(pairs.distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_minimum(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges")
        small = _joined_minimum(large, False)
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        after = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low).distinct(), "edges")
        # done when no smaller end is itself a larger end, that is when all edges point at a root
        done = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        discard(large, edges)
        edges = after
        if done:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")
