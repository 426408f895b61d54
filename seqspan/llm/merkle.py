"""Merkle manifest of a dataset: a tree of digests for each language, one over the languages, and a proof for each row.

A tree is kept in aligned blocks of ``BLOCK`` nodes.  A block holds each of its levels as one string of hex digests of fixed
width, so parents are digests of fixed-width substrings, and a node's siblings are the substrings left and right of it in its
run.  What a block leaves is one digest; the blocks' digests are the nodes of the next, much smaller tree, and so on.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import discard, small_enough, written

#: Nodes that have one parent, and levels that a block climbs; a block has ``ARITY ** LEVELS`` nodes.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: Characters of a digest, and of a run of siblings.
WIDE = 64
RUN = ARITY * WIDE
#: The columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its number of UTF-8 bytes before it, or ``-`` for null: no two rows give one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row; ``changed`` gives other values for some of its fields."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp and others; a written table) with at, the place within grp by ``order``, and total, the rows of grp.

    Rows are dealt by ranges of (grp, order) and sorted there; what is left is an offset for each range and grp, so a grp
    that holds most rows is spread like any other.
    """
    sortable = rows.withColumn("mark", F.monotonically_increasing_id())  # equal rows are dealt over several ranges too
    keys = ["grp", *order, "mark"]
    ranged = written(sortable, "unplaced")
    placed = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark").withColumn("row_no", F.monotonically_increasing_id())
    placed = written(placed.withColumn("range", F.shiftright("row_no", 33)), "placed")
    discard(ranged)
    own = W.partitionBy("grp")
    before = own.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("grp", "range").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    starts = starts.select("grp", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(own).alias("total"))
    starts = written(starts, "offsets")
    out = placed.join(small_enough(starts), ["grp", "range"])
    return out.withColumn("at", F.col("row_no") - F.col("first") + F.col("offset")).drop("row_no", "first", "offset", "range")


def _parents(level: str) -> Column:
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / RUN).cast("int"))
    one = lambda i: F.sha2(F.substring(F.col(level), i * RUN + 1, RUN), 256)
    return F.array_join(F.transform(runs, one), "").cast("binary")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """grp, block, total, climbs, nodes (at, hash and what is carried, in order), level0.. and top, for each aligned block.

    ``nodes`` has grp, at, total and hash.  A block of a grp with others climbs all levels; one alone climbs until one node
    is left.  Levels are hex text kept as bytes, as substrings of bytes need no walk to their place.
    """
    member = F.struct("at", "hash", *carried)
    out = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("nodes"), F.first("total").alias("total"))
    # total is BLOCK or less: the least number of climbs that leaves one node
    climbs = sum((F.col("total") > ARITY**k).cast("int") for k in range(LEVELS))
    out = out.withColumn("climbs", climbs).withColumn("level0", F.array_join(F.transform("nodes", lambda x: x["hash"]), "").cast("binary"))
    for k in range(1, LEVELS + 1):
        out = out.withColumn(f"level{k}", F.when(F.col("climbs") >= k, _parents(f"level{k - 1}")).otherwise(F.col(f"level{k - 1}")))
    return out.withColumn("top", F.col(f"level{LEVELS}").cast("string"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tables of the blocks' digests above them, down to one row a grp."""
    tables = [nodes]
    while True:
        tops = _blocks(tables[-1]).select("grp", F.col("block").alias("at"), F.col("top").alias("hash"), F.ceil(F.col("total") / BLOCK).alias("total"))
        tables.append(written(tops, "tops"))
        if not tables[-1].agg(F.max("total") > 1).first()[0]:
            return tables


def _segments(at: Column) -> Column:
    """Left and right siblings of a block's node ``at``, level by level."""
    own, out = at % BLOCK, []
    for k in range(LEVELS):
        run, place = F.floor(own / ARITY ** (k + 1)), F.floor(own / ARITY**k) % ARITY
        left = F.substring(F.col(f"level{k}"), (run * RUN + 1).cast("int"), (place * WIDE).cast("int"))
        right = F.substring(F.col(f"level{k}"), (run * RUN + (place + 1) * WIDE + 1).cast("int"), ((ARITY - 1 - place) * WIDE).cast("int"))
        out.append(F.when(F.col("climbs") > k, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*out))


def _descend(nodes: DataFrame, above: DataFrame, made, *carried: str) -> DataFrame:
    """``made(node, segments)``, a struct, for each of ``nodes``: its siblings on the way up, its block's and those above.

    ``above`` has grp, block, and upper, the segments of each block's own digest; its other columns stay.
    """
    blocks = _blocks(nodes, *carried).join(above, ["grp", "block"])
    each = F.transform("nodes", lambda x: made(x, F.concat(_segments(x["at"]), F.col("upper"))))
    return blocks.select(*[c for c in above.columns if c not in ("block", "upper")], F.explode(each).alias("node"))


def _paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """What :func:`_descend` takes as ``above`` for the lowest of ``tables``, from that for the highest."""
    for nodes in reversed(tables[1:-1]):
        step = _descend(nodes, above, lambda x, s: F.struct(x["at"].alias("block"), s.alias("upper")))
        above = step.select("*", "node.*").drop("node")
    return above


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text (others are ignored).  ``seen`` is the text that is checked against
    the manifest, by default the text itself: folded_root is computed from the leaf with that text and the siblings of the
    row, verified says whether it is the root.  Nulls are ``-`` in a leaf, so they differ from empty texts; a null lang is a
    language of its own that comes first, rows with a null doc_id come first in theirs, and rows that tie in lang and doc_id
    are ordered by their leaves (equal rows take neighbouring places).  Very long texts are hashed whole, and their rows are
    shuffled without them.  An empty table gives an empty result.
    """
    own = leaf()
    now = own if seen is None else leaf(text=seen)
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), "doc_id", own.alias("hash"), F.nullif(now, own).alias("other"))
    leaves = written(_numbered(rows, ["doc_id", "hash"]), "leaves")
    tree = _climb(leaves)
    languages = tree[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    over = _climb(_numbered(languages, ["name"]))
    last = over[-1].select("grp", F.col("at").alias("block"), F.array().cast("array<struct<left: binary, right: binary>>").alias("upper"), F.col("hash").alias("root"))
    path = lambda x, s: F.struct(x["name"].alias("grp"), s.alias("upper"), x["hash"].alias("subroot"))
    roots = _descend(over[0], _paths(over, last), path, "name").select("root", "node.*")
    highest = tree[-1].select("grp", F.col("at").alias("block")).join(roots, "grp")
    above = written(_paths(tree, highest), "paths")

    def proven(x: Column, segments: Column) -> Column:
        siblings = F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"]).cast("string")), "")
        now = F.coalesce(x["other"], x["hash"])
        folded = F.aggregate(segments, now, lambda h, s: F.sha2(F.concat(s["left"], h.cast("binary"), s["right"]), 256))
        return F.struct(x["doc_id"].alias("doc_id"), x["hash"].alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))

    out = _descend(leaves, above, proven, "doc_id", "other")
    return out.select("node.doc_id", "node.leaf", "subroot", "root", "node.proof_sha256", "node.folded_root", (F.col("node.folded_root") == F.col("root")).alias("verified"))
