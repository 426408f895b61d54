"""Line dedup by a log-template tree: lines that instances of a recurring template make are dropped.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, as far as it has them.  In
the leaf its places are told apart by how often their tokens come there: the seldom ones become variable one after another,
which gives the line's chain of ever more general templates, the line itself first.  A template counts the documents of all
lines that have it in their chain.  Nothing of this depends on the order of the lines, or on how many a leaf has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_IDS, discard, written

#: Documents (of different texts) that a template is seen in before its lines are dropped.
RECURRENT = 10
#: Templates of more tokens than this are passages, for which fewer documents are enough.
LONG_TOKENS = 50
LONG_RECURRENT = 3
#: Leading tokens that the tree branches by.
LEADING = 3
#: Share of places in which a line agrees with its template; those with a digit are variable from the start and agree.
AGREE = 0.7
VARIABLE = "<*>"
#: Parts that the lines of one leaf are dealt over where its token weights aren't broadcast.
SALTS = 64
#: A key with this share of a table's rows, one in so many, is joined by broadcast; there are no more such keys than this.
HOT = 100_000

_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")


def _tokens(line: str) -> list[str]:
    """The line's words, those with a digit as variable fields."""
    parts = line.split()
    return [VARIABLE if _DIGIT.search(t) else t for t in parts] if _DIGIT.search(line) else parts


def _hash(text: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def _print(text: str) -> bytes:
    """128 bits that stand for a text."""
    import xxhash

    return xxhash.xxh3_128_digest(text)


def _paths(tokens: list[str], leading: int) -> int:
    return _hash(f"{len(tokens)}\x1f" + "\x1f".join(tokens[:leading]))


def _needed(tokens: list[str], recurrent: int, long: int) -> int:
    return long if len(tokens) > LONG_TOKENS else recurrent


def _lines(leading: int, recurrent: int, long: int):
    """doc_id, the text's own identity, place, leaf, identity, and the documents that it takes, of each line with a letter."""
    names = ["doc_id", "print", "place", "leaf", "line", "needed"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                print_ = _print(text or "")
                for i, raw in enumerate((text or "").split("\n")):
                    if _LETTER.search(raw):
                        tokens = _tokens(raw)
                        out.append((doc_id, print_, i, _paths(tokens, leading), _print(" ".join(tokens)), _needed(tokens, recurrent, long)))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _leaf_lines(leading: int, recurrent: int, long: int):
    """Leaf, identity, tokens and needed documents of each line; a task gives a line once as long as it remembers it."""
    names = ["leaf", "line", "body", "needed"]
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for text in b.column("text").to_pylist():
                for raw in (text or "").split("\n"):
                    if _LETTER.search(raw) and (h := _print(joined := " ".join(tokens := _tokens(raw)))) not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(h)
                        out.append((_paths(tokens, leading), h, joined, _needed(tokens, recurrent, long)))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``table``, by broadcast if that is small.

    Else the keys that hold one row in ``HOT`` or more are joined by broadcast, of which there are ``HOT`` at most, and only
    the others are shuffled: a very common line or leaf meets no single task.
    """
    if table.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(table), key, how)
    counted = rows.groupBy(key).count()
    hot = written(counted.where(F.col("count") * HOT >= rows.count()).select(key), "hot")
    often, seldom = (lambda df: df.join(F.broadcast(hot), key, "left_semi")), (lambda df: df.join(F.broadcast(hot), key, "left_anti"))
    return often(rows).join(F.broadcast(often(table)), key, how).unionByName(seldom(rows).join(seldom(table).hint("shuffle_merge"), key, how))


def _chains(agree: float):
    """line, n, needed, level, template, pattern: each line's templates, from the most special to the most general that agrees.

    ``places`` holds the weight of each token that is frequent in its place of the leaf; the leading ones always are.
    Tokens of equal weight become variable together.
    """

    def chain(tokens: list[str], weight: dict[int, int], leading: int) -> Iterator[list[str]]:
        digits = sum(t == VARIABLE for t in tokens)
        free = [i for i, t in enumerate(tokens) if i >= leading and t != VARIABLE]
        out = list(tokens)
        variable = 0
        levels = sorted({weight.get(i, 0) for i in free})
        for bound in [0, *(x for x in levels if x)]:
            # the places at this weight become variable; seldom tokens (without a weight) come first
            for i in free:
                if weight.get(i, 0) == bound:
                    out[i] = VARIABLE
                    variable += 1
            solid = len(tokens) - digits - variable
            if len(tokens) - variable < agree * len(tokens) or solid * 2 < agree * len(tokens):
                return
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for line, n, needed, body, leading, places in zip(*(b.column(c).to_pylist() for c in ("line", "n", "needed", "body", "leading", "places")), strict=True):
                weight = {p["pos"]: p["weight"] for p in places or ()}
                for level, pattern in enumerate(chain(body.split(" "), weight, leading)):
                    text = " ".join(pattern)
                    rows.append((line, n, needed, level, _print(text), text))
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["line", "n", "needed", "level", "template", "pattern"])

    return run


def _frequent(places: DataFrame) -> DataFrame:
    """line, places (pos, weight) of the tokens of ``places`` (line, pos, key, n, needed) that weigh enough in their leaf.

    The weights go to the lines by broadcast if they are few.  Else the lines of a token are dealt over parts, and its weight
    goes to those that have any, noted as bits by the aggregation: a token of very many lines meets no single task.
    """
    part = F.pmod(F.xxhash64("line", F.lit(4)), F.lit(SALTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), part)
    weights = places.groupBy("key").agg(F.sum("n").alias("weight"), F.bit_or(bit).alias("bits"), F.max("needed").alias("needed")).where("weight >= needed").drop("needed")
    weights = written(weights, "weights")
    if weights.count() <= BROADCAST_IDS:
        met = places.join(F.broadcast(weights.select("key", "weight")), "key")
    else:
        parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
        sent = weights.select("key", "weight", F.explode(parts).alias("part"))
        met = places.withColumn("part", part).join(sent.hint("merge"), ["key", "part"])
    return met.groupBy("line").agg(F.collect_list(F.struct("pos", "weight")).alias("places"))


def templates(docs: DataFrame, recurrent: int = RECURRENT, leading: int = LEADING, agree: float = AGREE, long_recurrent: int | None = LONG_RECURRENT) -> tuple[DataFrame, DataFrame]:
    """(all lines: doc_id, print, place, leaf, line, needed; recurring ones: line, template, pattern, documents)."""
    long = recurrent if long_recurrent is None else min(recurrent, long_recurrent)
    lines = written(docs.select("doc_id", "text").mapInArrow(_lines(leading, recurrent, long), "doc_id long, print binary, place int, leaf long, line binary, needed int"), "lines")
    # a template is in no more documents than its leaf, whose lines all have one number of tokens
    often = lines.select("leaf", "needed", "print").distinct().groupBy("leaf", "needed").agg(F.count("*").alias("n")).where("n >= needed").select("leaf")
    often = written(often, "often")
    seen = written(_spread_join(lines.select("leaf", "line", "print"), often, "leaf").select("line", "print").distinct(), "seen")
    documents = seen.groupBy("line").agg(F.count("*").alias("n"))
    bodies = docs.select("text").mapInArrow(_leaf_lines(leading, recurrent, long), "leaf long, line binary, body string, needed int")
    if often.count() <= BROADCAST_IDS:
        bodies = bodies.join(F.broadcast(often), "leaf")
    # lines are combined before they meet the leaves: a leaf has each of its lines once
    bodies = bodies.groupBy("line").agg(F.min("leaf").alias("leaf"), F.min("body").alias("body"), F.min("needed").alias("needed")).join(documents.hint("shuffle_merge"), "line")
    bodies = written(bodies, "bodies")
    tokens = bodies.select("leaf", "line", "n", "needed", F.posexplode(F.split("body", " ")).alias("pos", "token")).where((F.col("pos") >= leading) & (F.col("token") != VARIABLE))
    places = tokens.select("line", "pos", F.xxhash64("leaf", "pos", "token").alias("key"), "n", "needed")
    held = bodies.join(_frequent(places).hint("shuffle_merge"), "line", "left").select("line", "n", "needed", "body", F.lit(leading).alias("leading"), "places")
    chains = written(held.mapInArrow(_chains(agree), "line binary, n long, needed int, level int, template binary, pattern string"), "chains")
    # the summed documents of its lines bound a template's documents, which are then counted once each
    hopeful = chains.groupBy("template", "needed").agg(F.sum("n").alias("n")).where("n >= needed").select("template")
    of_line = written(_spread_join(chains.drop("n"), written(hopeful, "hopeful"), "template"), "of_line")
    counted = _spread_join(seen, of_line.select("line", "template", "needed"), "line").select("template", "needed", "print").distinct()
    counted = written(counted.groupBy("template", "needed").agg(F.count("*").alias("documents")).where("documents >= needed").select("template", "documents"), "counted")
    best = _spread_join(of_line, counted, "template").groupBy("line").agg(F.min(F.struct("level", "template", "pattern", "documents")).alias("x"))
    recurring = written(best.select("line", "x.template", "x.pattern", "x.documents"), "recurring")
    discard(often, seen, bodies, chains, of_line, counted)
    return lines, recurring


def line_dedup(docs: DataFrame, recurrent: int = RECURRENT, leading: int = LEADING, agree: float = AGREE, long_recurrent: int | None = LONG_RECURRENT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``kept_text`` is the text without the lines that have a template seen in ``recurrent`` documents or more, or in
    ``long_recurrent`` where it has more than ``LONG_TOKENS`` tokens (None: no other number for these); documents with equal
    texts count once.  Lines end at ``\\n``; those without a letter always stay, as do those whose words all have digits.
    Null text counts as empty and has one empty line.  Very long texts and lines are taken whole.  Rows that repeat a doc_id
    are judged each by its own text.  An empty table gives an empty result.
    """
    lines, recurring = templates(docs, recurrent, leading, agree, long_recurrent)
    hit = _spread_join(lines.select("doc_id", "print", "place", "line"), recurring.select("line"), "line", "left_semi")
    places = hit.groupBy("doc_id", "print").agg(F.collect_set("place").alias("places"))
    places = written(places.select(F.col("doc_id").alias("d"), "print", "places"), "places")
    text = F.coalesce(F.col("text"), F.lit(""))

    @F.arrow_udf("binary")
    def print_of(column: pa.Array) -> pa.Array:
        return pa.array([_print(t or "") for t in column.to_pylist()], pa.binary())

    @F.arrow_udf("string")
    def without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts.to_pylist(), dropped.to_pylist(), strict=True):
            gone = set(gone or ())
            out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        return pa.array(out, pa.string())

    own = docs.select("doc_id", text.alias("text")).withColumn("own", print_of("text"))
    out = own.join(places, own["doc_id"].eqNullSafe(F.col("d")) & (F.col("own") == F.col("print")), "left")
    cut = without(F.when(F.col("places").isNotNull(), F.col("text")), F.col("places"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(cut, F.col("text")).alias("kept_text"))
