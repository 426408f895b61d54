"""Names, catalogues and pattern lists joined to files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names
from .sized import small


def titled(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files (show, season, episode, …) with the title of the catalogue (series, season, episode, title), or a note."""
    known = catalog.withColumnRenamed("series", "show")
    return files.join(known, ["show", "season", "episode"], "left").withColumn("note", F.when(F.col("title").isNull(), "no title").otherwise(""))


#: Patterns that one automaton holds; more are dealt into blocks, each of which meets the names in parts.
PATTERNS, NAMES = 50_000, 200_000


class _Matcher:
    """A trie with failure links over all pieces (pattern, piece, free), and which patterns a piece stands for."""

    def __init__(self, pieces: Iterable[tuple[str, str, bool]]):
        import ahocorasick

        self.patterns: list[str] = []
        number: dict[str, int] = {}
        self.pieces, self.free, self.anchored = [], [], []
        self.trie = ahocorasick.Automaton()
        for piece, pattern, free in pieces:
            k = number.setdefault(piece, len(number))
            if k == len(self.pieces):
                self.pieces.append(piece)
                self.free.append([])
                self.anchored.append([])
                self.trie.add_word(piece, k)
            (self.free if free else self.anchored)[k].append(len(self.patterns))
            self.patterns.append(pattern)
        self.trie.make_automaton()
        self.names = pa.array(self.patterns, pa.string())

    def found(self, name: str) -> list[int]:
        """Numbers of the patterns that a name holds, or begins with where they are anchored."""
        out: list[int] = []
        if self.pieces:
            for k in {k for _, k in self.trie.iter(name)}:
                out += self.free[k]
                if self.anchored[k] and name.startswith(self.pieces[k]):
                    out += self.anchored[k]
        return out

    def batch(self, ids: Iterable[int], names: Iterable[str | None]) -> pa.RecordBatch:
        who, which = [], []
        for i, name in zip(ids, names, strict=True):
            own = self.found(name or "")
            which += own
            who += [i] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), self.names.take(pa.array(which, pa.int64()))], ["id", "pattern"])


def held_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """id, pattern: the patterns (pattern, piece, free) that each name (id, name) holds, or begins with where they aren't free.

    All patterns are one automaton, which passes over a name once, whatever their number.  Up to ``PATTERNS`` of them go to
    the names where those are; more are dealt into blocks of so many, and each task builds one block's automaton for a part
    of the names that come after it.
    """
    schema = "id long, pattern string"
    few = patterns.select("piece", "pattern", "free").limit(PATTERNS + 1).collect()
    if len(few) <= PATTERNS:
        pieces = [tuple(r) for r in few]

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _Matcher(pieces)
            for b in batches:
                yield matcher.batch(b.column("id").to_pylist(), b.column("name").to_pylist())

        return names.select("id", "name").mapInArrow(match, schema)
    blocks, parts = -(-patterns.count() // PATTERNS), max(1, -(-names.count() // NAMES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = patterns.select(dealt("pattern", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("piece").alias("name"), "pattern", "free")
    asked = names.select(every(blocks).alias("block"), dealt("id", parts).alias("part"), F.lit(1).alias("kind"), "id", "name", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("boolean").alias("free"))
    rows = held.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, matcher, held = None, [], None, ([], [])
        for b in batches:
            for block, part, kind, id_, name, pattern, free in zip(*(b.column(c).to_pylist() for c in ("block", "part", "kind", "id", "name", "pattern", "free")), strict=True):
                if (block, part) != at:
                    if held[0]:
                        yield matcher.batch(*held)
                    at, pieces, matcher, held = (block, part), [], None, ([], [])
                if kind == 0:
                    pieces.append((name, pattern, free))
                    continue
                matcher = matcher or _Matcher(pieces)
                held[0].append(id_)
                held[1].append(name)
            if held[0]:
                yield matcher.batch(*held)
                held = ([], [])

    return rows.mapInArrow(meet, schema)


def ignored(files: DataFrame, patterns: DataFrame, anywhere: bool = False) -> DataFrame:
    """id, pattern: the last part of a path (id, name) that begins with a pattern, or holds it.

    A pattern holds anywhere where it begins with ``*`` (behind which blanks don't count, and nothing matches nothing), or if
    ``anywhere`` is set.  Case and blanks round a pattern don't count; empty ones and notes (``#``) are left out.
    """
    text = F.trim("pattern")
    listed = patterns.where((text != "") & ~text.startswith("#")).select("pattern", text.startswith("*").alias("star"), F.lower(F.trim(F.regexp_replace(text, r"^\*", ""))).alias("piece"))
    listed = listed.where("piece <> ''").select("pattern", "piece", (F.col("star") | F.lit(anywhere)).alias("free")).distinct()
    return held_patterns(files.select("id", F.lower(F.substring_index(F.col("name"), "/", -1)).alias("name")), listed)


def longest_name_held(files: DataFrame, settings: DataFrame, default: str) -> DataFrame:
    """id, setting: the longest setting whose name the file's name holds (the first listed of equals), else the default."""
    listed = settings.where("setting <> ''").groupBy("setting").agg(F.min("order").alias("order"))
    pieces = listed.select(F.col("setting").alias("pattern"), F.lower("setting").alias("piece"), F.lit(True).alias("free"))
    found = held_patterns(files.select("id", F.lower("name").alias("name")), pieces).withColumnRenamed("pattern", "setting")
    best = found.join(small(listed), "setting").groupBy("id").agg(F.min(F.struct((-F.length("setting")).alias("l"), "order", "setting"))["setting"].alias("setting"))
    return files.select("id").join(best, "id", "left").select("id", F.coalesce("setting", F.lit(default)).alias("setting"))


def shows(files: DataFrame) -> DataFrame:
    """key, n, first_name of files grouped by the letters and digits of their show."""
    return files.groupBy(names.show_key(F.col("show")).alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("id", "show"))["show"].alias("first_name"))


def numbered_paths(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """id, path: names that are taken, by files that exist (path) or by one before (by id), get `` (2)``, `` (3)``… instead.

    The nth file of a name gets the nth number that no existing file has; what is counted is a name's files, never all.
    """
    key = ["folder", "base", "ext"]
    n = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    ranked = files.withColumn("n", n)
    plain = F.concat("folder", F.lit("/"), "base")
    tail = F.concat(F.lit("."), "ext")
    made = lambda k: F.concat(plain, F.when(k == 1, "").otherwise(F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))), tail)
    if existing is None:
        return ranked.select("id", made(F.col("n")).alias("path"))
    # existing files by what their name would be without a number
    taken = existing.select(F.regexp_replace("path", r" \(\d+\)(\.[^./]*)$", "$1").alias("stem"), F.regexp_extract("path", r" \((\d+)\)\.[^./]*$", 1).try_cast("int").alias("k"), "path")
    taken = taken.unionByName(existing.select(F.col("path").alias("stem"), F.lit(1).alias("k"), "path")).where("k IS NOT NULL")
    wanted = ranked.groupBy(*key).agg(F.max("n").alias("most")).withColumn("stem", F.concat(plain, tail))
    held = wanted.join(taken.where((F.col("k") == 1) | (F.col("stem") != F.col("path"))).groupBy("stem").agg(F.collect_set("k").alias("held")), "stem", "left")
    steps = F.sequence(F.lit(1), F.col("most") + F.coalesce(F.size("held"), F.lit(0)))
    free = F.filter(steps, lambda k: F.col("held").isNull() | ~F.array_contains("held", k))
    return ranked.join(held.select(*key, free.alias("free")), key).select("id", made(F.get("free", F.col("n") - 1)).alias("path"))


def discovered(listing: DataFrame, pattern: str) -> DataFrame:
    """path, root of files (order, root, path) whose name fits a pattern with ``*`` and ``?`` in any case; a path counts where it is met first."""
    import re as _re

    glob = "".join(".*" if c == "*" else "." if c == "?" else _re.escape(c) for c in pattern)
    fits = listing.where(F.substring_index("path", "/", -1).rlike(f"(?is)^{glob}$"))
    return fits.groupBy("path").agg(F.min(F.struct("order", "root"))["root"].alias("root"))
