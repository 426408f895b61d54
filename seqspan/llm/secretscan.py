"""Secret scan over a trigram inverted index: Boolean trigram queries of the rules, intersected postings, verified candidates.

Each rule's expression gives a query, trigrams that every text with a match must hold.  The index keeps, for each trigram of
the rules and each bucket of rows, the rows whose text has it.  A conjunction's postings are intersected bucket by bucket; the
rows left are the rule's candidates, and its expression runs over their whole texts alone.  Rules whose expression has no
mandatory trigram run over all texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .store import row_prints, small_enough, written

#: Rows of a bucket of the index, about; a posting has at most so many.
BUCKET_ROWS = 4_096
#: Matches whose places are added up in one array.
PIECE = 256


class Rule(NamedTuple):
    """A kind of secret: what matches ``pattern``, if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules that are always counted, in order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Formats of keys that public services give out.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"(gh[opsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22})[A-Za-z0-9_]*"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&+=-]{3,}@"),
)


def _lasting(rule: Rule) -> str:
    """The expression with which a rule scans.  One of a single class needs no matches that are too short to stay."""
    if rule.least > 1 and rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 and rule.pattern.startswith("["):
        return rule.pattern[:-1] + f"{{{rule.least},}}"
    return rule.pattern


def spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, kind, finish) of the rule's leftmost matches that don't overlap, in code points.

    Places are sums over the stretches between the matches and the matches themselves, added up in pieces, so that many
    matches cost as little each as few.
    """
    pattern = _lasting(rule)
    size = lambda x: F.length(x).cast("long")
    gaps = F.transform(F.split(text, pattern, -1), size)  # one more than there are matches
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), size)
    checked = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), size) if rule.group else own
    found = F.zip_with(gaps, own, lambda gap, x: F.struct(gap.alias("gap"), x.alias("own")))
    found = F.zip_with(found, checked, lambda x, y: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), y.alias("checked")))
    place = "struct<start: bigint, finish: bigint, checked: bigint>"

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["own"]
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("finish"), x["checked"].alias("checked")))).alias("out"))

    def piece(done: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(done["at"].alias("at"), F.array().cast(f"array<{place}>").alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(done["out"], F.array(inner["out"])).alias("out"))

    def placed(found: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{place}>>").alias("out"))
        pieces = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(PIECE)), lambda at: F.slice(found, at, PIECE))
        return F.flatten(F.aggregate(pieces, first, piece)["out"])

    # bound once as the only element of an array, so that the matches are looked for once
    all_ = F.flatten(F.transform(F.array(F.filter(found, lambda x: x["own"].isNotNull())), placed))
    kept = F.filter(all_, lambda x: x["checked"] >= rule.least)
    named = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["finish"].alias("finish")))
    return F.when(text.rlike(pattern), named)


def _key() -> Column:
    """A hash of a row's id and text.  Rows that share it share candidates, which are verified by the text itself."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The inverted index of ``docs``: bucket, gram, and posting, the keys of the bucket's rows whose text has the gram.

    Texts count in lower case.  Rows are dealt into buckets by their keys, so that postings of common trigrams are bounded.
    """
    n = docs.count()
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    rows = low.select("key", F.explode(held).alias("gram"))
    bucket = F.pmod("key", F.lit(max(1, -(-n // BUCKET_ROWS))))
    return rows.groupBy(bucket.alias("bucket"), "gram").agg(F.collect_set("key").alias("posting"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key and rules, the numbers of those among ``rules`` whose query holds for the row; rules without a query are left out."""
    parts = [(k, c) for k, rule in enumerate(rules) if (q := trigrams.query(rule.pattern)) != trigrams.ALWAYS for c in sorted(q, key=sorted)]
    uses: dict[str, list[Column]] = {}
    for number, (k, grams) in enumerate(parts):
        for g in grams:
            uses.setdefault(g, []).append(F.struct(F.lit(number).alias("part"), F.lit(k).alias("rule"), F.lit(len(grams)).alias("grams")))
    asked = F.create_map(*[x for g, use in uses.items() for x in (F.lit(g), F.array(*use))])
    met = index.select("bucket", "posting", F.explode(F.element_at(asked, F.col("gram"))).alias("use"))
    whole = met.groupBy("bucket", "use").agg(F.collect_list("posting").alias("postings")).where(F.size("postings") == F.col("use")["grams"])
    common = F.aggregate(F.slice("postings", 2, F.size("postings")), F.get("postings", 0), F.array_intersect)
    return whole.select(F.explode(common).alias("key"), F.col("use")["rule"].alias("rule")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, index: DataFrame | None = None) -> DataFrame:
    """doc_id and found, an array of (start, order, kind, finish), for each row of ``docs`` (doc_id, text; others are ignored).

    ``index`` is a :func:`build_index` of the same rows that holds all trigrams of the rules; without one it is built.  Places
    are code points, the end exclusive; spans are ordered by start, then by the rules' order, and rules may overlap.  A null
    text counts as empty and has no spans; texts are scanned whole, however long.  Rows that repeat an id, or are repeated as
    a whole, are scanned each; a null id is as good as any.  An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = [trigrams.query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for c in q for g in c})
    rows = docs.withColumn("key", _key())
    if grams:
        told = written(candidates(build_index(docs, grams) if index is None else index, rules), "candidates")
        rows = rows.join(small_enough(told), "key", "left")
    none = F.array().cast("array<struct<start: bigint, order: int, kind: string, finish: bigint>>")
    parts = []
    for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        own = spans(F.col("text"), rule, k)
        parts.append(F.coalesce(own if q == trigrams.ALWAYS else F.when(F.array_contains("rules", k), own), none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["finish"].cast("string"))), ",")
