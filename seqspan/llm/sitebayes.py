"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import row_prints, small_enough, without_rows, written
from .textbits import chunks, strings, word_hashes, words

#: Labelled rows that the document classifier learns from, on average (a hash of the id picks them).
SAMPLE = 20_000
#: Documents whose posterior of being good is below this are rejected.
LEAST = 0.5
#: Bounds of the prior's weight, in documents, where the moments give none.
PRIOR_WEIGHT = (2.0, 1000.0)
#: Bytes of host and path names that are sent to every executor; with more, the join shuffles.
BROADCAST_BYTES = 64 << 20

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 white space, 0 other (beyond ASCII)
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 5 if _c in (9, 10, 11, 12, 13, 32) else 4
_PLAIN = np.zeros(256, bool)  # the punctuation of running text
_PLAIN[[ord(c) for c in ".,;:'\"?-()"]] = True
FEATURES = ("symbols", "upper", "digits", "word_length", "bare_words", "marked_words", "repeats", "near_repeats", "variety", "breaks", "length")


def text_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text, in the order of ``FEATURES``; all zero for a text without words."""
    raw, at = strings(column)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for i, j, part, ends in chunks(raw, at):
        start, end, first = words(part, ends)
        n = np.diff(first)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        kind = _KIND[part]
        symbol = (kind == 4) & ~_PLAIN[part]

        def over_bytes(flags: np.ndarray, ends=ends) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return np.diff(total[ends])

        def over_words(flags: np.ndarray, first=first) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return np.diff(total[first])

        letters = np.concatenate([[0], np.cumsum(kind <= 2)])
        odd = np.concatenate([[0], np.cumsum(symbol)])
        bare = letters[end] == letters[start]
        marked = odd[end] > odd[start]
        hashed = word_hashes(part, start, end)
        row = np.repeat(np.arange(j - i), n)
        same = np.zeros(len(hashed), bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
        close = same.copy()
        close[2:] |= (hashed[2:] == hashed[:-2]) & (row[2:] == row[:-2])
        size = np.maximum(np.diff(ends), 1)
        bucket = np.unique(row.astype(np.int64) << 40 | (hashed >> np.uint64(24)).astype(np.int64)) >> 40
        variety = np.bincount(bucket, minlength=j - i)
        total = np.maximum(n, 1)
        values = (
            over_bytes(symbol) / size,
            over_bytes(kind == 2) / np.maximum(over_bytes(kind <= 2), 1),
            over_bytes(kind == 3) / size,
            over_bytes(kind != 5) / total / 10,
            over_words(bare) / total,
            over_words(marked) / total,
            over_words(same) / total,
            over_words(close) / total,
            np.log1p(variety) / np.log1p(total),
            np.log1p(over_bytes(part == 10)) / np.log1p(total),
            np.log1p(total) / 10,
        )
        out[i + full] = np.stack(values, axis=1)[full]
    return out


@dataclass(frozen=True)
class Classifier:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the bias last

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = np.clip(np.concatenate([z, z * z], axis=1), -50, 50)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> Classifier:
    """Newton's method; with one class or no rows, the share of good ones (0.5 without rows) for all texts."""
    width = 2 * x.shape[1] + 1
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(width)
    if len(np.unique(y)) < 2:
        w[-1] = 0.0 if not len(y) else 5.0 if y[0] else -5.0
        return Classifier(mean, scale, w)
    z = (x - mean) / scale
    z = np.concatenate([np.clip(np.concatenate([z, z * z], axis=1), -50, 50), np.ones((len(x), 1))], axis=1)
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w)


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from about ``sample`` labelled documents, picked by a hash of the id.

    ``labels`` has doc_id and quality (1 good, 0 bad; nulls and other values are left out); of several labels of a document
    the worst counts, and of several texts of a document the least.
    """
    known = _known(labels)
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)

    def measure(batches):
        for b in batches:
            x = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("quality"), b.column("doc_id")], ["x", "quality", "doc_id"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "text", "quality").mapInArrow(measure, "x binary, quality int, doc_id long").orderBy("doc_id", "x").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], float))


def _own_evidence(model: Classifier) -> Column:
    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        return pa.array(model.probability(text_features(text)))

    return probability("text")


def _logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def _weight(groups: DataFrame, mean: float) -> float:
    """The prior's weight in documents by the method of moments: how much less groups differ than they might.

    ``groups`` has n and s (documents and their summed evidence).
    """
    row = groups.where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    low, high = PRIOR_WEIGHT
    if not row["k"] or row["k"] < 2:
        return high
    within = mean * (1 - mean)
    spread = (row["between"] - (row["k"] - 1) * within) / (row["n"] - row["nn"] / row["n"] + 1e-9)
    return float(min(high, max(low, within / spread - 1 if spread > 0 else high)))


@dataclass(frozen=True)
class Priors:
    """The global mean, and how many documents it weighs against a host's, and a host's mean against a path's."""

    mean: float
    of_hosts: float
    of_paths: float


def site_sums(evidence: DataFrame) -> tuple[DataFrame, Priors]:
    """(host, path, host_n, host_s, path_n, path_s; the priors) from ``evidence`` (host, path, told).

    ``told`` is what is known of a document: its label or else its classifier's probability.  Sums of sums: a hot host is
    combined before it is shuffled.
    """
    told = F.sum(F.round("told", 9).cast("decimal(20,9)")).cast("double")
    paths = written(evidence.groupBy("host", "path").agg(F.count("*").alias("path_n"), told.alias("path_s")), "paths")
    total = paths.agg(F.sum("path_n").alias("n"), F.sum("path_s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"])) if total["n"] else 0.5
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    weights = [_weight(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), mean), _weight(paths.select(F.col("path_n").alias("n"), F.col("path_s").alias("s")), mean)]
    out = paths.join(hosts.hint("merge"), F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "host_n", "host_s", "path_n", "path_s")
    return out, Priors(mean, *weights)


def site_posteriors(priors: Priors) -> tuple[Column, Column]:
    """(host's posterior, path's posterior) for a document, from its site's sums without what the document itself told.

    A host's is the mean of its other documents, shrunk towards the global mean, and a path's that of its own others, shrunk
    towards its host's: the fewer they are, the more.  A document alone on its path has its host's, one alone on its host the
    global mean.
    """
    less = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col("told"))
    host = (less("host_s") + priors.of_hosts * priors.mean) / (F.col("host_n") - 1 + priors.of_hosts)
    return host, (less("path_s") + priors.of_paths * host) / (F.col("path_n") - 1 + priors.of_paths)


def _posterior(own: Column, path: Column, mean: float) -> Column:
    """The document's odds times the odds by which its path departs from the global mean."""
    return 1 / (1 + F.exp(-(_logit(own) + _logit(path) - _logit(F.lit(mean)))))


def _judged(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, least: float, sample: int) -> DataFrame:
    """doc_id, a, b (prints of the row), own, host_posterior, path_posterior, quality, kept."""
    model = train(docs, labels, sample)
    evidence = written(_evidence(docs, labels, model, host, path), "evidence")
    # rows that are repeated as a whole count once: else a row would learn its own label from its copy
    once = evidence.groupBy("host", "path", "a", "b").agg(F.first("told").alias("told"))
    sums, priors = site_sums(once)
    rows = _with_sites(evidence, sums)
    of_host, of_path = site_posteriors(priors)
    rows = rows.withColumns({"host_posterior": of_host, "path_posterior": of_path})
    quality = F.when(F.col("own") > 0, _posterior(F.col("own"), F.col("path_posterior"), priors.mean)).otherwise(0.0)
    return rows.withColumn("quality", quality).withColumn("kept", F.col("quality") >= least)


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """doc_id, own, host_posterior, path_posterior, quality, kept for each row of ``docs``.

    ``host`` and ``path`` are columns of ``docs`` (by default its source and its lang); null is a host, or a path, like any
    other.  ``own`` is the classifier's probability for the whole text that the document is good, the posteriors are its
    site's by the labels and probabilities of all its other documents, ``quality`` the posterior with both, and ``kept``
    whether that is ``least`` or more.  A text without words (null and empty ones too) has features of zero and is rejected:
    its ``own`` and ``quality`` are 0.  Without labels ``own`` is 0.5.  Repeated rows of one site are judged alike; very long
    texts are read whole; an empty table gives an empty result.
    """
    out = _judged(docs, labels, host, path, least, sample)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("own", "host_posterior", "path_posterior", "quality")], "kept")


def _evidence(docs: DataFrame, labels: DataFrame, model: Classifier, host: Column | None, path: Column | None) -> DataFrame:
    wordless = F.coalesce(F.regexp_extract("text", r"[^\x20\x09-\x0D]", 0), F.lit("")) == ""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    own = F.when(wordless, 0.0).otherwise(_own_evidence(model))
    a, b = row_prints(docs)
    rows = docs.select("doc_id", a.alias("a"), b.alias("b"), host.alias("host"), path.alias("path"), own.alias("own"))
    known = small_enough(written(_known(labels), "labels"))
    return rows.join(known, "doc_id", "left").withColumn("told", F.coalesce(F.col("quality").cast("double"), F.col("own"))).drop("quality")


def _with_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds a row's site; sites are broadcast if their names are few bytes, else hot hosts are salted on both sides."""
    sites = written(sites.withColumnsRenamed({"host": "h", "path": "p"}), "sites")
    match = rows["host"].eqNullSafe(F.col("h")) & rows["path"].eqNullSafe(F.col("p"))
    size = sites.agg(F.sum(F.coalesce(F.octet_length(F.col("h").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("p").cast("string")), F.lit(0)) + 64)).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sites), match).drop("h", "p")
    salts = 32
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    spread = sites.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, match & (F.col("salt") == F.col("s"))).drop("h", "p", "salt", "s")


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps; the columns stay as they are.

    Each row goes or stays by its own verdict, whatever its id: null and empty texts go, rows equal in all columns are
    judged alike, and an empty table stays empty.
    """
    rejected = _judged(docs, labels, None, None, least, SAMPLE).where("NOT kept").select("a", "b").distinct()
    return without_rows(docs, written(rejected, "rejected"))
