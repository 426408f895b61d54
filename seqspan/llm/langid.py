"""Language ID: language family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import columns, unused, written
from .textbits import chunks, strings

#: Families of the languages that are hard to tell apart; a language without an entry is a family of its own.
FAMILIES: Mapping[str, str] = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
UNDETERMINED = "und"
#: Different labelled texts that are learned from, per language (a hash of the text picks about so many, and no more stay).
SAMPLE_PER_LANGUAGE = 600
#: Languages that are learned: the commonest labels.  Pairs of languages, and so machines, grow with the square of this.
MOST_LANGUAGES = 100
#: Families, or languages of a family, that a task trains machines between, twice so many at most.
GROUP = 4
#: Texts whose counts are held at a time.
HELD = 512
DIMENSIONS = 1 << 13
_SCALE = 100.0

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte 2- to 4-grams, grams before each row); what isn't a letter counts as one space."""
    folded = _FOLD[raw]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    keep[at[:-1][at[:-1] < len(raw)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    x, at = folded[keep].astype(np.uint32), before[at]
    n = len(x)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(at), np.int64)
    padded = np.concatenate([x, np.full(3, 32, np.uint32)])
    ahead = [x, *[padded[d : n + d].copy() for d in (1, 2, 3)]]
    full = np.diff(at) > 0
    begin, end = at[:-1][full], at[1:][full]
    for d in (1, 2, 3):  # spaces follow a row, not the next one's letters
        for back in range(1, d + 1):
            ahead[d][np.maximum(end - back, begin)] = 32
    two = ahead[0] * np.uint32(257) + ahead[1]
    three = two * np.uint32(257) + ahead[2]
    out = np.empty((n, 3), dtype=np.int32)
    for j, (gram, factor) in enumerate(((two, 2654435761), (three, 2246822519), (three * np.uint32(257) + ahead[3], 3266489917))):
        out[:, j] = (gram * np.uint32(factor)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return out.reshape(-1), at * 3


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _counts(gram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How often each text has each hashed gram."""
    n = len(before) - 1
    flat = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(before)) + gram[before[0] : before[-1]]
    return np.bincount(flat, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's grams: their places and counts, with lang and rank."""
    for b in batches:
        raw, at = strings(_lowered(b.column("text")))
        places, counts = [], []
        for _, _, part, ends in chunks(raw, at):
            gram, before = _grams(part, ends)
            for k in range(len(ends) - 1):
                place, count = np.unique(gram[before[k] : before[k + 1]], return_counts=True)
                places.append(place.astype(np.int32).tobytes())
                counts.append(count.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["lang", "rank", "places", "counts"])


def _dense(places: Sequence[bytes], counts: Sequence[bytes]) -> np.ndarray:
    out = np.zeros((len(places), DIMENSIONS), dtype=np.float32)
    for row, place, count in zip(out, places, counts, strict=True):
        n = np.frombuffer(count, np.int32)
        if len(n):
            row[np.frombuffer(place, np.int32)] = n / n.sum() * _SCALE
    return out


def fit_svm(x: np.ndarray, sign: np.ndarray, penalty: float = 0.02, rounds: int = 300) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss, both sides weighing the same; accelerated descent.

    With fewer rows than columns the steps are taken in the rows' coefficients (the weights are sums of rows), which gives
    the same weights from the rows' inner products alone.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    sign = sign.astype(x.dtype)
    by_rows = len(x) < x.shape[1]
    inner = x @ x.T if by_rows else x
    probe = np.ones(inner.shape[1], x.dtype)
    for _ in range(12):
        probe = probe / np.linalg.norm(probe)
        probe = weight * (inner @ probe) if by_rows else x.T @ (weight * (x @ probe))
    rate = 1.0 / (2 * np.linalg.norm(probe) + penalty)
    w = ahead = np.zeros(inner.shape[1], x.dtype)
    for k in range(rounds):
        pull = weight * np.maximum(0, 1 - sign * (inner @ ahead)) * sign
        step = ahead - rate * (penalty * ahead - 2 * (pull if by_rows else x.T @ pull))
        ahead = step + (k / (k + 3.0)) * (step - w)
        w = step
    return (x.T @ w if by_rows else w).astype(np.float32)


class Model:
    """Learned machines: (plus, minus, weights) over families, and over the languages within each family."""

    def __init__(self, languages: list[str], families: Mapping[str, str], machines: Mapping[tuple[str, str, str], np.ndarray]):
        self.languages = sorted(languages)
        self.members = defaultdict(list)
        for x in self.languages:
            self.members[families.get(x, x)].append(x)
        self.pairs: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for level, plus, minus in sorted(machines):
            self.pairs[level].append((plus, minus))
        self.weights = {level: np.stack([machines[level, *p] for p in pairs], axis=1) for level, pairs in self.pairs.items()}

    def _margins(self, level: str, counts: np.ndarray) -> np.ndarray:
        if level not in self.weights:
            return np.zeros((len(counts), 0))
        w = self.weights[level]
        return (counts @ w[:-1]).astype(np.float64) / np.maximum(counts.sum(axis=1, dtype=np.float64), 1)[:, None] * _SCALE + w[-1]

    def _pick(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the name with most of the pairwise decisions and then the widest margins, its probability)."""
        if len(names) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        plus, minus = (np.array([[p[side] == x for x in names] for p in self.pairs[level]], dtype=np.float64) for side in (0, 1))
        p = 1 / (1 + np.exp(-np.clip(2 * margins, -40, 40)))
        won = (p >= 0.5).astype(np.float64)
        wins, sums = won @ plus + (1 - won) @ minus, p @ plus + (1 - p) @ minus
        best = (wins + sums / len(names)).argmax(axis=1)  # the sums are less than the number of names
        return best, np.clip(sums[np.arange(len(sums)), best] / (len(names) - 1), 0, 1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The family first, by its machines; then the language, by the machines of that family alone."""
        lowered = _lowered(column)
        lettered = pc.match_substring_regex(lowered, r"\p{L}").to_numpy(zero_copy_only=False)
        name, score = np.full(len(column), UNDETERMINED, dtype=object), np.zeros(len(column))
        if not self.languages:
            return name.tolist(), score
        raw, at = strings(lowered)
        families = sorted(self.members)
        for i, j, part, ends in chunks(raw, at):
            gram, before = _grams(part, ends)
            for a in range(0, j - i, HELD):
                counts = _counts(gram, before[a : min(a + HELD, j - i) + 1])
                family, sure = self._pick("family", families, self._margins("family", counts))
                for f in np.unique(family):
                    rows, kin = np.flatnonzero(family == f), families[f]
                    best, own = self._pick(kin, self.members[kin], self._margins(kin, counts[rows]))
                    name[i + a + rows] = np.array(self.members[kin], dtype=object)[best]
                    score[i + a + rows] = sure[rows] * own
        name[~lettered], score[~lettered] = UNDETERMINED, 0.0
        return name.tolist(), score


def _cells(languages: list[str], families: Mapping[str, str], per_language: int, per_family: int) -> list[tuple[str, int, int, str, str, int, int]]:
    """(level, first, second, lang, name, group, most): the texts of ``lang`` that a cell of machines learns from.

    A level's names, families or the languages of one, are dealt into groups; a cell has the machines between the names of
    two groups, or within one.  So a text goes to as many cells as there are groups, not to each machine.
    """
    kin = defaultdict(list)
    for x in languages:
        kin[families.get(x, x)].append(x)
    levels = {"family": [(f, x, max(1, per_family // len(own))) for f, own in sorted(kin.items()) for x in own]}
    levels |= {f: [(x, x, per_language) for x in own] for f, own in kin.items() if len(own) > 1}
    out = []
    for level, rows in levels.items():
        names = sorted({name for name, _, _ in rows})
        if len(names) > 1:
            groups = range(-(-len(names) // GROUP))
            for name, lang, most in rows:
                own = names.index(name) // GROUP
                out += [(level, min(own, g), max(own, g), lang, name, own, most) for g in groups]
    return out


def _fit_cell(cell: pd.DataFrame) -> pd.DataFrame:
    cell = cell.sort_values(["name", "lang", "rank"])
    level, first, second = cell["level"].iloc[0], cell["first"].iloc[0], cell["second"].iloc[0]
    names = sorted(cell["name"].unique())
    group = dict(zip(cell["name"], cell["group"], strict=True))
    rows = {x: part for x, part in cell.groupby("name")}
    out = []
    for plus, minus in combinations(names, 2):
        if first == second or group[plus] != group[minus]:
            a, b = rows[plus], rows[minus]
            x = np.concatenate([_dense(a["places"], a["counts"]), _dense(b["places"], b["counts"])])
            out.append((level, plus, minus, fit_svm(x, np.repeat([1, -1], [len(a), len(b)])).tobytes()))
    return pd.DataFrame(out, columns=["level", "plus", "minus", "weights"])


def train(rows: DataFrame, families: Mapping[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE, per_family: int | None = None) -> Model:
    """Learns from ``rows`` (text, lang): ``per_language`` different texts of each language at most, picked by a hash.

    Null texts and null languages are left out, and of more than ``MOST_LANGUAGES`` labels the rarest.  A text counts once a
    language, however often it is repeated.  A family's machines learn from ``per_family`` texts of it (twice
    ``per_language`` where unset), as many of each of its languages.  The sample's grams are written once; machines are
    trained in parallel, a task has those between some names, and their weights (32 kB each) fit the driver by the bound on
    languages: 160 MB at most.
    """
    spark = rows.sparkSession
    known = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    texts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang")
    count = {r["lang"]: max(1, r["n"]) for r in texts.limit(MOST_LANGUAGES).collect()}
    languages = sorted(count)
    cells = _cells(languages, families, per_language, 2 * per_language if per_family is None else per_family)
    if not cells:
        return Model(languages, families, {})
    shares = spark.createDataFrame([(x, min(1.0, per_language / n)) for x, n in count.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000))
    # repeats of a text are combined where they are read; what is ranked is about per_language texts a language
    picked = known.join(F.broadcast(shares), "lang").where(draw < F.col("share") * 1_000_000).select("text", "lang").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(draw, "text"))
    picked = picked.withColumn("rank", rank).where(F.col("rank") <= per_language)
    grams = written(picked.select("lang", "rank", "text").mapInArrow(_features, "lang string, rank int, places binary, counts binary"), "sample")
    dealt = spark.createDataFrame(cells, "level string, first int, second int, lang string, name string, group int, most int")
    sent = grams.join(F.broadcast(dealt), "lang").where("rank <= most")
    learned = sent.groupBy("level", "first", "second").applyInPandas(_fit_cell, "level string, plus string, minus string, weights binary")
    learned = written(learned, "machines")
    return Model(languages, families, {(r["level"], r["plus"], r["minus"]): np.frombuffer(r["weights"], np.float32) for r in learned.toLocalIterator()})


def _teller(model: Model):
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def tell(column: pa.Array) -> pa.Array:
        name, score = model.predict(column)
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return tell


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, and any other columns, which stay) with lang_pred and score, from the whole text alone.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text where nothing was learned.
    Columns of ``docs`` that are named lang_pred or score are replaced.  Repeated rows get equal predictions.
    """
    clean = docs.drop("lang_pred", "score")
    (told,) = unused(clean, "told")
    out = clean.withColumn(told, _teller(model)("text"))
    return out.select(*columns(clean), F.col(told)["lang_pred"].alias("lang_pred"), F.col(told)["score"].alias("score"))


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, families: Mapping[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang), learned from the rows not held out.

    A null doc_id is never held out.  Texts that are null, empty or without a letter are ``und`` with score 0; very long ones
    are read whole.  Of languages that tie in won pairs the one with the greater sum of probabilities is told, then the one
    first in the alphabet.  Repeated rows get equal results; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), families, per_language)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


#: Below this score the pipeline takes a text's language as not determined.
LEAST_SCORE = 0.3


def drop_undetermined(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language can be told with a score of ``least`` or more; the columns stay as they are.

    Each row is judged by its own text: null and empty texts and those without a letter go, repeated rows stay or go alike,
    whatever their ids, and an empty table stays empty.  Columns named lang_pred or score have no bearing.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    (told,) = unused(docs, "told")
    sure = (F.col(told)["lang_pred"] != UNDETERMINED) & (F.col(told)["score"] >= least)
    return docs.withColumn(told, _teller(model)("text")).where(sure).drop(told)


def held_out_accuracy(predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows and share of held-out rows with a label whose prediction is that label."""
    told = predicted.where("held_out").join(docs.select("doc_id", "lang").where("lang IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id")
    return told.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy"))

