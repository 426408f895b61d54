import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqspan.tables import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == columns
        kept[name] = (docs.count(), after.count())
        assert after.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        docs = after
    assert kept["exact_dedup"][1] <= kept["exact_dedup"][0]
    bodies = docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("b"))
    assert bodies.distinct().count() == bodies.count()
    pieces = corpus_pipeline.run(spark, DATA)
    total = pieces.agg(F.sum("piece_length")).first()[0]
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.select("text").collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "exact_dedup", "minhash_near_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


SOUNDS = {"en": ["the", "ing", "th", "ou", "ea"], "de": ["der", "ung", "sch", "ei", "ach"]}


def small_corpus(spark, folder):
    """Clean texts in two languages, junk, copies and near copies; ids repeated with other texts, equal rows, null ids."""
    random.seed(3)
    text = lambda lang: " ".join("".join(random.choice(SOUNDS[lang]) for _ in range(random.randint(1, 3))) for _ in range(random.randint(40, 90))) + "."
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(120)]
    junk = [(200 + i, "$$$ ### @@@ %%% " * 20 + "x", "en", "s1", 1) for i in range(30)]
    long = text("en")
    near = "then " + long
    odd = [(300, long, "en", "s0", 1), (301, long + " ", "en", "s0", 1), (302, near, "en", "s0", 1), (5, text("en"), "en", "s0", 1), (400, rows[9][1], "en", "s9", 1)]
    twin = (500, text("en"), "en", "s0", 1)
    nulls = [(None, text("en"), "en", "s0", 1), (None, text("en"), None, None, None), (None, None, None, None, None), (600, "", "en", "s0", 1), (601, " 12 !!", "en", "s0", 1)]
    docs = spark.createDataFrame(rows + junk + odd + [twin, twin] + nulls, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 0 if r[0] >= 200 else 1, 0) for r in rows[:80] + junk[:20]], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    # what stays: all clean texts once (the longest of exact copies, the smallest id of near ones); of the pair 5 both texts
    clean = {(r[0], r[1]) for r in rows} | {(5, odd[3][1]), (500, twin[1]), (None, nulls[0][1]), (None, nulls[1][1])} | {(301, long + " ")}
    return clean


def test_run_loses_no_unique_text(spark, tmp_path):
    clean = small_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/after")
        docs = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/after").collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(left) - clean == set() and clean - set(left) == set() and len(left) == len(clean)
    words = sum(len(t.split()) for _, t in clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("piece_length")).first()[0] == words


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


EXTRA = ["'v' AS `x.y`", "1 AS `x`", "2 AS a", "3 AS `row`", "4 AS print_a", "5 AS `tick``s`", "6 AS told", "map('k', 1) AS score"]


def test_dotted_and_clashing_columns(spark, tmp_path):
    """Every stage and the whole run over rows with odd extra columns, repeated rows and repeated ids among them."""
    clean = small_corpus(spark, tmp_path / "plain")
    spark.read.parquet(f"{tmp_path}/plain/documents.parquet").selectExpr("*", *EXTRA).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{tmp_path}/plain/labels.parquet").write.parquet(f"{tmp_path}/odd/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, f"{tmp_path}/odd"), name)
        assert after.columns == docs.columns
        docs = after
    left = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(left, key=str) == sorted(clean, key=str)
    assert {tuple(r) for r in docs.select("`x.y`", "x", "a", "row", "`tick``s`").collect()} == {("v", 1, 2, 3, 5)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/odd")
    assert pieces.agg(F.sum("piece_length")).first()[0] == sum(len(t.split()) for _, t in clean)


def test_unique_ids_with_dotted_columns(spark):
    docs = spark.range(30).selectExpr("id AS doc_id", "concat('one two three four five six seven ', id % 3) AS text", *EXTRA)
    from seqspan.llm import chosenpath, exactdedup

    for stage in (exactdedup.drop_exact_copies, chosenpath.drop_near_copies):
        assert stage(docs).columns == docs.columns
    assert exactdedup.drop_exact_copies(docs).count() == 3
