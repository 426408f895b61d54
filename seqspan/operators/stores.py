"""Tables that change together: each commit writes new versions of them, and a manifest that is written last switches to them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest's rows: where each store's table lies, and what was committed so far.
MANIFEST = "store string, path string, tokens array<string>"
#: Commits whose tokens are remembered.
REMEMBERED = 10_000


def _manifests(spark: SparkSession, folder: str) -> tuple[int | None, int]:
    """(the number of the newest whole manifest, the next free one); one without its mark of success was never finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/manifest")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = lambda p: int(p.getName().removeprefix("n="))
    whole = max((number(p) for p in found if fs.exists(path(p, "_SUCCESS"))), default=None)
    return whole, 1 + max((number(p) for p in found), default=-1)


def opened(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The stores as the last whole commit left them, empty ones before the first."""
    n, _ = _manifests(spark, folder)
    at = {} if n is None else {r["store"]: r["path"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/n={n}").select("store", "path").collect()}
    return {name: spark.read.schema(schema).parquet(at[name]) if name in at else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Tokens of the commits so far, the newest last."""
    n, _ = _manifests(spark, folder)
    row = None if n is None else spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/n={n}").first()
    return list(row["tokens"]) if row else []


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], token: str) -> bool:
    """Writes new versions of all ``tables`` as one commit; False if ``token`` was committed before.

    What fails before the manifest is written leaves all stores as they were, and the same commit can be tried again.  Of two
    commits at once the later fails, as its manifest is there already.
    """
    before = committed(spark, folder)
    if token in before:
        return False
    _, n = _manifests(spark, folder)
    rows = []
    for name, df in tables.items():
        path = f"{folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows.append((name, path, [*before, token][-REMEMBERED:]))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest/n={n}")
    return True


def learned(stores: Mapping[str, DataFrame], gate: DataFrame, contrast: DataFrame, results: DataFrame, cards: DataFrame, onsets: DataFrame, keep_cards: int = 4, close: float = 8.0, keep_projects: int = 6, keep_results: int = 8) -> dict[str, DataFrame]:
    """The stores (:data:`LEARNING`) after corrected projects; those that ``gate`` (key, project, reason) doesn't find ``ok`` teach nothing.

    ``contrast`` (key, project, kind, pixel, contrast) gives a channel's new mask, which joins its history untried;
    ``results`` (key, project, model, good, false, fit, order) are those of the masks held before, other masks' aren't
    recorded; ``cards`` (key, project, order, fp) and ``onsets`` (key, project, order, side, offset, fp) are what was found at
    the project's edges.  A project that is learned from again replaces what it taught.
    """
    from . import cards as cd
    from . import learn, masks

    ok = gate.where("reason = 'ok'").select("key", "project").distinct()
    good = lambda df: df.join(ok, ["key", "project"], "left_semi")
    held = stores["masks"]
    records = masks.recorded(stores["records"], good(results).select(*stores["records"].columns), keep_results, held)
    found = learn.learned_mask(good(contrast)).select("key", F.lit(True).alias("new"))
    span = held.groupBy("key").agg(F.max("model").alias("model"), F.min("place").alias("place"))
    new = found.join(span, "key", "left").select("key", (F.coalesce("model", F.lit(0)) + 1).alias("model"), (F.coalesce("place", F.lit(1)) - 1).alias("place"), F.col("model").isNull().alias("current"))
    history = masks.active(held.unionByName(new), records).where("kept").select("key", "model", "place", F.col("used").alias("current"))
    latest = good(cards).groupBy("key").agg(F.max(F.struct("order", "fp")).alias("x")).select("key", "x.order", "x.fp")
    again = good(onsets)
    old = stores["markers"].join(again.select("key", "project").distinct(), ["key", "project"], "left_anti")
    every = old.unionByName(again.select(*old.columns))
    kept = learn.newest(every.groupBy("key", "project").agg(F.max("order").alias("order")), ["key"], keep_projects).select("key", "project")
    return {"records": records, "masks": history, "cards": cd.added_cards(stores["cards"], latest, close, keep_cards), "markers": every.join(kept, ["key", "project"], "left_semi")}


#: What is learned from corrected projects, by channel.
LEARNING = {
    "masks": "key long, model long, place long, current boolean",
    "records": "key long, model long, project string, good double, false long, fit boolean, order long",
    "cards": "key long, order long, fp array<double>",
    "markers": "key long, project string, order long, side long, offset double, fp array<double>",
}


def learn_projects(spark: SparkSession, folder: str, token: str, gate: DataFrame, contrast: DataFrame, results: DataFrame, cards: DataFrame, onsets: DataFrame, **bounds) -> bool:
    """Learns from corrected projects in one commit to the stores in ``folder``; ``token`` names the correction."""
    if token in committed(spark, folder):
        return False
    return commit(spark, folder, learned(opened(spark, folder, LEARNING), gate, contrast, results, cards, onsets, **bounds), token)
