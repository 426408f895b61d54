"""Registered queries over files: project files in a folder, and the files of the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files, projects
from ..tables import shared_folder, written
from . import adapters as src
from .adapters import with_tables


def project_files(spark, sf_dir):
    """Cuts in three formats, those of 150 recordings a file, written to a folder of the shared store and read from it."""
    c = src.cuts(spark, sf_dir).where("b > a")
    number = F.floor(F.col("rec_id") / 150).cast("long")
    ext = F.when(number % 3 == 0, ".EDL").when(number % 3 == 1, ".swproj").otherwise(".vprj")
    name = F.concat(F.lit("r + 5%: "), number.cast("string"), ext)
    folder = f"{shared_folder(spark)}/projects-{uuid.uuid4().hex}"
    files.write_documents(projects.write_any(c.select(name.alias("name"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")), 25.0), folder)
    read = written(files.read_documents(spark, folder), "documents")
    return projects.read_any(read, read.select("name", F.lit(1_000_000).cast("long").alias("frames"), F.lit(25.0).alias("fps")))


def table_files(spark, sf_dir):
    """The files that the given tables consist of, with their prints."""
    found = files.recordings(spark, [sf_dir, f"{sf_dir}/none", sf_dir], "*.parquet")
    return found.join(files.prints(found), "path").select(F.expr(f"substring(path, instr(path, '{sf_dir.rstrip('/').split('/')[-1]}/'))").alias("path"), "size", "print")


QUERIES = {f.__name__: f for f in (project_files, table_files)}
ORACLES = {
    "project_files": with_tables("cuts", "SELECT 'r + 5%: ' || rec_id // 150 || CASE rec_id // 150 % 3 WHEN 0 THEN '.EDL' WHEN 1 THEN '.swproj' ELSE '.vprj' END AS name, a::DOUBLE AS a, b::DOUBLE AS b FROM cuts WHERE b > a"),
}
