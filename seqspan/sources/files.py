"""Project files and recordings in folders, by Spark's own file sources: whatever store it reads, they are read from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library

#: Bytes of a recording's start and end that its print is made of.
WINDOW = 4 << 20


def _there(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """order, root, path, size, mtime (seconds) of all files below the roots, in folders at any depth; contents aren't read.

    A root that isn't there has no files; empty files aren't listed.
    """
    found = None
    for k, root in enumerate(roots):
        if root and _there(spark, root):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            own = files.select(F.lit(k).alias("order"), F.lit(root).alias("root"), "path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
            found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "order int, root string, path string, size long, mtime long") if found is None else found


def recordings(spark: SparkSession, roots: Sequence[str], pattern: str = "*.ts") -> DataFrame:
    """path, root, size, mtime of the files whose names fit a pattern; a file under two roots counts for the first."""
    files = listing(spark, roots)
    kept = library.discovered(files, pattern)
    return kept.join(files, ["path", "root"]).select("path", "root", "size", "mtime").distinct()


def prints(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """path, print of files (path, size): sha256 over the size in digits and the first and last ``window`` bytes.

    The two stretches don't overlap, and only they are read, a file at a time: a task's memory doesn't depend on the sizes of
    files.  A file that can't be read has an empty print.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                try:
                    # Spark names local files file:/…, Arrow file:///…
                    store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                    with store.open_input_file(at) as file:
                        size = file.size()
                        digest = hashlib.sha256(str(size).encode("ascii"))
                        digest.update(file.read_at(min(window, size), 0))
                        if size > window:
                            start = max(size - window, window)
                            digest.update(file.read_at(size - start, start))
                    out.append(f"sha256:{digest.hexdigest()}")
                except OSError:
                    out.append("")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "print"])

    return files.select("path").mapInArrow(read, "path string, print string")


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _file_name(path: Column) -> Column:
    """The name a project file was written under, or else that of the file; ``path`` is one of Spark's, with escapes."""
    held = F.regexp_extract(path, r"/name=([^/]+)/[^/]*$", 1)
    # folders' names are escaped once more than files'
    return F.when(held != "", _decoded(_decoded(held))).otherwise(_decoded(F.substring_index(path, "/", -1)))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Writes project files (name, document) below a new ``folder``, each as a whole.

    Files appear when all of them are written: a write that fails leaves none.
    """
    documents.select("name", F.col("document").alias("value")).write.partitionBy("name").text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name, document of all project files below a folder: what :func:`write_documents` wrote, or files that lie there."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(_file_name(F.col("_metadata.file_path")).alias("name"), F.regexp_replace("value", r"\n\z", "").alias("document"))
