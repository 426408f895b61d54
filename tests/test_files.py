import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqspan.sources import files


def test_recordings_below_roots(spark, tmp_path):
    for name in ("a/one.ts", "a/deep/er/TWO.TS", "a/three.txt", "b/four.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    got = {(Path(r.path.removeprefix("file:")).name, r.root, r.size) for r in files.recordings(spark, [f"{a}/deep", a, b, f"{tmp_path}/none", ""]).collect()}
    assert got == {("one.ts", a, 8), ("TWO.TS", f"{a}/deep", 16), ("four.ts", b, 9)}
    assert files.recordings(spark, [f"{tmp_path}/none"]).collect() == []


@pytest.mark.parametrize("size", [5, 10, 11, 19, 20, 21, 500])
def test_prints_read_both_ends(spark, tmp_path, size):
    data = bytes(i % 251 for i in range(size))
    (tmp_path / "x.ts").write_bytes(data)
    want = hashlib.sha256(str(size).encode() + data[:10] + (data[max(size - 10, 10) :] if size > 10 else b"")).hexdigest()
    found = files.listing(spark, [str(tmp_path)])
    gone = found.withColumn("path", F.concat("path", F.lit(".gone")))
    assert [r.print for r in files.prints(found, 10).collect()] == [f"sha256:{want}"]
    assert [r.print for r in files.prints(gone, 10).collect()] == [""]


def test_documents_round_trip(spark, tmp_path):
    docs = {"a.edl": "1\t2\t0\n3\t4\t0", "b c+d%20é=.vprj": "<x/>\n", "empty.swproj": "", "Ü:?.edl": "é"}
    folder = f"{tmp_path}/out"
    files.write_documents(spark.createDataFrame(list(docs.items()), "name string, document string"), folder)
    assert {r.name: r.document for r in files.read_documents(spark, folder).collect()} == docs
    (tmp_path / "plain/sub").mkdir(parents=True)
    (tmp_path / "plain/sub/x y.edl").write_text("5 6 0\n")
    assert [(r.name, r.document) for r in files.read_documents(spark, f"{tmp_path}/plain").collect()] == [("x y.edl", "5 6 0")]


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(0, 40, 1, 8).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 33, F.raise_error("broken")).otherwise("x").alias("document"))
    with pytest.raises(Exception, match="broken"):
        files.write_documents(rows, str(folder))
    assert not folder.exists() or not [p for p in folder.rglob("*") if p.is_file() and "_temporary" not in str(p)]
