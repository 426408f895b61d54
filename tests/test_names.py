import pytest
from pyspark.sql import functions as F

from seqspan.functions import names, timecode

CASES = [
    ("Show S01E01 S01E02 - T.mkv", ("Show", 1, [1, 2], None, "mkv", True)),
    ("Show S03E21 - E2.mkv", ("Show", 3, [21], None, "mkv", True)),
    ("Film 1920x1080.mkv", ("Film 1920x1080", None, [], None, "mkv", False)),
    ("/x/Some_Show.1x02-03.TS", ("Some Show", 1, [2, 3], None, "ts", True)),
    ("Show (2010) s2e5e6e4.mp4", ("Show", 2, [5, 6], 2010, "mp4", True)),
    ("1999.mkv", ("1999", None, [], 1999, "mkv", False)),
    ("Film 1999", ("Film", None, [], 1999, "", False)),
]


def test_parse(spark):
    rows = spark.createDataFrame([(n,) for n, _ in CASES], "n string").select("n", names.parse(F.col("n")).alias("x")).collect()
    told = {r.n: (r.x.show, r.x.season, r.x.episodes, r.x.year, r.x.ext, r.x.matched) for r in rows}
    assert told == dict(CASES)


def test_render(spark):
    row = spark.createDataFrame([("A/B: c", None, 0, [3, 4], "T%N?", None)], "name string, year int, season int, episodes array<int>, title string, id long")
    meta = {c: F.col(c) for c in row.columns}
    out = row.select(names.render_path("%N/%Y/Season %S/%N - S%SZE%EZ - %T.", meta).alias("p")).first().p
    assert out == "A B c/Specials/A B c - S00E03-04 - T%N"


def test_titles(spark):
    cases = [(["Gods (1)", "Gods (2)"], "Gods"), (["One", "Two - Part II", "(3)"], "One & Two & (3)"), ([], "")]
    rows = spark.createDataFrame(cases, "t array<string>, w string").select("w", names.combined_title(F.col("t")).alias("x")).collect()
    assert all(r.w == r.x for r in rows)


@pytest.mark.parametrize("text,want", [("00:01:02.03", 1553), ("1.2.3.4", 93079), ("10203", 1553), ("x", None), ("1:2", None), ("", None)])
def test_parse_timecode(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(timecode.parse_timecode(F.col("t"), 25).alias("x")).first().x == want


def test_timecodes(spark):
    row = spark.range(1).select(timecode.frame_timecode(F.lit(1553), 25).alias("a"), timecode.seconds_timecode(F.lit(59.999), 25).alias("b"), timecode.frame_timecode(F.lit(None).cast("long"), 25).alias("c")).first()
    assert (row.a, row.b, row.c) == ("00:01:02.03", "00:01:00.00", "--:--:--.--")
