"""Project formats: cut lists as text, JSON documents and tick-based XML, read and written as columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A project document: what was cut from which source, and who says so.
PROJECT = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("source", T.StructType([T.StructField("path", T.StringType()), T.StructField("frames", T.LongType()), T.StructField("fps", T.DoubleType()), T.StructField("duration", T.DoubleType()), T.StructField("fingerprint", T.StringType())])),
    T.StructField("cuts", T.ArrayType(T.StructType([T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
    T.StructField("markers", T.ArrayType(T.StructType([T.StructField("frame", T.LongType()), T.StructField("time", T.DoubleType())]))),
])
TICKS = 10_000_000


def read_cut_list(lines: DataFrame) -> DataFrame:
    """name, place, a, b of cut lists (name, place, line): start, end and an action that doesn't matter, in seconds.

    Blank lines, comments, lines with fewer than two fields or without numbers are skipped; reversed cuts are turned round.
    """
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    a, b = F.get(fields, F.lit(0)).try_cast("double"), F.get(fields, F.lit(1)).try_cast("double")
    rows = lines.where(~F.trim("line").startswith("#")).select("name", "place", a.alias("x"), b.alias("y"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL").select("name", "place", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def write_cut_list(cuts: DataFrame) -> DataFrame:
    """name, place, line of cuts (name, place, a, b in seconds)."""
    at = lambda c: F.format_string("%.2f", F.greatest(F.lit(0.0), F.col(c).cast("double")))
    return cuts.select("name", "place", F.concat(at("a"), F.lit("\t"), at("b"), F.lit("\t0")).alias("line"))


def write_project(cuts: DataFrame, fps: float, prints: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """name, document: one JSON document for each name of cuts (name, start_frame, end_frame, frames).

    ``prints`` (name, print) are the recordings' content prints, ``markers`` (name, frame) go along.
    """
    seconds = lambda c: F.round(F.col(c) / fps, 6)
    cut = F.struct("start_frame", "end_frame", seconds("start_frame").alias("start"), seconds("end_frame").alias("end"))
    grouped = cuts.groupBy("name").agg(F.max("frames").alias("frames"), F.array_sort(F.collect_list(cut)).alias("cuts"))
    grouped = grouped.withColumn("print", F.lit(None).cast("string")) if prints is None else grouped.join(prints.select("name", "print"), "name", "left")
    if markers is None:
        grouped = grouped.withColumn("markers", F.lit(None).cast(PROJECT["markers"].dataType))
    else:
        listed = markers.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("frame", seconds("frame").alias("time")))).alias("markers"))
        grouped = grouped.join(listed, "name", "left")
    source = F.struct(F.concat("name", F.lit(".ts")).alias("path"), "frames", F.lit(fps).alias("fps"), F.col("print").alias("fingerprint"))
    return grouped.select("name", F.to_json(F.struct(F.lit(1).cast("long").alias("version"), source.alias("source"), "cuts", "markers")).alias("document"))


def _opened(documents: DataFrame, recordings: DataFrame) -> tuple[DataFrame, Column]:
    parsed = documents.select("name", F.from_json("document", PROJECT).alias("p")).where("p.version = 1")
    known = recordings if "print" in recordings.columns else recordings.withColumn("print", F.lit(None).cast("string"))
    rows = parsed.join(known.select("name", "frames", "fps", "print"), "name")
    # frames count if the recording has as many, and the same content where both prints are known
    same = F.coalesce(F.col("p.source.frames") == F.col("frames"), F.lit(False)) & F.coalesce(F.col("p.source.fingerprint") == F.col("print"), F.lit(True))
    return rows.withColumn("same", same), F.col("frames") - 1


def read_project(documents: DataFrame, recordings: DataFrame) -> DataFrame:
    """name, start_frame, end_frame of project documents (name, document) against recordings (name, frames, fps, and perhaps print).

    Stored frames count where the recording is the same: as many frames and, where both are known, the same content print;
    else seconds are mapped by the recording's rate, a start at or before 0 to frame 0.  Reversed cuts are turned round,
    documents of another version are left out, as are cuts without an end.
    """
    rows, last = _opened(documents, recordings)
    mapped = lambda c: F.greatest(F.lit(0), F.least(last, F.bround(F.col(c) * F.col("fps")).cast("long")))
    each = rows.select("name", "frames", "fps", "same", F.explode("p.cuts").alias("c"))
    stored = F.col("same") & F.col("c.start_frame").isNotNull() & F.col("c.end_frame").isNotNull()
    out = each.select("name", F.when(stored, F.col("c.start_frame")).otherwise(mapped("c.start")).alias("x"), F.when(stored, F.col("c.end_frame")).otherwise(mapped("c.end")).alias("y"))
    return out.where("x IS NOT NULL AND y IS NOT NULL").select("name", F.least("x", "y").alias("start_frame"), F.greatest("x", "y").alias("end_frame"))


def read_project_markers(documents: DataFrame, recordings: DataFrame) -> DataFrame:
    """name, frame: the markers of project documents, as frames by the same rule, each once, inside the recording."""
    rows, _ = _opened(documents, recordings)
    each = rows.select("name", "frames", "fps", "same", F.explode("p.markers").alias("m"))
    frame = F.when(F.col("same") & F.col("m.frame").isNotNull(), F.col("m.frame")).otherwise(F.bround(F.coalesce("m.time", F.lit(0.0)) * F.col("fps")).cast("long"))
    return each.withColumn("frame", frame).where("frame >= 0 AND frame < frames").select("name", "frame").distinct()


def write_ticks(cuts: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """name, document: an XML document with cuts (name, a, b) and scene markers (name, at), both in seconds, in ticks."""
    ticks = lambda c: F.greatest(F.lit(0).cast("long"), F.bround(F.col(c).cast("double") * TICKS).cast("long")).cast("string")
    cut = F.struct("a", "b", F.concat(F.lit("<cut><CutTimeStart>"), ticks("a"), F.lit("</CutTimeStart><CutTimeEnd>"), ticks("b"), F.lit("</CutTimeEnd></cut>")).alias("x"))
    grouped = cuts.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda c: c["x"]), "").alias("cuts"))
    if markers is None:
        scenes = F.lit("")
    else:
        mark = F.struct("at", F.concat(F.lit("<SceneMarker>"), ticks("at"), F.lit("</SceneMarker>")).alias("x"))
        listed = markers.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(mark)), lambda c: c["x"]), "").alias("scenes"))
        grouped = grouped.join(listed, "name", "left")
        scenes = F.coalesce(F.concat(F.lit("<SceneList>"), "scenes", F.lit("</SceneList>")), F.lit(""))
    return grouped.select("name", F.concat(F.lit('<Project Version="5"><CutList>'), "cuts", F.lit("</CutList>"), scenes, F.lit("</Project>")).alias("document"))


def read_ticks(documents: DataFrame) -> DataFrame:
    """name, a, b (seconds) of XML documents with cuts in ticks, of either version (``Cut`` or ``cut``).

    A cut without both times, or with one that is no number, is skipped; reversed cuts are turned round.
    """
    each = documents.select("name", F.explode(F.regexp_extract_all("document", F.lit(r"(?s)<[Cc]ut\b[^>]*>(.*?)</[Cc]ut>"), 1)).alias("cut"))
    seconds = lambda tag: F.regexp_extract("cut", rf"{tag}>\s*(\d+)\s*<", 1).try_cast("long") / TICKS
    rows = each.select("name", seconds("CutTimeStart").alias("x"), seconds("CutTimeEnd").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.select("name", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def read_markers(documents: DataFrame, recordings: DataFrame) -> DataFrame:
    """name, frame: scene markers of XML documents as frames of recordings (name, frames, fps), each once, inside the recording."""
    each = documents.select("name", F.explode(F.regexp_extract_all("document", F.lit(r"<SceneMarker[^>]*>\s*(\d+)\s*</SceneMarker>"), 1)).alias("tick"))
    frame = F.bround(F.col("tick").try_cast("long") / TICKS * F.col("fps")).cast("long")
    return each.join(recordings, "name").select("name", "frames", frame.alias("frame")).where("frame >= 0 AND frame < frames").select("name", "frame").distinct()


def read_seconds(documents: DataFrame) -> DataFrame:
    """name, a, b, duration: the cuts of project documents (name, document) of any kind in seconds, 0 at least, and the duration.

    JSON documents hold both in seconds, XML ones in ticks; a duration that isn't told is 0.
    """
    told = documents.withColumn("format", document_format(F.col("name")))
    parsed = told.where("format = 'project'").select("name", F.from_json("document", PROJECT).alias("p"))
    json = parsed.select("name", F.explode("p.cuts").alias("c"), F.coalesce("p.source.duration", F.lit(0.0)).alias("duration"))
    json = json.select("name", F.greatest(F.lit(0.0), F.coalesce("c.start", F.lit(0.0))).alias("a"), F.coalesce("c.end", F.lit(0.0)).alias("b"), "duration")
    xml = told.where("format = 'ticks'").select("name", "document")
    length = xml.select("name", F.coalesce(F.regexp_extract("document", r"<Duration>(\d+)</Duration>", 1).try_cast("long") / TICKS, F.lit(0.0)).alias("duration"))
    return json.unionByName(read_ticks(xml).join(length, "name"))


def chapters(durations: DataFrame, extra: DataFrame, apart: float = 0.05) -> DataFrame:
    """name, mark: scene starts and extra marks within the whole, without those less than ``apart`` behind the last one kept.

    What is kept depends on what was kept before: a fold over each name's sorted marks.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("name").orderBy("seq")
    starts = durations.select("name", F.coalesce(F.sum("duration").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("mark"))
    total = durations.groupBy("name").agg(F.sum("duration").alias("total"))
    marks = starts.unionByName(extra.select("name", "mark")).join(total, "name").where("mark >= 0 AND mark < total")
    listed = marks.groupBy("name").agg(F.array_sort(F.collect_list(F.col("mark").cast("double"))).alias("m"))
    start = F.array().cast("array<double>")
    kept = F.aggregate("m", start, lambda acc, x: F.when((F.size(acc) == 0) | (F.round(x - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)), 9) >= apart), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select("name", F.explode(kept).alias("mark"))


def marks_in_output(marks: DataFrame, spans: DataFrame, jumps: DataFrame) -> DataFrame:
    """rec_id, id, out of marks (rec_id, id, at) inside kept spans (rec_id, k, s, e), at their time in the output.

    Clock jumps (rec_id, split2, amount) between a span's start and a mark are taken off, and those in the spans before; no mark
    comes before its span.
    """
    from ..operators.carry import moved

    rows = marks.select("rec_id", F.col("id").alias("seq"), F.col("at").alias("pts"))
    return moved(rows, spans, spans, jumps, 86_400_000).select("rec_id", F.col("seq").alias("id"), F.greatest("out", "begin").alias("out"))


#: A list of scenes to join.
SCENES = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("source", T.StringType()), T.StructField("path", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
        T.StructField("fps", T.DoubleType()), T.StructField("fade_in", T.DoubleType()), T.StructField("fade_out", T.DoubleType()), T.StructField("cuts", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]))),
    T.StructField("batch", T.StructType([T.StructField("reencode_target", T.ArrayType(T.DoubleType()))])),
])


def write_scene_list(scenes: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """name, document: a JSON document for each list of scenes (name, seq, kind, source, start, end, cuts), in order.

    ``target`` (name, w, h, fps) is what a queued join is coded anew for.
    """
    entry = F.struct("seq", F.struct("kind", "source", "start", "end", F.lit(25.0).alias("fps"), F.lit(0.0).alias("fade_in"), F.lit(0.0).alias("fade_out"), "cuts").alias("e"))
    grouped = scenes.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    version = F.lit(1).cast("long").alias("version")
    if target is None:
        return grouped.select("name", F.to_json(F.struct(version, "entries")).alias("document"))
    size = F.when(F.col("w").isNotNull(), F.array(F.col("w").cast("double"), F.col("h").cast("double"), F.col("fps").cast("double")))
    return grouped.join(target, "name", "left").select("name", F.to_json(F.struct(version, "entries", F.struct(size.alias("reencode_target")).alias("batch"))).alias("document"))


def read_scene_list(documents: DataFrame) -> DataFrame:
    """name, seq, kind, source, start, end, duration, cuts, target of lists of scenes (name, document), in order from 0.

    Missing fields have their defaults: a scene from 0 to 0, its source the path.  A target that isn't three numbers is none.
    """
    parsed = documents.select("name", F.from_json("document", SCENES).alias("p"))
    rows = parsed.select("name", F.when(F.size("p.batch.reencode_target") == 3, F.col("p.batch.reencode_target")).alias("target"), F.posexplode("p.entries").alias("seq", "e"))
    start, end = F.coalesce("e.start", F.lit(0.0)), F.coalesce("e.end", F.lit(0.0))
    source = F.coalesce(F.when(F.col("e.source") != "", F.col("e.source")), "e.path", F.lit(""))
    return rows.select(
        "name", "seq", F.coalesce("e.kind", F.lit("scene")).alias("kind"), source.alias("source"), start.alias("start"), end.alias("end"), F.greatest(F.lit(0.0), end - start).alias("duration"),
        F.coalesce("e.cuts", F.array().cast("array<array<double>>")).alias("cuts"), "target",
    )


def joined_paths(scenes: DataFrame, lists: DataFrame) -> DataFrame:
    """name, path: what a join is called: after its first recording, in its folder and with its extension.

    A list (name, folder) of title cards alone is ``Joined Video.ts`` in its own folder.
    """
    first = scenes.where("kind <> 'title' AND source <> ''").groupBy("name").agg(F.min(F.struct("seq", "source"))["source"].alias("first"))
    file = F.substring_index("first", "/", -1)
    folder = F.when(F.col("first").contains("/"), F.regexp_extract("first", r"^(.*)/[^/]*$", 1)).otherwise("")
    stem, ext = F.regexp_extract(file, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(file, r"^.+?(\.[^.]*)$", 1)
    made = F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), stem, F.lit(" - Joined"), F.when(ext != "", ext).otherwise(".ts"))
    return lists.join(first, "name", "left").select("name", F.when(F.col("first").isNotNull(), made).otherwise(F.concat("folder", F.lit("/Joined Video.ts"))).alias("path"))


def read_chapters(chapters: DataFrame) -> DataFrame:
    """rec_id, place, at: chapter starts in seconds from (rec_id, start, num, den), in order; those below 0 or without a time are left out."""
    from pyspark.sql import Window as W

    at = (F.col("start") * F.col("num")).cast("double") / F.col("den")
    rows = chapters.where("start IS NOT NULL AND num <> 0 AND den <> 0").select("rec_id", at.alias("at")).where("at >= 0")
    return rows.select("rec_id", (F.row_number().over(W.partitionBy("rec_id").orderBy("at")) - 1).cast("long").alias("place"), "at")


def cut_list_keeps(lines: DataFrame, index: DataFrame, rate: float) -> DataFrame:
    """rec_id, start_f, end_f: the frames that cut lists (name, place, line; the name is the recording's id) leave.

    Cuts are mapped to the frames nearest in time, one that begins at or before 0 to the first.
    """
    from ..operators import frames, intervals

    cuts = read_cut_list(lines).select(F.col("name").cast("long").alias("rec_id"), F.monotonically_increasing_id().alias("id"), "a", "b")
    ends = index.groupBy("rec_id").agg(F.min("pts").alias("start"), F.count("*").alias("n"))
    ask = cuts.join(ends, "rec_id")
    tick = lambda c: F.col("start") + F.bround(F.greatest(F.lit(0.0), F.col(c)) * rate).cast("long")
    # the cut's two ends are looked up under one number: twice the cut's, and that and one
    asked = ask.select("rec_id", "id", F.explode(F.array(F.struct(F.lit(0).alias("side"), tick("a").alias("q")), F.struct(F.lit(1).alias("side"), tick("b").alias("q")))).alias("x"))
    found = frames.nearest(index, asked.select("rec_id", (F.col("id") * 2 + F.col("x.side")).alias("id"), F.col("x.q").alias("q")))
    both = found.groupBy("rec_id", F.floor(F.col("id") / 2).alias("id")).agg(F.min("frame_no").alias("start_f"), F.max("frame_no").alias("end_f"))
    return intervals.complement(both.select("rec_id", "start_f", "end_f"), ends.select("rec_id", "n"), overflow=True)


def document_format(name: Column) -> Column:
    """Which reader a project file takes, by its extension in any case: ``project`` (JSON), ``ticks`` (XML), ``cuts`` (text), ``scenes``."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return F.when(ext == "swproj", "project").when(ext == "edl", "cuts").when(ext == "vjr", "scenes").otherwise("ticks")


def read_any(documents: DataFrame, recordings: DataFrame) -> DataFrame:
    """name, a, b (seconds) of project files (name, document) in any format that holds cuts.

    JSON documents are read against recordings (name, frames, fps).
    """
    told = documents.withColumn("format", document_format(F.col("name")))
    of = lambda f: told.where(F.col("format") == f).select("name", "document")
    lines = of("cuts").select("name", F.posexplode(F.split("document", "\n")).alias("place", "line"))
    texts = read_cut_list(lines).select("name", "a", "b")
    frames = read_project(of("project"), recordings).join(recordings.select("name", "fps"), "name").select("name", (F.col("start_frame") / F.col("fps")).alias("a"), (F.col("end_frame") / F.col("fps")).alias("b"))
    return texts.unionByName(frames).unionByName(read_ticks(of("ticks")))


def write_any(cuts: DataFrame, fps: float) -> DataFrame:
    """name, document for cuts (name, a, b in seconds) in the format of each name's extension."""
    told = cuts.withColumn("format", document_format(F.col("name")))
    of = lambda f: told.where(F.col("format") == f)
    line = F.struct("a", "b", F.format_string("%.2f\t%.2f\t0", F.greatest(F.lit(0.0), F.col("a")), F.greatest(F.lit(0.0), F.col("b"))).alias("x"))
    texts = of("cuts").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda c: c["x"]), "\n").alias("document"))
    frame = lambda c: F.bround(F.col(c) * fps).cast("long")
    projects = write_project(of("project").select("name", frame("a").alias("start_frame"), frame("b").alias("end_frame"), F.lit(None).cast("long").alias("frames")), fps)
    return texts.unionByName(projects).unionByName(write_ticks(of("ticks").select("name", "a", "b")))
