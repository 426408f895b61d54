"""File names of episodes: parsing, rendering, comparing."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the forms in which names carry a season and episodes, and years
SEASON_EPISODE = r"[Ss](\d{1,2})[\s._-]*[Ee](\d{1,3})((?:[._-]*[Ee]\d{1,3}|[\s._&,+-]*[Ss]\d{1,2}[\s._-]*[Ee]\d{1,3})+)?"
SEASON_X_EPISODE = r"(?<![A-Za-z0-9])(\d{1,2})[xX](\d{1,3})((?:[xX-]\d{1,3})+)?"
YEAR = r"(?:^|[\s._\-(\[])(19\d{2}|20\d{2})(?:[\s._\-)\]]|$)"
PART_MARKER = r"(?i)\s*(?:[(\[]\s*(?:\d{1,2}|[IVX]{1,4}|one|two|three|four)\s*[)\]]|[-,:]?\s*(?:part|pt\.?)\s*(?:\d{1,2}|[IVX]{1,4}|one|two|three|four))\s*$"
ILLEGAL = r'[\\/:*?"<>|]'
CODES = ("TMDBID", "NY", "SZ", "EZ", "N", "Y", "S", "E", "T")


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[._]+", " "), r"\s+", " "), "^[ -]+|[ -]+$", "")


def _before(text: Column, pattern: str) -> Column:
    """What stands before the first match; the whole text without one."""
    return F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)


def _rising(first: Column, others: Column) -> Column:
    """The first episode and those that follow it in rising order; the first that doesn't rise ends them."""
    start = F.struct(F.array(first).alias("got"), F.lit(True).alias("on"))

    def step(state: Column, x: Column) -> Column:
        on = state["on"] & (x > F.element_at(state["got"], -1))
        return F.struct(F.when(on, F.concat(state["got"], F.array(x))).otherwise(state["got"]).alias("got"), on.alias("on"))

    return F.aggregate(others, start, step, lambda s: s["got"])


def parse(path: Column) -> Column:
    """struct<show, season, episodes, year, ext, matched> of a file name; no season, no episodes where it has no tag."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    dotted = base.contains(".")
    stem = F.when(dotted, F.regexp_extract(base, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(base)
    ext = F.when(dotted, F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))).otherwise(F.lit(""))
    one, two = stem.rlike(SEASON_EPISODE), stem.rlike(SEASON_X_EPISODE)

    def group(i: int) -> Column:
        return F.when(one, F.regexp_extract(stem, SEASON_EPISODE, i)).when(two, F.regexp_extract(stem, SEASON_X_EPISODE, i))

    extra = F.coalesce(group(3), F.lit(""))
    marked, bare = F.regexp_extract_all(extra, F.lit(r"[Ee](\d{1,3})"), 1), F.regexp_extract_all(extra, F.lit(r"(\d{1,3})"), 1)
    numbers = F.transform(F.when(extra.rlike(r"[Ee]\d"), marked).otherwise(bare), lambda x: x.cast("int"))
    matched = one | two
    head = F.when(one, _before(stem, SEASON_EPISODE)).when(two, _before(stem, SEASON_X_EPISODE)).otherwise(stem)
    year = F.regexp_extract(head, YEAR, 1)
    named = F.when((year != "") & (_before(head, YEAR) != ""), _before(head, YEAR)).otherwise(head)
    # a year right at the start leaves the text as it is
    show = F.when(matched | (_tidy(named) != ""), _tidy(named)).otherwise(_tidy(stem))
    return F.struct(
        show.alias("show"), F.when(matched, group(1).cast("int")).alias("season"),
        F.when(matched, _rising(group(2).cast("int"), numbers)).otherwise(F.array().cast("array<int>")).alias("episodes"),
        F.when(year != "", year.cast("int")).alias("year"), ext.alias("ext"), matched.alias("matched"),
    )


def safe(name: Column) -> Column:
    """Usable as one part of a path: illegal characters become spaces, and no dot or space is last."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(name, ILLEGAL, " "), r"\s+", " "))
    return F.regexp_replace(spaced, "[. ]+$", "")


def _value(code: str, meta: Mapping[str, Column]) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    season, year, episodes = meta["season"], meta["year"], meta["episodes"]
    run = lambda form: F.array_join(F.transform(F.coalesce(episodes, F.array().cast("array<int>")), lambda e: F.format_string(form, e)), "-")
    out = {
        "N": text(meta["name"]),
        "NY": F.when(year.isNotNull() & (year != 0), F.concat(text(meta["name"]), F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(text(meta["name"])),
        "Y": F.when(year != 0, year.cast("string")).otherwise(F.lit("")),
        "S": text(season.cast("string")),
        "SZ": text(F.when(season.isNotNull(), F.format_string("%02d", season))),
        "E": run("%d"),
        "EZ": run("%02d"),
        "T": text(meta["title"]),
        "TMDBID": text(F.when(meta["id"] != 0, meta["id"].cast("string"))),
    }[code]
    return F.regexp_replace(text(out), r"[\\/]", " ")


def render_path(pattern: str, meta: Mapping[str, Column]) -> Column:
    """A relative path from a pattern with codes; ``meta`` has name, year, season, episodes, title and id.

    The pattern's own slashes divide folders; parts that come out empty go.  The season's folder of season 0 is ``Specials``.
    """
    segments, out = pattern.split("/"), []
    for i, segment in enumerate(segments):
        pieces = [_value(p[1:], meta) if p[0] == "%" and p[1:] in CODES else F.lit(p) for p in re.split(f"(%(?:{'|'.join(CODES)}))", segment) if p]
        part = safe(F.concat(*pieces)) if pieces else F.lit("")
        if i < len(segments) - 1 and "%S" in segment:
            part = F.when(meta["season"] == 0, F.lit("Specials")).otherwise(part)
        out.append(part)
    return F.array_join(F.filter(F.array(*out), lambda p: p != ""), "/")


def without_part_marker(title: Column) -> Column:
    """A title without a part marker at its end; one that is nothing else stays."""
    cut = F.trim(F.regexp_replace(title, PART_MARKER, ""))
    return F.when(cut == "", title).otherwise(cut)


def combined_title(titles: Column) -> Column:
    """Titles without their part markers, each once, in order, joined by an ampersand."""
    return F.array_join(F.array_distinct(F.filter(F.transform(titles, without_part_marker), lambda t: t != "")), " & ")


def show_key(name: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def version(text: Column) -> Column:
    """The first two or three numbers joined by dots, array<int>, a third of 0 if there are two; null where there are none.

    What comes behind them doesn't count, so a candidate for a release isn't newer than the release.
    """
    found = lambda i: F.regexp_extract(text, r"(\d+)\.(\d+)(?:\.(\d+))?", i)
    numbers = F.array(found(1).try_cast("int"), found(2).try_cast("int"), F.coalesce(found(3).try_cast("int"), F.lit(0)))
    return F.when(found(1) != "", numbers)


def is_newer(latest: Column, current: Column) -> Column:
    """Whether a version is higher than another; not so where either is none."""
    return F.coalesce(version(latest) > version(current), F.lit(False))


def with_modifier(base: Column, modifier: Column) -> Column:
    """The base name with a modifier: behind it if it begins with ``-`` or ``_``, else in front."""
    m = F.trim(F.coalesce(modifier, F.lit("")))
    return F.when(m.rlike("^[-_]"), F.concat(base, m)).otherwise(F.concat(m, base))
