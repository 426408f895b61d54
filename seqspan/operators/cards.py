"""Cards and markers at the edges of breaks: learning them, breaks they bound by themselves, edges they place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import written
from .segments import in_spans
from .walks import by_group


@dataclass(frozen=True)
class CardRules:
    """Bounds for cards, times in the unit of the tables."""

    run: int  # a sighting this long opens or closes a break
    shortest: int
    longest: int
    least: int  # no break shrinks below this
    reach: int
    shrink: int
    snap: int
    spread: float


def card_breaks(sightings: DataFrame, breaks: DataFrame, rules: CardRules, width: int) -> DataFrame:
    """rec_id, a, b: breaks that open and close with a card, where there is none yet.

    ``sightings`` has rec_id, id, t0, t1, start_off, start_spread, end_off, end_spread (what is known of its card; null where
    it isn't).  Sightings that are long enough and steady at both sides count.  One opens a break if others end at a break's
    distance behind it; the last of them closes it, and the next break opens behind that.  Edges are the sightings less the
    card's usual offsets; a break that overlaps one of ``breaks`` (rec_id, a, b) is left out.
    """
    steady = (F.coalesce("start_spread", F.lit(99.0)) <= rules.spread) & (F.coalesce("end_spread", F.lit(99.0)) <= rules.spread)
    order = W.partitionBy("rec_id").orderBy("t0", "t1", "id")
    edge = sightings.where(steady & (F.col("t1") - F.col("t0") >= rules.run)).withColumn("n", F.row_number().over(order).cast("long"))
    opens = edge.select("rec_id", F.col("n").alias("k"), (F.col("t0") + rules.shortest).alias("s"), (F.col("t0") + rules.longest).alias("e"))
    met = in_spans(edge.select("rec_id", "n", "t1", "end_off"), opens, "t1", width, closed=True).where("n > k")
    last = met.groupBy("rec_id", F.col("k").alias("n")).agg(F.max(F.struct("t1", (-F.col("n")).alias("m"), "end_off")).alias("x"))
    rows = edge.join(last, ["rec_id", "n"]).select("rec_id", "n", (F.col("t0") - F.col("start_off")).alias("a"), (F.col("x.t1") - F.col("x.end_off")).alias("b"), (-F.col("x.m")).alias("until"))

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        free = 0
        for n, a, b, until in part:
            if n >= free:
                free = until + 1
                yield key[0], n, a, b

    found = by_group(rows, ["rec_id"], ["n"], walk, "rec_id long, n long, a long, b long")
    from .breaks import without_overlap

    named = found.select("rec_id", F.col("n").alias("id"), F.col("a").alias("lo"), F.col("b").alias("hi"))
    left = without_overlap(named, breaks.select("rec_id", F.col("a").alias("c"), F.col("b").alias("d")), 0.0, width)
    return left.select("rec_id", F.col("lo").alias("a"), F.col("hi").alias("b"))


def _snapped(edges: DataFrame, scenes: DataFrame, reach: int, width: int) -> DataFrame:
    """Adds ``snapped``: the scene change (rec_id, t) nearest to ``at`` within ``reach``, the earlier of two, else ``at``."""
    spans = edges.select("rec_id", F.col("id").alias("k"), (F.col("at") - reach).alias("s"), (F.col("at") + reach).alias("e"), "at")
    near = in_spans(scenes.select("rec_id", "t"), spans.select("rec_id", "k", "s", "e"), "t", width, closed=True).select("rec_id", F.col("k").alias("id"), "t")
    best = near.join(edges.select("rec_id", "id", "at"), ["rec_id", "id"]).groupBy("rec_id", "id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("at")).alias("d"), "t"))["t"].alias("t"))
    return edges.join(best, ["rec_id", "id"], "left").withColumn("snapped", F.coalesce("t", "at")).drop("t")


def card_edges(breaks: DataFrame, sightings: DataFrame, scenes: DataFrame, rules: CardRules, width: int) -> DataFrame:
    """rec_id, a, b, moved: breaks with their edges where the channel's card puts them.

    A start goes by the earliest sighting that begins close to it, an end by the latest that ends close to it, if the card is
    steady at that side: less the card's usual offset, on the scene change next to that.  An edge doesn't move inwards by
    more than ``shrink``, nor so that a break gets too short or runs into the one before, as that is now, or the one behind,
    as that was; ``moved`` counts the edges that did.
    """
    numbered = breaks.withColumn("id", F.row_number().over(W.partitionBy("rec_id").orderBy("a", "b")).cast("long"))

    def side(edge: str, at: str, off: str, spread: str, first: bool) -> DataFrame:
        spans = numbered.select("rec_id", F.col("id").alias("k"), (F.col(edge) - rules.reach).alias("s"), (F.col(edge) + rules.reach).alias("e"))
        known = sightings.where(F.coalesce(spread, F.lit(99.0)) <= rules.spread).select("rec_id", F.col(at).alias("t"), F.col(off).alias("off"), F.col("id").alias("sighting"))
        met = in_spans(known, spans, "t", width, closed=True)
        key = F.struct((F.col("t") if first else -F.col("t")).alias("o"), "sighting", "t", "off")
        best = met.groupBy("rec_id", F.col("k").alias("id")).agg(F.min(key).alias("x")).select("rec_id", "id", (F.col("x.t") - F.col("x.off")).alias("at"))
        return _snapped(best, scenes, rules.snap, width).select("rec_id", "id", F.col("snapped").alias("new_" + edge))

    rows = numbered.join(side("a", "t0", "start_off", "start_spread", True), ["rec_id", "id"], "left").join(side("b", "t1", "end_off", "end_spread", False), ["rec_id", "id"], "left")
    following = F.lead("a").over(W.partitionBy("rec_id").orderBy("id"))
    rows = rows.withColumn("following", following).select("rec_id", "id", "a", "b", F.coalesce("new_a", "a").alias("new_a"), F.coalesce("new_b", "b").alias("new_b"), "following")

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        before = 0
        for _, a, b, new_a, new_b, following in part:
            new_a = a if new_a - a > rules.shrink else new_a
            new_b = b if b - new_b > rules.shrink else new_b
            if new_a < before or new_b - new_a < rules.least:
                new_a = a
            if (following is not None and new_b > following) or new_b - new_a < rules.least:
                new_b = b
            before = new_b
            yield key[0], new_a, new_b, (new_a != a) + (new_b != b)

    return by_group(rows, ["rec_id"], ["id"], walk, "rec_id long, a long, b long, moved long")


def added_cards(cards: DataFrame, new: DataFrame, below: float, keep: int = 4) -> DataFrame:
    """key, order, fp: each key's cards after a new one (key, order, fp): those close to it make way, and the ``keep`` newest stay."""
    from .learn import mean_l1, newest

    close = cards.join(new.select("key", F.col("fp").alias("other")), "key").where(mean_l1(F.col("fp"), F.col("other")) < below).select("key", "order").distinct()
    return newest(cards.join(close, ["key", "order"], "left_anti").unionByName(new.select(*cards.columns)), ["key"], keep)


def onsets(frames: DataFrame, dark: float, same: float, most: int) -> DataFrame:
    """rec_id, place, i, offset: the first frames of runs of alike ones at a place by an edge.

    ``frames`` has rec_id, place, i, offset, fp (array) and known (the programme shows it too).  Dark frames and known ones
    are no onsets, and what comes behind them is compared with nothing; a frame close to the last one kept is the same one
    again.  At most ``most`` of a place are kept, the first.
    """

    def walk(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        last: Sequence[float] | None = None
        kept = 0
        for i, offset, fp, known in part:
            if kept >= most:
                return
            if known or sum(fp) / len(fp) < dark:
                last = None
                continue
            if last is not None and sum(abs(x - y) for x, y in zip(fp, last, strict=True)) / len(fp) < same:
                continue
            last = fp
            kept += 1
            yield key[0], key[1], i, offset

    rows = frames.where("fp IS NOT NULL AND size(fp) > 0").select("rec_id", "place", "i", "offset", "fp", "known")
    return by_group(rows, ["rec_id", "place"], ["i"], walk, "rec_id long, place long, i long, offset double")


@dataclass(frozen=True)
class MarkerRules:
    """Bounds for programme markers, times in the unit of the tables."""

    search: int
    snap: int
    run_gap: int
    cost: float


def _first_seen(seen: DataFrame, gap: int) -> DataFrame:
    """rec_id, side, t: the first of instants (rec_id, side, t; repeats count once) that follow each other within ``gap``."""
    w = W.partitionBy("rec_id", "side").orderBy("t")
    apart = F.col("t") - F.lag("t").over(w)
    marked = seen.select("rec_id", "side", "t").distinct().withColumn("apart", apart)
    return marked.where(F.col("apart").isNull() | (F.col("apart") > gap)).drop("apart")


def predicted_edges(hits: DataFrame, today: DataFrame, events: DataFrame, rules: MarkerRules, width: int) -> DataFrame:
    """rec_id, side, edge, predicted: where markers put a programme's edge (rec_id, side, today).

    ``hits`` are frames that look like markers: rec_id, side, t, project, offset (of the marker's onset from its own
    project's edge), one row a marker.  Hits close together are one sighting; its onset less the median over the projects of
    their least offset predicts an edge.  The prediction nearest to today's edge counts if it is within ``search``, and goes
    to the event (rec_id, t, score) within ``snap`` that is worth most, its score less ``cost`` a unit of distance.
    """
    first = _first_seen(hits, rules.run_gap)
    least = hits.join(first, ["rec_id", "side", "t"]).groupBy("rec_id", "side", "t", "project").agg(F.min("offset").alias("offset"))
    return _predicted(least.groupBy("rec_id", "side", "t").agg(F.median("offset").alias("usual")), today, events, rules, width)


def _predicted(sightings: DataFrame, today: DataFrame, events: DataFrame, rules: MarkerRules, width: int) -> DataFrame:
    """:func:`predicted_edges` of sightings (rec_id, side, t, usual)."""
    told = sightings.withColumn("at", F.col("t") - F.col("usual"))
    off = F.abs(F.col("at") - F.col("today"))
    near = told.join(today, ["rec_id", "side"]).where(off <= rules.search).groupBy("rec_id", "side").agg(F.min(F.struct(off.alias("d"), "t", "at"))["at"].alias("predicted"))
    spans = near.select("rec_id", F.col("side").alias("k"), (F.col("predicted") - rules.snap).alias("s"), (F.col("predicted") + rules.snap).alias("e"))
    close = in_spans(events, spans, "t", width, closed=True).select("rec_id", F.col("k").alias("side"), "t", "score").join(near, ["rec_id", "side"])
    worth = F.round(F.col("score") - F.abs(F.col("t") - F.col("predicted")) * rules.cost, 9)
    best = close.groupBy("rec_id", "side").agg(F.min(F.struct((-worth).alias("w"), "t"))["t"].alias("t"))
    return near.join(best, ["rec_id", "side"], "left").select("rec_id", "side", F.coalesce(F.col("t").cast("double"), "predicted").alias("edge"), "predicted")


def programme_edges(breaks: DataFrame, ends: DataFrame) -> DataFrame:
    """rec_id, side, today: where the lead-in ends (side 0) and the tail begins (side 1), as :func:`placed_edges` tells them.

    Recordings whose lead-in is their tail have neither.
    """
    met = breaks.join(ends, "rec_id")
    order = F.struct("a", "b")
    lead = F.max(F.when(F.col("a") <= F.col("head_reach"), F.struct("b", (-F.col("a")).alias("m"))))
    told = met.groupBy("rec_id", "duration", "tail_reach").agg(lead.alias("lead"), F.max(order).alias("last"))
    tail = F.when(F.col("duration") - F.col("last.b") <= F.col("tail_reach"), F.col("last"))
    told = told.withColumn("tail", tail).where("NOT coalesce(lead.b = tail.b AND -lead.m = tail.a, false)")
    sides = F.array(F.struct(F.lit(0).cast("long").alias("side"), F.col("lead.b").alias("today")), F.struct(F.lit(1).cast("long").alias("side"), F.col("tail.a").alias("today")))
    return told.select("rec_id", F.explode(sides).alias("x")).select("rec_id", "x.side", "x.today").where("today IS NOT NULL")


def usual_offsets(frames: DataFrame, markers: DataFrame, today: DataFrame, below: float, reach: int, gap: int, width: int) -> DataFrame:
    """rec_id, side, t, usual: where frames (rec_id, t, fp) near today's edges begin to look like remembered markers.

    ``markers`` has side, project (a recording's rec_id), offset and fp.  Of a recording's frames those within ``reach`` of an
    edge are matched, with the markers of that side; a recording's own markers are never used.  Frames that look like any and
    follow each other within ``gap`` are one sighting; ``usual`` is the median over the projects of the least offset of the
    markers that its first frame looks like.

    Frames and markers don't meet in pairs: fingerprints that are equal are compared once, the least offsets of the projects
    that a fingerprint reaches are ranked once, and a frame looks its median up by rank, its own project's offset left out.
    Only instants with several fingerprints are joined with all that these reach.
    """
    from .learn import sightings

    spans = today.select("rec_id", F.col("side").alias("k"), (F.col("today") - reach).alias("s"), (F.col("today") + reach).alias("e"))
    near = in_spans(frames, spans, "t", width, closed=True).where("fp IS NOT NULL").select("rec_id", F.col("k").alias("side"), "t", "fp")
    near = written(near, "near")
    numbered = lambda rows, name: written(rows.select("fp").distinct().withColumn(name, F.monotonically_increasing_id()), name)
    prints, kinds = numbered(near, "id"), numbered(markers.where("fp IS NOT NULL"), "card")
    alike = sightings(prints, kinds.select("card", F.col("fp").alias("card_fp")), below).select("id", "card")
    remembered = markers.select("side", "project", "offset", "fp").join(kinds, "fp").drop("fp")
    least = alike.join(remembered, "card").groupBy("id", "side", "project").agg(F.min("offset").alias("offset"))
    place = F.row_number().over(W.partitionBy("id", "side").orderBy(F.asc_nulls_last("offset"), "project"))
    ranked = written(least.withColumn("rank", place), "ranked")
    of = F.struct("project")
    reached = ranked.groupBy("id", "side").agg(F.count("offset").alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi"))
    seen = near.join(prints, "fp").select("rec_id", "side", "t", "id").distinct().join(reached, ["id", "side"])
    seen = written(seen.where("NOT (lo.project <=> rec_id AND hi.project <=> rec_id)").select("rec_id", "side", "t", "id", "n"), "seen")
    at = ["rec_id", "side", "t"]
    first = seen.join(_first_seen(seen, gap), at).withColumn("prints", F.count("*").over(W.partitionBy(*at)))
    own = ranked.where("offset IS NOT NULL").select("id", "side", F.col("project").alias("rec_id"), F.col("rank").alias("own"))
    one = first.where("prints = 1").join(own, ["id", "side", "rec_id"], "left").withColumn("others", F.col("n") - F.when(F.col("own").isNull(), 0).otherwise(1))
    middle = one.where("others > 0").withColumn("rank", F.explode(F.array(F.expr("(others - 1) div 2 + 1"), F.expr("others div 2 + 1"))))
    middle = middle.withColumn("rank", F.col("rank") + F.when(F.col("rank") >= F.col("own"), 1).otherwise(0))
    told = middle.join(ranked.select("id", "side", "rank", "offset"), ["id", "side", "rank"]).groupBy(*at).agg(F.avg(F.col("offset").cast("double")).alias("usual"))
    many = first.where("prints > 1").select(*at, "id").join(ranked, ["id", "side"]).where("NOT project <=> rec_id")
    many = many.groupBy(*at, "project").agg(F.min("offset").alias("offset")).groupBy(*at).agg(F.median("offset").alias("usual"))
    return told.unionByName(many)


def with_markers(breaks: DataFrame, frames: DataFrame, markers: DataFrame, events: DataFrame, ends: DataFrame, rules: MarkerRules, below: float, reach: int, width: int) -> DataFrame:
    """rec_id, a, b: breaks whose lead-in and tail end where remembered markers say, from the frames themselves."""
    breaks = written(breaks.select("rec_id", "a", "b"), "breaks")
    today = written(programme_edges(breaks, ends), "today")
    seen = written(usual_offsets(frames, markers, today, below, reach, rules.run_gap, width), "sightings")
    return placed_edges(breaks, _predicted(seen, today, events, rules, width), ends)


def with_cards(breaks: DataFrame, sightings: DataFrame, scenes: DataFrame, rules: CardRules, width: int) -> DataFrame:
    """rec_id, a, b: breaks and those that cards alone open and close, all with their edges where cards put them."""
    breaks = written(breaks.select("rec_id", "a", "b"), "breaks")
    added = card_breaks(sightings, breaks, rules, width)
    every = written(breaks.unionByName(added), "breaks")
    return card_edges(every, sightings, scenes, rules, width).select("rec_id", "a", "b")


def placed_edges(breaks: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """rec_id, a, b: breaks whose lead-in ends, and whose tail begins, where markers say (``edges``: rec_id, side, edge).

    ``ends`` has rec_id, duration, head_reach and tail_reach: the lead-in is the break that begins within the one and ends
    last, the tail the last break if it ends within the other of the end.  Where both are one break nothing changes, nor
    does an edge that would cross a neighbour.  Side 0 is the programme's start, 1 its end.
    """
    w = W.partitionBy("rec_id").orderBy("a", "b")
    rows = breaks.join(ends, "rec_id").withColumns({"n": F.row_number().over(w), "behind": F.lead("a").over(w), "ahead": F.lag("b").over(w)})
    all_ = W.partitionBy("rec_id")
    lead = F.max(F.when(F.col("a") <= F.col("head_reach"), F.struct("b", (-F.col("n")).alias("m")))).over(all_)
    last = F.max("n").over(all_)
    rows = rows.withColumn("head", -lead["m"]).withColumn("last", last)
    rows = rows.withColumn("tail", F.max(F.when((F.col("n") == F.col("last")) & (F.col("duration") - F.col("b") <= F.col("tail_reach")), F.col("n"))).over(all_))
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col("edge"))).alias(name)
    rows = rows.join(edges.groupBy("rec_id").agg(of(0, "start"), of(1, "finish")), "rec_id", "left")
    apart = ~F.col("head").eqNullSafe(F.col("tail"))
    # the start is moved first, and the tail's neighbour is then as it has become
    to_start = apart & (F.col("n") == F.col("head")) & (F.col("start") > F.col("a")) & (F.col("start") < F.coalesce("behind", "duration"))
    rows = rows.withColumn("new_b", F.when(to_start, F.col("start")).otherwise(F.col("b").cast("double")))
    limit = F.coalesce(F.lag("new_b").over(w), F.lit(0.0))
    to_end = apart & (F.col("n") == F.col("tail")) & (F.col("finish") > limit) & (F.col("finish") < F.col("b"))
    return rows.withColumn("new_a", F.when(to_end, F.col("finish")).otherwise(F.col("a").cast("double"))).select("rec_id", F.col("new_a").alias("a"), F.col("new_b").alias("b"))


@dataclass(frozen=True)
class EdgeCardRules:
    """Bounds for learning a card, times in the unit of the tables."""

    window: int  # how far inside an edge a card may lie
    margin: int  # how far outside of cuts the programme begins
    reach: int  # how far outside an edge a sighting still counts
    padding: int  # cuts so near the recording's ends aren't breaks
    step: int  # from one frame to the next
    match: float
    clear: float
    least: int = 3


def learned_cards(frames: DataFrame, cuts: DataFrame, gate: DataFrame, ends: DataFrame, rules: EdgeCardRules, width: int) -> tuple[DataFrame, DataFrame]:
    """(rec_id, fp, matched, edges, clearance; rec_id, side, offset, spread, n): the card of each corrected recording that has one.

    ``frames`` has rec_id, i, t, fp; ``cuts`` rec_id, a, b; ``gate`` rec_id, reason (only ``ok`` ones are learned from), ``ends``
    rec_id, duration.  Of the frames just inside the edges of the breaks in the middle, the one that has an alike frame at most
    edges, and the closest of equals, gives the card: the mean of those alike frames.  It counts if they are half of the
    edges, and ``least`` at least, and the programme never comes within ``clear`` of it.  Where it lies next to starts and
    ends is told by median and range.
    """
    good = gate.where("reason = 'ok'").select("rec_id")
    cuts = cuts.join(good, "rec_id", "left_semi")
    middle = cuts.join(ends, "rec_id").where((F.col("a") > rules.padding) & (F.col("b") < F.col("duration") - rules.padding))
    middle = middle.join(middle.groupBy("rec_id").count().where("count >= 2").select("rec_id"), "rec_id", "left_semi")
    # tables of cuts and cards are small and read by several steps: each is written once
    middle = middle.select("rec_id", F.row_number().over(W.partitionBy("rec_id").orderBy("a", "b")).cast("long").alias("k"), "a", "b")
    middle = written(middle, "middle")
    span = lambda side, s, e: middle.select("rec_id", (F.col("k") * 2 + side).alias("k"), s.alias("s"), e.alias("e"))
    a, b = F.col("a"), F.col("b")
    near = in_spans(frames, span(0, a, a + rules.window).unionByName(span(1, b - rules.window, b)), "t", width).select("rec_id", "k", "i", "fp")
    edges = middle.groupBy("rec_id").agg((F.count("*") * 2).alias("edges"))

    def pick(key: tuple, part: Iterator[tuple]) -> Iterator[tuple]:
        import numpy as np

        # the frames at one recording's edges: a few for each of its breaks
        own = list(part)
        edge, fps = np.array([r[0] for r in own]), np.array([r[2] for r in own], float)
        bounds = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
        best = None
        for probe in fps:
            far = np.abs(fps - probe).mean(axis=1)
            low = np.minimum.reduceat(far, bounds)
            hit = low < rules.match
            score = (int(hit.sum()), -float(low[hit].sum()))
            if best is None or score > best[0]:
                ends_ = np.append(bounds[1:], len(fps))
                best = score, [s + int(np.argmin(far[s:e])) for s, e, ok in zip(bounds, ends_, hit, strict=True) if ok]
        if best and best[1]:
            yield key[0], best[0][0], [float(x) for x in fps[best[1]].mean(axis=0)]

    cards = by_group(near, ["rec_id"], ["k", "i"], pick, "rec_id long, matched long, fp array<double>").join(edges, "rec_id")
    cards = cards.where(F.col("matched") >= F.greatest(F.lit(rules.least), F.floor(F.col("edges") / 2)))
    cards = written(cards, "cards")
    from .learn import mean_l1, offsets

    known = frames.join(cards.select("rec_id", F.col("fp").alias("card")), "rec_id").withColumn("d", mean_l1(F.col("fp"), F.col("card"))).select("rec_id", "i", "t", "d")
    known = written(known, "known")
    cut = cuts.select("rec_id", F.xxhash64("a", "b").alias("k"), (a - rules.margin).alias("s"), (b + rules.margin).alias("e"))
    inside = in_spans(known, cut, "t", width, closed=True).select("rec_id", "i").distinct()
    clearance = known.join(inside, ["rec_id", "i"], "left_anti").groupBy("rec_id").agg(F.min("d").alias("clearance"))
    cards = cards.join(clearance, "rec_id", "left").where(F.coalesce(F.col("clearance") > rules.clear, F.lit(True)))
    cards = written(cards, "cards")
    seen = known.where(F.col("d") < rules.match).join(cards.select("rec_id"), "rec_id", "left_semi")
    at = in_spans(seen, span(0, a - rules.reach, a + rules.window).unionByName(span(1, b - rules.window, b + rules.reach)), "t", width)
    firsts = at.groupBy("rec_id", "k").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("j", F.floor(F.col("k") / 2))
    told = firsts.join(middle.withColumnRenamed("k", "j"), ["rec_id", "j"]).withColumn("side", F.when(F.col("k") % 2 == 0, "start").otherwise("end"))
    value = F.when(F.col("side") == "start", F.col("lo") - a).otherwise(F.col("hi") + rules.step - b)
    places = offsets(told.select(F.struct("rec_id", "side").alias("key"), value.alias("value"))).select("key.rec_id", "key.side", "offset", "spread", "n")
    return cards.select("rec_id", "fp", "matched", "edges", F.round("clearance", 6).alias("clearance")), places
