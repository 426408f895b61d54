"""Boolean trigram queries that a regular expression's matches satisfy."""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser as parser

#: Conjunctions of trigrams, one of which holds of every text with a match; a conjunction without trigrams says nothing.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])
#: Different strings that a stretch of an expression is spelt out into, conjunctions of a query, characters of a class.
MOST_STRINGS, MOST_CONJUNCTIONS, MOST_CHARACTERS = 64, 64, 4


def _simplified(conjunctions) -> Query:
    """Without the conjunctions that others are part of."""
    all_ = set(conjunctions)
    return frozenset(c for c in all_ if not any(d < c for d in all_))


def _either(queries) -> Query:
    out = _simplified(c for q in queries for c in q)
    return out if len(out) <= MOST_CONJUNCTIONS else ALWAYS


def _both(a: Query, b: Query) -> Query:
    out = _simplified(x | y for x, y in product(a, b))
    return out if len(out) <= MOST_CONJUNCTIONS else a if a != ALWAYS else b


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _spelt(strings: set[str]) -> Query:
    return _either([frozenset([_grams(s)]) for s in strings])


def _characters(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 2 * MOST_CHARACTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS else None


def _read(node) -> tuple[set[str] | None, Query]:
    """(all strings that the node matches, if they are few; what holds of texts with a match of it)."""
    op, value = node
    if op is K.LITERAL:
        return {chr(value).lower()}, ALWAYS
    if op is K.IN:
        return _characters(value), ALWAYS
    if op is K.AT:
        return {""}, ALWAYS
    if op is K.SUBPATTERN:
        return _sequence(value[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(all_ := set().union(*[s for s, _ in parts])) <= MOST_STRINGS:
            return all_, ALWAYS
        return None, _either([q if s is None else _spelt(s) for s, q in parts])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, item = value
        strings, query = _sequence(item)
        if strings is not None and most == 1:
            return strings | ({""} if not least else set()), ALWAYS
        if strings is not None and least == most and len(strings) == 1:
            return {next(iter(strings)) * least}, ALWAYS
        return None, ALWAYS if not least else query if strings is None else _spelt({s * min(least, 3) for s in strings} if len(strings) == 1 else strings)
    return None, ALWAYS


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    whole, query, strings = True, ALWAYS, {""}
    for node in nodes:
        more, own = _read(node)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
            continue
        whole = False
        query = _both(_both(query, _spelt(strings)), own)
        strings = {""} if more is None else more
    return (strings, query) if whole else (None, _both(query, _spelt(strings)))


def query(pattern: str) -> Query:
    """The trigram query of ``pattern``, over texts in lower case.

    Every text with a match holds all trigrams of one conjunction (not the other way round).  ``ALWAYS``, a query whose only
    conjunction is empty, stands for patterns without mandatory trigrams.
    """
    strings, out = _sequence(parser.parse(pattern))
    return out if strings is None else _spelt(strings)
