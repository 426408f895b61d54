"""URL filter: all rules as one bit-parallel wildcard automaton over canonical URLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, and every path that starts with its own.
SITE_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: (verdict, glob over ``.host/path``) for URLs that no site rule fits: ``*`` stays within the host or a path's
#: segment, ``**`` crosses ``/``, ``?`` is one byte (a letter beyond ASCII has several).  The first that fits decides.
GLOB_RULES = (
    ("block", "*.ads-track.*/**"),
    ("block", "*.ads-track.*"),
    ("block", "*.adserver.*/**"),
    ("block", "**/wp-login.php"),
)
DEFAULT = "allow"
_SLASH = 0x2F


class GlobAutomaton:
    """Shift-And over all globs at once.

    Every glob has a bit for each of its prefixes, packed one after another into 64-bit words.  Reading a byte shifts all
    bits by one, keeps those whose token is that byte, and keeps in place those that a wildcard holds.
    """

    def __init__(self, globs: Sequence[str]):
        tokens, starts, ends, hold, hold_segment = [], [], [], [], []
        for glob in globs:
            starts.append(len(tokens))
            tokens.append(None)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    hold.append(len(tokens) - 1)
                    i += 2
                elif raw[i : i + 1] == b"*":
                    hold_segment.append(len(tokens) - 1)
                    i += 1
                else:
                    tokens.append(raw[i])
                    i += 1
            ends.append(len(tokens) - 1)
        self.width = max(1, -(-len(tokens) // 64))
        table = np.zeros((256, len(tokens)), dtype=bool)
        for bit, token in enumerate(tokens):
            if token == 0x3F:
                table[:, bit] = True
            elif token is not None:
                table[token, bit] = True
        stay = np.zeros((256, len(tokens)), dtype=bool)
        stay[:, hold + hold_segment] = True
        stay[_SLASH, [x for x in hold_segment if x not in hold]] = False
        begin = np.zeros((1, len(tokens)), dtype=bool)
        begin[0, starts] = True
        self.step, self.stay, self.begin, self.ends = self._pack(table), self._pack(stay), self._pack(begin)[0], ends

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.width * 64), dtype=bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def matches(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: which URL each glob fits as a whole."""
        length = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-length, kind="stable")
        raw, begin = np.frombuffer(b"".join(urls), np.uint8), np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        state = np.repeat(self.begin[None, :], len(urls), axis=0)
        begin, length = begin[order], length[order]
        for i in range(int(length[0]) if len(urls) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))
            byte, now = raw[begin[:n] + i], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(urls), len(self.ends)), dtype=bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def site_globs(host: str, path: str) -> str:
    """The glob over ``.host/path`` of a site rule."""
    quoted = host.lower() + path
    if "*" in quoted or "?" in quoted:
        raise ValueError(f"a site rule has no wildcards: {quoted}")
    return f"*.{quoted}**"


def filter_urls(pages: DataFrame, site_rules=SITE_RULES, glob_rules=GLOB_RULES, default: str = DEFAULT) -> DataFrame:
    """Judges each row of ``pages`` (page_id, url; other columns are ignored).

    Returns page_id, host, path, rule, verdict, matched_by.  Host and path are as written in the URL, with A-Z of the host
    in lower case; both are empty for a URL that is null, empty or without ``://``, which no rule fits.  The longest site
    rule that fits decides (of equally long ones the first given); else the first glob rule; else ``default``.  Repeated
    rows are judged alike; an empty table gives an empty result.  Very long URLs are read to their end, one byte a step, for
    as many rows of the batch as still have one.
    """
    site_rules, glob_rules = list(site_rules), list(glob_rules)
    ranked = sorted(range(len(site_rules)), key=lambda k: -len(site_rules[k][1] + site_rules[k][2]))
    globs = [site_globs(*site_rules[k][1:]) for k in ranked] + [g for _, g in glob_rules]
    verdicts = [site_rules[k][0] for k in ranked] + [v for v, _ in glob_rules]
    names = [site_rules[k][1] + site_rules[k][2] for k in ranked] + [None] * len(glob_rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = GlobAutomaton(globs)
        for b in batches:
            host, path = b.column("host").to_pylist(), b.column("path").to_pylist()
            fits = machine.matches([f".{h}{p}".encode() if h else b"" for h, p in zip(host, path, strict=True)])
            found = fits.any(axis=1) if globs else np.zeros(len(host), bool)
            first = fits.argmax(axis=1) if globs else np.zeros(len(host), int)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"), b.column("host"), b.column("path"),
                    pa.array([names[k] if f else None for f, k in zip(found, first, strict=True)], pa.string()),
                    pa.array([verdicts[k] if f else default for f, k in zip(found, first, strict=True)], pa.string()),
                    pa.array([globs[k] if f else None for f, k in zip(found, first, strict=True)], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "matched_by"],
            )

    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    parts = pages.select("page_id", rest.alias("rest"))
    host = F.translate(F.substring_index("rest", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)")
    return parts.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, matched_by string")
