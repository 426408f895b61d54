import random
import re

import pytest

from seqspan.llm import urlrules
from seqspan.llm.urlrules import GlobAutomaton


def as_regex(glob):
    out = ""
    for part in re.split(r"(\*\*|\*|\?)", glob):
        out += {"**": ".*", "*": "[^/]*", "?": "."}.get(part, re.escape(part))
    return re.compile(out, re.S)


def test_automaton_matches_like_regular_expressions():
    random.seed(2)
    letters = "ab/."
    globs = ["".join(random.choice(["a", "b", "/", "*", "**", "?", ".", "ab"]) for _ in range(random.randint(0, 9))) for _ in range(60)]
    urls = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(400)]
    fits = GlobAutomaton(globs).matches([u.encode() for u in urls])
    assert GlobAutomaton(globs).width > 1
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            assert fits[i, k] == bool(as_regex(g).fullmatch(u)), (u, g)


def test_no_urls_and_no_globs():
    assert GlobAutomaton(["a"]).matches([]).shape == (0, 1)
    assert GlobAutomaton([]).matches([b"a"]).shape == (1, 0)


CASES = [
    ("https://A.example.com/en/7x?y=/en/8", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://example.com/en/8#z", "example.com", "/en/8", "com/en/", "block"),
    ("x://com/en/", "com", "/en/", "com/en/", "block"),
    ("x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("x://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
    ("x://a.example.net/de/7", "a.example.net", "/de/7", "net/de/", "allow"),
    ("x://a.org/x.com/en/", "a.org", "/x.com/en/", None, "allow"),
    ("x://a.com:80/en/", "a.com:80", "/en/", None, "allow"),
    ("x://m.ads-track.example.de/q", "m.ads-track.example.de", "/q", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a?b://c.com/en/", "c.com", "/en/", "com/en/", "block"),
    ("x://ÄB.com", "Äb.com", "", None, "allow"),
]


def test_pages(spark):
    rows = [(i, u, "x", "y") for i, (u, *_) in enumerate(CASES)] + [(None, "x://b.org/es/1", "x", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    out = urlrules.filter_urls(pages).collect()
    told = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    for i, (_, *want) in enumerate(CASES):
        assert told[i] == tuple(want)
    assert told[None] == ("b.org", "/es/1", "org/es/", "block")
    assert urlrules.filter_urls(pages.limit(0)).collect() == []


def test_site_rules_hold_no_wildcards():
    with pytest.raises(ValueError):
        urlrules.site_globs("*.com", "/")
