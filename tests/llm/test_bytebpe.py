import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from seqspan.llm import bytebpe  # noqa: E402

PATH = str(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def pair():
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})
    return bytebpe.encoder(PATH, tokenizers.PATTERN), own


def test_same_ids_as_the_library(pair):
    mine, own = pair
    random.seed(4)
    letters = "abcdefghijklmnopqrstuvwxyzABC éßñ漢字🙂\n\t\r\x1c\x1f\x85\u00a0\u2028 0123456789'.,-_!"
    names = [t for t in mine.bpe.bytes_of.values()]
    for k in range(4000):
        if k % 3 == 0:
            text = b"".join(random.choice(names) for _ in range(random.randint(1, 8))).decode("utf-8", "ignore")
        elif k % 3 == 1:
            text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        else:
            text = random.choice("aeiou-= \n") * random.randint(1, 400) + random.choice(["", "x", " the"])
        ids = mine.encode(text)
        assert ids == own.encode_ordinary(text)
        assert mine.bpe.decode(ids) == text.encode()


def test_white_space_of_both_regular_expression_kinds():
    import re

    import regex

    for code in range(0x11000):
        if 0xD800 <= code < 0xE000:
            continue
        one = bool(re.fullmatch(r"\s", chr(code)))
        assert one == bool(regex.fullmatch(r"\s", chr(code))) or 0x1C <= code <= 0x1F


def test_tokens_that_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abc": 258}
    bpe = bytebpe.BytePairEncoder(ranks)
    own = tiktoken.Encoding("o", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for word in ("xyz", "xyzx", "abc", "aabcc", "xabcxyz", "ababab"):
        assert list(bpe.encode_word(word)) == own.encode_ordinary(word)


def test_whole_texts(spark, docs_of, pair):
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "<|endoftext|>"), (4, "wörd " * 30_000)]
    out = bytebpe.digests(docs_of(rows), PATH, tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        ids = pair[1].encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.ids_sha256 for r in out if r.doc_id in (1, 2)} == {empty}
    again = bytebpe.detokenize(bytebpe.tokenize(docs_of(rows), PATH, tokenizers.PATTERN), PATH).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in again} == {(i, (t or "").encode()) for i, t in rows}
    assert bytebpe.digests(docs_of(rows).limit(0), PATH, tokenizers.PATTERN).collect() == []
