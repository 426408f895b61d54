"""Byte-level BPE by longest matches: a trie over Latin-1 (pyahocorasick) and backtracking on token compatibility."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct pre-tokens, and stretches of text, whose ids a task remembers.
REMEMBERED = 300_000


class BytePairEncoder:
    """Exact merges of a rank table in linear time.

    Tokens are held as Latin-1 strings, one character a byte, in a trie.  From each position the longest token is tried
    first; it stands if it may follow the token before it, which is so if merging the two tokens' bytes from scratch
    would keep them apart.  Else the next shorter prefix token is tried; where none is left, the token before is taken
    back.  A bit for each position says whether it can still lead to an encoding.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.id_of = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.text_of = {v: str(v) for v in self.bytes_of}
        self.name = {v: k for k, v in self.id_of.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.id_of.items():
            if len(token) > 1 and (halves := self._split(token, rank)):
                self.halves[rank] = halves
        self.joined = {halves: rank for rank, halves in self.halves.items()}
        self.made = {token: rank for token, rank in self.id_of.items() if len(token) == 1 or rank in self.halves}
        self.trie, self.longest = ahocorasick.Automaton(), max(map(len, self.made), default=0)
        for token, rank in self.made.items():
            self.trie.add_word(token, rank)
        self.apart = lru_cache(maxsize=1 << 20)(self._apart)
        self.shorter = lru_cache(maxsize=1 << 17)(self._shorter)
        self.words = _Memo(self.encode_word)

    def _split(self, token: str, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last to make ``token``; None if no merges make it."""
        parts, ids = list(token), self.id_of
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ids.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def _apart(self, left: int, right: int) -> bool:
        """Whether merges leave a border between the two tokens standing.

        Undoing the merges of either side in the order of their ranks shows whether a pair across the border would have
        been merged before the tokens were complete.
        """
        limit, halves, joined = float("inf"), self.halves, self.joined
        while True:
            across = joined.get((left, right))
            if across is not None and across < limit:
                return False
            if left in halves and (left > right or right not in halves):
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]  # of equal ranks the one further left merges first
            else:
                return True

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        name = self.name[rank]
        n = self.trie.longest_prefix(name[:-1])
        while n:
            found = self.made.get(name[:n])
            if found is not None:
                return found
            n -= 1
        return None

    def _longest(self, text: str, at: int) -> int:
        n = self.trie.longest_prefix(text[at : at + self.longest])
        while True:
            found = self.made.get(text[at : at + n])
            if found is not None:
                return found
            n -= 1

    def encode_word(self, word: str) -> tuple[int, ...]:
        text = word.encode().decode("latin-1")
        found = self.id_of.get(text)
        if found is not None:
            return (found,)
        n = len(text)
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        token: int | None = self._longest(text, 0)
        name, apart = self.name, self.apart
        while True:
            while True:
                end = at + len(name[token])
                if open_[end] and (not out or apart(out[-1], token)):
                    out.append(token)
                    at = end
                    token = self._longest(text, at) if at < n else None
                    break
                token_shorter = self.shorter(token)
                if token_shorter is not None:
                    token = token_shorter
                    continue
                open_[at] = 0
                token = out.pop()
                at -= len(name[token])
                break
            if token is None:
                return tuple(out)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """Remembers results for short strings, a bounded number of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> tuple[int, ...]:
        out = self.make(text)
        if len(text) <= 64 and len(self) < REMEMBERED:  # the common ones come first
            self[text] = out
        return out


#: Texts with these are matched as a whole: they are white space to ``re`` and not to the patterns.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: A pre-token has white space only at its start or throughout, so one always ends where white space follows a character.
_STRETCH = re.compile(r"\s*\S+|\s+")


class TextEncoder:
    """Encodes whole texts: ``pattern`` cuts pre-tokens, each of which is encoded on its own.

    The pattern's pre-tokens must hold white space only at their start or throughout, as those of the byte-level
    tokenizers do; then each stretch of white space and the characters behind it can be looked up as one.
    """

    def __init__(self, bpe: BytePairEncoder, pattern: str):
        import regex

        self.bpe, self.find = bpe, regex.compile(pattern).findall
        self.stretches = _Memo(self._whole)

    def _whole(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.bpe.words.__getitem__, self.find(text))))

    def encode(self, text: str) -> list[int]:
        if _SEPARATORS.search(text):
            return list(self._whole(text))
        return list(chain.from_iterable(map(self.stretches.__getitem__, _STRETCH.findall(text))))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line; the file is installed on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = r"(?s).+") -> TextEncoder:
    """The encoder for a rank file, made once in each Python worker."""
    return TextEncoder(BytePairEncoder(read_ranks(path)), pattern)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Ids of each whole text of ``docs`` (doc_id, text; other columns are ignored): doc_id, ids array<int>.

    Null and empty texts have no ids; very long ones are taken whole.  Repeated rows give equal rows, an empty table an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode
        for b in batches:
            ids = [encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def detokenize(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Bytes of each row's ids (doc_id, ids; other columns are ignored): doc_id, decoded.

    Null and empty ids give no bytes.  Repeated rows give equal rows, an empty table an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path).bpe
        for b in batches:
            out = [bpe.decode(ids or ()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null text counts as empty: no tokens, and the digests of nothing.  Repeated rows give equal rows, an empty table an
    empty result; very long texts are taken whole.  Memory holds one
    Arrow batch, the ids of one text and the remembered pre-tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(ranks_path, pattern)
        encode, bpe = texts.encode, texts.bpe
        sha, text_of = hashlib.sha256, bpe.text_of.__getitem__
        for b in batches:
            n, first, second = [], [], []
            for t in b.column("text"):
                ids = encode(t.as_py() or "")
                n.append(len(ids))
                first.append(sha(" ".join(map(text_of, ids)).encode()).hexdigest())
                second.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
