"""Token counts at every prefix, by dynamic programming over a byte-pair vocabulary.

For a piece of text that the tokenizer splits off, the encoding of each prefix is that of a shorter prefix plus
one last token, and the last token is the one that may follow the shorter prefix's last token: encoding the two
alone gives them back.  So one pass over a piece gives the exact count of all its prefixes.  Pieces are joined to
segments at whose ends the counts of what went before are final, and a document's counts are stored as the change
of the count at each code point (one signed byte each).  Truncation and budget questions read the stored changes;
nothing is encoded again.

Edge cases: a null text counts as empty (no tokens, no changes); repeated rows count each for itself; the
tokenizer's special strings count as one token, as its library does by default; segments of any length go through
the same pass; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 1_000_000

# The contractions of the public split pattern.
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
UNIT = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: White space and the unit after it, or the white space at the end.
SEGMENT = regex.compile(rf"(?:\s*[^\S ])?{CONTRACTION}|\s*(?:{UNIT})|\s+")
_MARKS = frozenset(".,;:!?")
_BLANK = regex.compile(r"\s*")
#: White space (the Unicode property) and what follows up to the next: whole segments, found by the faster library.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of tokens at every prefix, for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.names = {i: t for t, i in self.tokens.items()} | {-1: b""}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.tokens))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding of a few bytes, merge by merge."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.rank
        while len(parts) > 1:
            least, at = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: int, token: int) -> bool:
        if len(self.follows) > REMEMBERED:
            self.follows.clear()
        a, b = self.names[before], self.names[token]
        # two tokens that merge are never neighbours in an encoding
        ok = self.follows[before << 32 | token] = (a, b) not in self.rank and self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def piece(self, data: bytes) -> list[int]:
        """The number of tokens of each byte prefix of a piece (from the empty one on)."""
        counts, last, follows, tokens, longest = [0], [-1], self.follows, self.tokens.get, self.longest
        for i in range(1, len(data) + 1):
            for s in range(i - longest if i > longest else 0, i):
                token = tokens(data[s:i])
                if token is not None:
                    before = last[s]
                    ok = follows.get(before << 32 | token)
                    if ok or ok is None and self._may_follow(before, token):
                        break
            counts.append(counts[s] + 1)
            last.append(token)
        return counts

    def _piece(self, text: str) -> list[int]:
        """As piece, at code points only."""
        data = text.encode("utf-8", "surrogatepass")
        counts = self.piece(data)
        return counts if len(data) == len(text) else [c for c, b in zip(counts, [*data, 0], strict=True) if b & 0xC0 != 0x80]

    def segment(self, text: str) -> bytes:
        """The change of the count at each code point of a segment."""
        blank = _BLANK.match(text).end()
        if blank == len(text) or blank == 0 and text[0] != "'":
            counts = self._piece(text)
        elif blank <= 1 and text[0] == " ":
            counts = self._piece(text)
        else:
            run = self._piece(text[:blank]) if blank else [0]
            glued = blank > 0 and text[blank - 1] == " "
            if glued:
                base, rest, tail = run[blank - 1], text[blank - 1 :], None
            else:
                base = run[blank - 1] + self._piece(text[blank - 1 : blank])[-1] if blank else 0
                rest, tail = text[blank:], None
            if not glued and regex.fullmatch(CONTRACTION, rest):
                mark, letters = self._piece("'")[-1], self._piece(rest[1:])
                tail = [mark, *(mark + c for c in letters[1:-1]), self._piece(rest)[-1]]
            else:
                tail = self._piece(rest)[2 if glued else 1 :]
            counts = [*run, *(base + c for c in tail)]
        return self._remember(text, bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)]))

    def _remember(self, text: str, change: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = change
        return change

    def _chunk(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isalpha():  # letters alone are one segment
            return self.segment(text)
        known, make = self.known.get, self.segment
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return self._remember(text, (known(text[:-1]) or make(text[:-1])) + (known(word[-1]) or make(word[-1])))
        return self._remember(text, b"".join([known(s) or make(s) for s in SEGMENT.findall(text)]))

    def _plain(self, text: str) -> bytes:
        known, make = self.known.get, self._chunk
        return b"".join([known(s) or make(s) for s in _CHUNK.findall(text)])

    def changes(self, text: str) -> bytes:
        """The change of the token count at each code point of a text, as signed bytes."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at, count = [], 0, 0
        for m in self.special.finditer(text):
            before, reached = self._plain(text[at : m.start()]), self._plain(text[at : m.end() - 1])
            ended = int(np.frombuffer(before, np.int8).sum(dtype=np.int64))
            inside = int(np.frombuffer(reached, np.int8).sum(dtype=np.int64))
            out += [reached, np.int8(ended + 1 - inside).tobytes()]
            at, count = m.end(), count + ended + 1
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(public_tokenizers.path(vocabulary))


def prefix_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, changes) per row: changes holds the change of the count at each code point."""
    out = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("changes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                changes = [count.changes(t) for t in texts]
                sizes = [len(t.encode()) for t in texts]
                totals = [int(np.frombuffer(c, np.int8).sum(dtype=np.int64)) for c in changes]
                columns = [pa.array(c, f.type) for c, f in zip((sizes, totals, changes), out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *out.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, changes binary")


def tokens_within(changes: Column, code_points: Column) -> Column:
    """The exact number of tokens of the text's first code_points code points."""

    @F.pandas_udf("long")
    def at(stored: pd.Series, upto: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(c, np.int8)[: max(0, n)].sum(dtype=np.int64)) for c, n in zip(stored, upto, strict=True)])

    return at(changes, code_points)


def longest_within(changes: Column, budget: Column) -> Column:
    """The code points of the longest prefix of at most `budget` tokens."""

    @F.pandas_udf("long")
    def at(stored: pd.Series, most: pd.Series) -> pd.Series:
        def longest(c: bytes, n: int) -> int:
            fits = np.flatnonzero(np.concatenate([[0], np.cumsum(np.frombuffer(c, np.int8), dtype=np.int64)]) <= n)
            return int(fits[-1]) if len(fits) else 0

        return pd.Series([longest(c, n) for c, n in zip(stored, most, strict=True)])

    return at(changes, budget)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
