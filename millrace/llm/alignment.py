"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which tokens are linked there.

Token ends of a batch of texts are bits in two packed bitsets, one bit a byte.  Their AND holds the shared cuts; the
number of set bits up to a cut (popcounts of whole 64-bit words, summed beforehand, and one masked word) is the number
of tokens up to it, so a cut of bytes becomes a range of tokens on either side without any search.  Tokens have one
byte at least, so no two of a side end together and every cut links one token of each side.

Two linked tokens end at the same byte, so the shorter is an end of the longer.  All pairs that any corpus can link
therefore follow from the vocabularies alone (some hundred thousand): that is the proven bound of the table of counts,
which is summed by Spark and then sent to every task.

Edge cases: a null or empty text, and a text whose joined token bytes are not space + text on both sides (one with
U+2581, which the second vocabulary writes for a space), has no tokens, no groups and zeros; repeated rows count each
for itself, in the counts of pairs too; texts of any length are taken whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import concat_slices, stored, table
from .tokens import _byte_letters

BYTES, PIECES = "byte_bpe_50k", "piece_bpe_32k.model"
#: Code points that a task encodes together; a longer text goes alone.
TOGETHER = 1 << 20
#: Words that a worker remembers, and an eighth of their tokens, before it starts anew.
REMEMBERED = 500_000
#: A run of white space on which the faster library's pattern may run out of stack.
_CUT, _ODD = re.compile(r"(?<=\S) "), re.compile(r"[^\S ] ")
_LONG_SPACE = re.compile(r"\s{2000}")


@dataclass(frozen=True)
class Side:
    """A vocabulary: the bytes of each id, their number, and the decimal digits of the ids (zero-padded at the end)."""

    names: list[bytes]
    size: np.ndarray
    digits: np.ndarray


def _side(names: list[bytes]) -> Side:
    digits = np.array([str(i).encode() for i in range(len(names))], "S")
    return Side(names, np.array([len(n) for n in names], np.int64), digits.view(np.uint8).reshape(len(names), -1))


class Numbered(dict):
    """The number of each word, given when it is first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Lists:
    """Lists of numbers, one after another in a column that grows."""

    def __init__(self) -> None:
        self.values, self.n = np.zeros(1 << 10, np.int32), 0
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        counts = np.array([len(x) for x in lists], np.int64)
        to = self.n + int(counts.sum())
        if to > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(2 * to - self.n, np.int32)])
        self.values[self.n : to] = np.fromiter(chain.from_iterable(lists), np.int32, to - self.n)
        self.starts = np.concatenate([self.starts, self.n + np.cumsum(counts) - counts])
        self.counts, self.n = np.concatenate([self.counts, counts]), to

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.values[concat_slices(self.starts[at], self.counts[at])]


def _words(text: str) -> list[str]:
    """A text cut at, and without, each space that follows a visible character."""
    if not text:
        return []
    return _CUT.split(text) if text[0] == " " or "  " in text or _ODD.search(text) else text.split(" ")


class Pair:
    """The two vocabularies, their encoders, and every pair of ids that can be linked."""

    def __init__(self, a: str, b: str):
        with open(public_tokenizers.path(f"{a}.json"), encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        known = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a = _side([known.get(i, special.get(i, b"?")) for i in range(max(known | special) + 1)])
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.whole.encode_special_tokens = True
        with open(public_tokenizers.path(f"{a}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        if ranks != {t: i for i, t in known.items()}:
            raise ValueError(f"{a}: the two files hold different vocabularies")
        self.ranks = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        n, self.space = self.pieces.get_piece_size(), self.pieces.piece_to_id("▁")
        texts = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b = _side([bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)])
        #: Sorted a * n + b of all pairs of which one's bytes end the other's.
        self.keys = np.unique(np.concatenate([self._ends(self.a, self.b, lambda x, y: x * n + y), self._ends(self.b, self.a, lambda x, y: y * n + x)]))
        if any(re.search(r"[^▁]▁", t) for t in texts):
            raise ValueError(f"{b}: a piece runs into a space, so texts can't be cut at spaces")
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.held_a, self.held_b = Lists(), Lists()
        self.bytes, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def _ends(long: Side, short: Side, key) -> np.ndarray:
        ids: dict[bytes, list[int]] = {}
        for i, name in enumerate(short.names):
            ids.setdefault(name, []).append(i)
        return np.array([key(x, y) for x, name in enumerate(long.names) for at in range(len(name)) for y in ids.get(name[at:], ())], np.int64)

    def _encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space + word by the first vocabulary, and of word by the second, which adds the space."""
        spaced = [" " + w for w in words]
        odd = [len(w) > 2000 and _LONG_SPACE.search(w) is not None for w in spaced]
        a = [self.whole.encode(w, add_special_tokens=False).ids if slow else self.ranks.encode_ordinary(w) for w, slow in zip(spaced, odd, strict=True)]
        return a, [x if w else [self.space] for w, x in zip(words, self.pieces.encode(words, num_threads=1), strict=True)]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, ...]:
        """(ids of both sides, their numbers for each text, its bytes); all of them none for a text that a side does not spell.

        Neither vocabulary has a token that runs from a visible character into a space, so the words between such
        places are encoded once each and remembered, up to a bound.
        """
        parts = [_words(t) for t in texts]
        if self.known and (len(self.known) > REMEMBERED or max(self.held_a.n, self.held_b.n) > 8 * REMEMBERED):
            self._forget()
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        if new := self.known.taken():
            a, b = self._encode(new)
            spelt = [" " + w for w in new]
            good = [b"".join(map(self.a.names.__getitem__, x)) == b"".join(map(self.b.names.__getitem__, y)) == w.encode() for w, x, y in zip(spelt, a, b, strict=True)]
            self.held_a.add(a)
            self.held_b.add(b)
            self.bytes = np.concatenate([self.bytes, [len(w.encode()) for w in spelt]])
            self.good = np.concatenate([self.good, good])
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.good[at]]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        n = lambda sizes: np.bincount(doc, sizes[at], len(texts)).astype(np.int64)
        return self.held_a.take(at), self.held_b.take(at), n(self.held_a.counts), n(self.held_b.counts), n(self.bytes)


@lru_cache(maxsize=2)
def pair_of(a: str = BYTES, b: str = PIECES) -> Pair:
    return Pair(a, b)


class Bitset:
    """Bits in 64-bit words with the number of set bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bitset:
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set up to and at each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def select(self) -> np.ndarray:
        """The places of all set bits: words without any are passed over."""
        held = np.flatnonzero(self.words)
        at, bit = np.nonzero(np.unpackbits(self.words[held].view(np.uint8), bitorder="little").reshape(len(held), 64))
        return held[at] * 64 + bit


@dataclass(frozen=True)
class Aligned:
    """Texts whose tokens are aligned: all ids, the text of each cut, and the tokens up to and with each cut."""

    a: np.ndarray
    b: np.ndarray
    doc: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def align(pair: Pair, texts: Sequence[str]) -> Aligned:
    """The tokens and shared cuts of some texts; a text that either side does not spell has none."""
    a, b, n_a, n_b, sizes = pair.encode(texts)
    n = int(sizes.sum())
    ends_a, ends_b = (Bitset.of(np.cumsum(side.size[x]) - 1, n) for side, x in ((pair.a, a), (pair.b, b)))
    cuts = (ends_a & ends_b).select()
    doc = np.searchsorted(np.cumsum(sizes), cuts, side="right")
    return Aligned(a, b, doc, ends_a.rank(cuts), ends_b.rank(cuts), n_a, n_b)


def links(pair: Pair, x: Aligned) -> np.ndarray:
    """The place in pair.keys of each link: the tokens that end at a cut."""
    return np.searchsorted(pair.keys, x.a[x.a_to - 1].astype(np.int64) * len(pair.b.names) + x.b[x.b_to - 1]).astype(np.int32)


def group_texts(pair: Pair, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their end for each text) of 'a1,a2|b1;a3|b2,b3': a row of digits and a mark for each token, zeros dropped."""
    n, groups = len(x.a) + len(x.b), len(x.doc)
    a_group, b_group = (np.repeat(np.arange(groups), np.diff(to, prepend=0)) for to in (x.a_to, x.b_to))
    a_at, b_at = np.arange(len(x.a)) + np.concatenate([[0], x.b_to])[a_group], np.arange(len(x.b)) + x.a_to[b_group]
    width = max(pair.a.digits.shape[1], pair.b.digits.shape[1])
    out = np.zeros((n, width + 1), np.uint8)
    out[a_at, : pair.a.digits.shape[1]] = pair.a.digits[x.a]
    out[b_at, : pair.b.digits.shape[1]] = pair.b.digits[x.b]
    out[:, width] = ord(",")
    out[a_at[x.a_to - 1], width] = ord("|")
    last = np.ones(groups, bool)
    last[:-1] = x.doc[1:] != x.doc[:-1]
    out[b_at[x.b_to - 1], width] = np.where(last, 0, ord(";"))
    sizes = np.concatenate([[0], np.cumsum(np.count_nonzero(out, axis=1))])
    return out[out != 0], sizes[np.cumsum(x.n_a + x.n_b)]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > TOGETHER:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _aligned(docs: DataFrame, a: str, b: str, columns: dict, make) -> DataFrame:
    """doc_id and the columns that make(pair, texts, aligned) gives, for batches of rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in _batches(texts):
                part = [t or "" for t in texts[at:to]]
                made = make(pair, align(pair, part))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], *(pa.array(v, t) for v, t in zip(made, columns.values(), strict=True))], ["doc_id", *columns])

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    types = [f"{c} {names.get(t) or 'array<int>'}" for c, t in columns.items()]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {', '.join(types)}")


def _cut(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def token_groups(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """(doc_id, a, b, a_to, b_to) per row: the ids of both sides, and for each group the tokens up to its end."""
    listed = pa.list_(pa.int32())

    def make(pair: Pair, x: Aligned) -> list:
        groups = np.bincount(x.doc, minlength=len(x.n_a))
        first_a, first_b = (np.cumsum(n) - n for n in (x.n_a, x.n_b))
        return [_cut(v, n) for v, n in ((x.a, x.n_a), (x.b, x.n_b), (x.a_to - first_a[x.doc], groups), (x.b_to - first_b[x.doc], groups))]

    return _aligned(docs, a, b, dict.fromkeys(("a", "b", "a_to", "b_to"), listed), make)


def digests(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links): links holds the pair of each link, four bytes each."""
    counts = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())

    def make(pair: Pair, x: Aligned) -> list:
        groups = np.bincount(x.doc, minlength=len(x.n_a))
        said, to = group_texts(pair, x)
        view, begin = memoryview(said.tobytes()), 0
        hashes = []
        for n, end in zip(x.n_a, to, strict=True):
            hashes.append(hashlib.sha256(view[begin:end]).hexdigest() if n else "")
            begin = end
        return [x.n_a, x.n_b, groups, groups, hashes, [v.tobytes() for v in _cut(links(pair, x), groups)]]

    return _aligned(docs, a, b, {**counts, "groups_sha256": pa.string(), "links": pa.binary()}, make)


def pair_counts(digested: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """(pair, n): the links of the whole corpus that hold a pair; each task sums its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pair_of(a, b).keys), np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                np.add.at(n, np.frombuffer(held, np.int32), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["pair", "n"])

    return digested.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(digested: DataFrame, counts: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """digested with n_best and count_sum in place of links.

    The counts of all pairs, at most as many as pair_of(a, b).keys, pass the driver and go to every task.
    """
    pair = pair_of(a, b)
    found = counts.toArrow()
    n = np.zeros(len(pair.keys), np.int64)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    most = np.zeros(len(pair.b.names), np.int64)
    second = pair.keys % len(pair.b.names)
    np.maximum.at(most, second, n)
    sent = digested.sparkSession.sparkContext.broadcast((n, n == most[second]))
    names = [c for c in digested.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = sent.value
        for batch in batches:
            held = [np.frombuffer(x, np.int32) for x in batch.column(len(names)).to_pylist()]
            made = [pa.array([int(v[x].sum()) for x in held], pa.int64()) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, "n_best", "count_sum"])

    kinds = [f"{c} {digested.schema[c].dataType.simpleString()}" for c in names]
    return digested.select(*names, "links").mapInArrow(run, ", ".join([*kinds, "n_best long", "count_sum long"]))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    digested = stored(digests(table(spark, sf_dir, "documents")), "alignment")
    return with_counts(digested, pair_counts(digested))
