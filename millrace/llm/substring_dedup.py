"""Removal of repeated word sequences by seed and extend.

Seeds: the word k-grams of a text are winnowed, so that every window of `length` words has one anchor, the least
k-gram hash in it, which depends on the window's words alone: equal windows meet at equal anchors.  Join: only
anchors that stand twice or more are looked at again.  Extend: an anchor with l words before it and length - k - l
after it is one of its extensions; those of which it is the anchor are its block, and the words that they reach to
the left and to the right are all that matter.  Blocks that stand twice are repeats whole.  Where the blocks of an
anchor differ, the match ends somewhere inside: one of each differing block is extended, every split to both sides at
once, and the extensions that stand elsewhere too are matches of `length` words.  Adjacent matches join to the maximal
repeats.  Extensions meet by hash, whatever their number: no pair of occurrences is ever listed.

Edge cases: null texts have no words; texts shorter than the window keep everything; rows that repeat are copies of
each other; very long texts are hashed in slices of whole texts and stay one row; columns beside doc_id and text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, concat_slices, mix64, powers, stored, string_bytes, table, words_of

LENGTH = 35
SEED_WORDS = 12
#: Bytes of text that are hashed at a time.
SLICE = 4_000_000
_BACK = np.uint64(pow(int(BASE), -1, 2**64))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row names the pair of doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("row"), "doc_id", text.alias("text"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    _, offsets = string_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Windows:
    """The windows of the words of some texts, and the hash of any run of words."""

    def __init__(self, texts: pa.Array, length: int):
        self.hashes, self.doc, *_ = words_of(texts)
        n = len(self.hashes)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * powers(BASE, n), out=self.sums[1:])
        self.back = powers(_BACK, n + 1)
        starts = np.arange(max(0, n - length + 1))
        self.starts = starts[self.doc[starts] == self.doc[starts + length - 1]] if len(starts) else starts

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def blocks(self, length: int, k: int):
        """(anchor's k-gram hash, first window, number of windows, place of the anchor) of each block."""
        s = self.starts
        if not len(s):
            return np.zeros(0, np.uint64), s, s, s
        n = len(self.hashes) - k + 1
        grams = self.runs(np.arange(n), np.arange(n) + k)
        view = np.lib.stride_tricks.sliding_window_view(grams, length - k + 1)
        owner = s + np.concatenate([view[s[i : i + 65536]].argmin(axis=1) for i in range(0, len(s), 65536)])
        turn = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (self.doc[s[1:]] != self.doc[s[:-1]])]))
        count = np.diff(np.concatenate([turn, [len(s)]]))
        return grams[owner[turn]], s[turn], count, owner[turn]


def anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, block, row, first, n) of each block: its content's hash, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                w = Windows(texts, length)
                seed, begin, count, owner = w.blocks(length, k)
                with np.errstate(over="ignore"):
                    block = mix64(w.runs(begin, begin + count - 1 + length) ^ mix64((count * 64 + owner - begin).astype(np.uint64)))
                docs = w.doc[begin] if len(begin) else begin
                row = batch.column(0).to_numpy(zero_copy_only=False)[at + docs]
                columns = [pa.array(seed.view(np.int64)), pa.array(block.view(np.int64)), pa.array(row, pa.int64()), pa.array(begin - w.first[docs], pa.int32()), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "block", "row", "first", "n"])

    return rows.select("row", "text").mapInArrow(run, "anchor long, block long, row long, first int, n int")


def _extensions(chosen: DataFrame, length: int) -> DataFrame:
    """(row, doc_id, text, ranges) -> (window, row, first, lone): the hash and first word of each extension of the ranges' anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for at, texts in _slices(batch.column(2)):
                w, part = Windows(texts, length), lists.slice(at, len(texts))
                flat = part.flatten()
                first, n, lone = (np.asarray(flat.field(i)) for i in range(3))
                owner = np.repeat(np.arange(len(texts)), np.asarray(part.value_lengths()))
                begin = concat_slices(w.first[owner] + first, n.astype(np.int64))
                docs = np.repeat(owner, n)
                row = batch.column(0).to_numpy(zero_copy_only=False)[at + docs]
                hashes = w.runs(begin, begin + length)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(row, pa.int64()), pa.array(begin - w.first[docs], pa.int32()), pa.array(np.repeat(lone, n))], ["window", "row", "first", "lone"])

    return chosen.mapInArrow(run, "window long, row long, first int, lone boolean")


def repeated_windows(rows: DataFrame, length: int = LENGTH, k: int = SEED_WORDS) -> DataFrame:
    """(row, first, n): runs of windows of `length` words whose words also start anywhere else."""
    # stored, so that texts are hashed once, and a join has plain shuffles on both sides and a hot anchor's rows can be split
    every = stored(anchors(rows, length, k), "anchors")
    twice = stored(every.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    met = stored(every.join(twice, "anchor", "left_semi"), "met-anchors")
    one = F.min(F.struct("row", "first", "n"))
    blocks = met.groupBy("anchor", "block").agg(F.count("*").alias("copies"), one.alias("one"))
    blocks = stored(blocks, "blocks")
    whole = met.join(blocks.where("copies > 1").select("anchor", "block"), ["anchor", "block"], "left_semi").select("row", "first", "n")
    differ = stored(blocks.groupBy("anchor").count().where("count > 1").select("anchor"), "differ")
    edges = blocks.join(differ, "anchor", "left_semi").select("one.*", (F.col("copies") == 1).alias("lone"))
    ranges = edges.groupBy("row").agg(F.collect_list(F.struct("first", "n", "lone")).alias("ranges"))
    windows = _extensions(rows.join(ranges, "row").select("row", "doc_id", "text", "ranges"), length)
    windows = stored(windows, "windows")
    again = stored(windows.groupBy("window").count().where("count > 1").select("window"), "again")
    parts = windows.where("lone").join(again, "window", "left_semi").select("row", "first", F.lit(1).alias("n"))
    return whole.union(parts)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, kept): the maximal repeats as runs of words, and the words that are left, by one space."""
    rows = keyed(docs)
    ranges = repeated_windows(rows, length, k).groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    return rows.join(ranges, "row", "left").select("doc_id", "text", "ranges").transform(_remove, length)


def _remove(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [_cut(t.as_py(), r, length) for t, r in zip(part.column(1).cast(pa.binary()), part.column(2), strict=True)]
                counts, spans, kept = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<start:int,stop:int>>, kept string")


def _cut(text: bytes, ranges: pa.ListScalar, length: int) -> tuple[int, list[dict], bytes]:
    words = text.split()
    if not ranges.is_valid:
        return len(words), [], b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    first, n = (np.asarray(ranges.values.field(i)) for i in range(2))
    np.add.at(cover, first, 1)
    np.add.at(cover, first + n - 1 + length, -1)
    gone = np.cumsum(cover) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
    pieces, upto = [], 0
    spans = [{"start": int(s), "stop": int(e)} for s, e in zip(turns[0::2], turns[1::2], strict=True)]
    for s in spans:
        pieces += words[upto : s["start"]]
        upto = s["stop"]
    return len(words), spans, b" ".join(pieces + words[upto:])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twins AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY md5(g)) AS n FROM grams) WHERE n > 1),
gone AS (SELECT rid, list(DISTINCT j) AS js FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM twins) GROUP BY rid),
flat AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
cut AS (SELECT DISTINCT rid, unnest(js) AS j FROM gone),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY j) AS s FROM flat ANTI JOIN cut USING (rid, j) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
