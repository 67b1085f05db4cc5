"""Log-likelihood of whole documents under a gated recurrent language model learned from the corpus.

The corpus is read once into chunks of about CHUNK_BYTES of text: the documents' tokens as indexes into the
chunk's own words.  Training counts are rows (word, chunk, count); a window over the word adds them up for all the
chunks that hold it, and a word of one chunk needs no answer.  The most frequent words are the model's symbols; every
other word is one of FALLBACKS symbols (by its last bytes), and its share of that symbol is its smoothed training
count.  The model is trained in `rounds` passes.  A chunk's training documents are dealt to the rounds by a hash of
their place, so that each trains in exactly `share` of the rounds, by default in one; documents of more than PIECE
tokens train in pieces side by side.  Partitions train copies, and the copies are averaged, a square root of them to
a task and then those.  Scoring carries the state over windows, so a document's score is that of its whole text.

Which documents share a copy follows from the partitions that the table is read in, so `score` depends on the
table's layout; the counts and base scores do not.

Edge cases: null and empty texts are one end token; rows without doc_id count as training rows; repeated rows
count and score each for itself; very long texts make a chunk of their own; without training rows all counts are
zero; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gru
from .common import mix64, stored, string_bytes, table, words_of

CHUNK_BYTES = 12_000_000
FALLBACKS = 16
KNOWN = gru.SIZE - FALLBACKS - 1
END = np.uint64(0x9D39247E33776D40)
#: Documents that a task scores and trains side by side.
LANES, TRAIN_LANES = 192, 96
#: Tokens of a document that train in one lane.
PIECE = 2048


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key, doc) of each token, an end after each document; the low bits of a key are its fallback."""
    hashes, doc, starts, ends, data = words_of(texts, lower=True)
    if len(hashes):
        tail = data[ends - 1].astype(np.int64) * 31 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64) * 17
        hashes = (hashes & ~np.uint64(FALLBACKS - 1)) | (tail % 61 % FALLBACKS).astype(np.uint64)
    n = len(texts)
    keys, docs = np.empty(len(hashes) + n, np.uint64), np.empty(len(hashes) + n, np.int64)
    at = np.arange(len(hashes)) + doc
    ends_at = np.searchsorted(doc, np.arange(n), side="right") + np.arange(n)
    keys[at], docs[at] = hashes, doc
    keys[ends_at], docs[ends_at] = END, np.arange(n)
    return keys, docs


def chunks(docs: DataFrame) -> DataFrame:
    """A row per chunk: chunk, doc_ids, held, n_tokens, tokens (indexes into words), words, counts (in training rows)."""
    kind = docs.schema["doc_id"].dataType
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = string_bytes(batch.column(2))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
                part = batch.slice(at, to - at)
                keys, doc = _word_keys(part.column(2))
                out = part.column(1).to_numpy(zero_copy_only=False)
                codes, found = pd.factorize(keys)
                order = np.argsort(found)
                words, place = found[order], np.empty(len(found), np.uint32)
                place[order] = np.arange(len(found), dtype=np.uint32)
                index = place[codes]
                counts = np.bincount(index, ~out[doc], len(words)).astype(np.int64)
                lists = [pa.array([x]) for x in (number,)] + [pa.ListArray.from_arrays([0, part.num_rows], part.column(0)), pa.ListArray.from_arrays([0, part.num_rows], part.column(1))]
                sizes = pa.array([np.bincount(doc, minlength=part.num_rows)], pa.list_(pa.int64()))
                tokens = pa.array([index.astype(np.uint32).tobytes()], pa.binary())
                tables = [pa.ListArray.from_arrays([0, len(words)], pa.array(x)) for x in (words.view(np.int64), counts)]
                yield pa.RecordBatch.from_arrays([*lists, sizes, tokens, *tables], ["chunk", "doc_ids", "held", "n_tokens", "tokens", "words", "counts"])
                at, number = to, number + 1

    chosen = docs.select("doc_id", held.alias("held"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, f"chunk long, doc_ids array<{kind.simpleString()}>, held array<boolean>, n_tokens array<long>, tokens binary, words array<long>, counts array<long>")


def _chunk_words(held: DataFrame) -> DataFrame:
    """(chunk, word, n): each chunk's words with their training counts in it."""
    return held.select("chunk", F.inline(F.arrays_zip("words", "counts")).alias("word", "n"))


def corpus_counts(held: DataFrame) -> DataFrame:
    """(word, chunk, n, chunks, first): a row per word and chunk that holds it, with the word's training count in the corpus.

    chunks: how many chunks hold the word; first is true in one row of each word.
    """
    by_word = Window.partitionBy("word")
    number = F.row_number().over(by_word.orderBy("chunk"))
    return _chunk_words(held).select("word", "chunk", F.sum("n").over(by_word).alias("n"), F.count("*").over(by_word).alias("chunks"), (number == 1).alias("first"))


def _top(totals: DataFrame, n: int) -> np.ndarray:
    """The n words of most training tokens (ties by key), with their counts; the end is left out."""
    rows = totals.where((F.col("n") > 0) & (F.col("word") != int(END.view(np.int64)))).select("word", "n")
    return np.array([(r.word, r.n) for r in rows.orderBy(F.col("n").desc(), "word").limit(n).collect()], np.int64).reshape(-1, 2)


def _by_fallback(totals: DataFrame) -> dict[int, tuple[int, int]]:
    """Training tokens and distinct training words by fallback."""
    kind = F.col("word").bitwiseAND(F.lit(FALLBACKS - 1)).alias("kind")
    return {r.kind: (r.n, r.v) for r in totals.groupBy(kind).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).collect()}


class Symbols:
    """The model's symbols: known words, then fallbacks, then the end."""

    def __init__(self, top: np.ndarray):
        keys = top[:, 0].astype(np.int64).view(np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def of(self, words: np.ndarray) -> np.ndarray:
        out = KNOWN + (words & np.uint64(FALLBACKS - 1)).astype(np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            there = self.keys[at] == words
            out[there] = self.order[at[there]]
        out[words == END] = gru.SIZE - 1
        return out


def dealt(chunk: int, n: int, turn: int, rounds: int, share: float) -> np.ndarray:
    """Which of a chunk's n documents train in a turn: over all turns each does in share of the rounds, once at least."""
    with np.errstate(over="ignore"):
        place = mix64(mix64(np.full(1, chunk, np.uint64)) + np.arange(n, dtype=np.uint64)) % np.uint64(rounds)
    return (place + np.uint64(turn)) % np.uint64(rounds) < max(1, round(rounds * share))


def pieces(lengths: np.ndarray) -> np.ndarray:
    """Where the pieces of texts of these lengths, one after another, begin, and the end of the last."""
    count = -(-lengths // PIECE)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate([np.repeat(np.cumsum(lengths) - lengths, count) + inside * PIECE, [lengths.sum()]])


def _values(rows: pa.RecordBatch | pa.Table, column: str, i: int) -> np.ndarray:
    """A list column's values in row i."""
    return rows[column][i].values.to_numpy(zero_copy_only=False)


def _tokens(rows: pa.RecordBatch | pa.Table, i: int) -> np.ndarray:
    return np.frombuffer(rows["tokens"][i].as_buffer(), np.uint32)


def _train_round(held: DataFrame, symbols: Symbols, start: gru.Params, turn: int, rounds: int, share: float) -> gru.Params:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = start, 0
        for batch in batches:
            for i in range(batch.num_rows):
                n, out, words = (_values(batch, c, i) for c in ("n_tokens", "held", "words"))
                chosen = np.flatnonzero(~out & dealt(batch["chunk"][i].as_py(), len(n), turn, rounds, share))
                if not len(chosen):
                    continue
                ids = symbols.of(words.view(np.uint64))[_tokens(batch, i)]
                first = np.concatenate([[0], np.cumsum(n)])
                mine = np.concatenate([ids[first[d] : first[d + 1]] for d in chosen])
                data = gru.lanes(mine, pieces(n[chosen]), gru.SIZE - 1, TRAIN_LANES)
                p = gru.train(p, data, 0.02 / 2**turn)
                seen += len(mine)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([gru.packed(p)], pa.binary())], ["weight", "params"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for w, params in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(params, np.float32) * np.float64(w)
                weight, total = weight + w, x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["weight", "params"])

    copies = stored(held.select("chunk", "held", "n_tokens", "tokens", "words").mapInArrow(run, "weight double, params binary"), f"copies{turn}")
    wide = max(1, int(copies.count() ** 0.5))
    rows = copies.repartition(wide).mapInArrow(average, "weight double, params binary").repartition(1).mapInArrow(average, "weight double, params binary").collect()
    return gru.unpacked(bytes(rows[0]["params"]), start) if rows else start


class Model(NamedTuple):
    """What the corpus has taught: the network, its symbols, all training tokens and distinct words, and those behind each fallback."""

    params: gru.Params
    symbols: Symbols
    n_train: int
    distinct: int
    rest_n: np.ndarray
    rest_v: np.ndarray


def learned(held: DataFrame, counts: DataFrame, rounds: int = 3, share: float = 1 / 3) -> Model:
    """The model of the stored chunks and their counts."""
    totals = counts.where("first")
    top, fallback = _top(totals, KNOWN), _by_fallback(totals)
    symbols = Symbols(top)
    n_train, distinct = sum(n for n, _ in fallback.values()), sum(v for _, v in fallback.values())
    rest_n, rest_v = (np.array([fallback.get(k, (0, 0))[i] for k in range(FALLBACKS)], np.float64) for i in range(2))
    known_kind = (top[:, 0].view(np.uint64) & np.uint64(FALLBACKS - 1)).astype(np.int64)
    rest_n -= np.bincount(known_kind, top[:, 1], FALLBACKS)
    rest_v -= np.bincount(known_kind, minlength=FALLBACKS)
    n_end = held.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    end_kind = int(END & np.uint64(FALLBACKS - 1))
    rest_n[end_kind] -= n_end
    rest_v[end_kind] -= n_end > 0
    frequency = np.zeros(gru.SIZE)
    frequency[: len(top)], frequency[KNOWN : KNOWN + FALLBACKS], frequency[-1] = top[:, 1], rest_n, n_end
    params = gru.initial(frequency)
    for turn in range(rounds):
        params = _train_round(held, symbols, params, turn, rounds, share)
    return Model(params, symbols, n_train, distinct, rest_n, rest_v)


def scored(held: DataFrame, counts: DataFrame, m: Model) -> DataFrame:
    """The rows of document_scores of the stored chunks."""

    def score(part: pa.Table, back: pa.Table) -> pa.Table:
        at, n_all = back["word"].to_numpy().view(np.uint64), back["n"].to_numpy()
        out = []
        for i in range(part.num_rows):
            words, tokens, n = _values(part, "words", i).view(np.uint64), _tokens(part, i), _values(part, "n_tokens", i)
            counts = _values(part, "counts", i).copy()
            counts[np.searchsorted(words, at)] = n_all
            first = np.concatenate([[0], np.cumsum(n)])
            add = lambda x: np.add.reduceat(x[tokens], first[:-1])  # noqa: B023, E731
            base = np.log10((counts + 0.5) / (m.n_train + 0.5 * (m.distinct + 1)))
            ids = m.symbols.of(words)
            other = (ids >= KNOWN) & (ids < gru.SIZE - 1)
            which = np.where(other, ids - KNOWN, 0)
            within = np.where(other, np.log10((counts + 0.5) / (m.rest_n[which] + 0.5 * (m.rest_v[which] + 1))), 0.0)
            data = gru.lanes(ids[tokens], first, gru.SIZE - 1, LANES)
            model = gru.log_likelihood(m.params, data, len(n)) / np.log(10)
            out.append(pa.table({"doc_id": part["doc_ids"][i].values, "held_out": part["held"][i].values, "n_tokens": n, "n_known": add((counts > 0).astype(np.int64)), "train_tokens": np.full(len(n), m.n_train), "base_score": add(base), "score": model + add(within)}))
        return pa.concat_tables(out)

    kind = held.schema["doc_ids"].dataType.elementType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # a word of one chunk has all its count there
    replies = counts.where("chunks > 1").select(F.col("chunk").alias("of"), "word", "n")
    return held.groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(score, result)


def document_scores(docs: DataFrame, rounds: int = 3, share: float = 1 / 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores as log10 probabilities."""
    held = stored(chunks(docs), "chunks")
    counts = stored(corpus_counts(held), "counts")
    return scored(held, counts, learned(held, counts, rounds, share))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(table(spark, sf_dir, "documents"))
