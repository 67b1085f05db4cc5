"""Benchmark decontamination over a distributed positional inverted index.

The index counts positions over blocks of documents.  It has a row per term (a 64-bit hash) and block, how often and
at which ascending positions the term stands there, and a row per document, its place in the block and its words; no
row holds more than one term of one block.  The benchmark is a table of phrases.  Corpus counts of its terms tell each
phrase's rarest term; a phrase is a candidate in the blocks that hold that term, and one with a term that the corpus
lacks is none.  A block's candidates meet the postings of the benchmark's terms, no others.  There the rarest term's
positions, less its offset in the phrase, are where the phrase may begin, and each further term, rarest first, keeps
those at which its own positions less its offset agree (exact phrases) or come within `slop` (proximity).  Nothing is
collected: phrases, postings and hits meet in joins.

Words are known by 64-bit hashes alone.  A task holds one block's postings of the benchmark's terms and its candidate phrases.  Edge cases: null and
empty texts have no words and are never hit; items without words have no phrase; repeated rows and items count each
for itself (an item id once); long texts get a block of their own; a null item id is reported as an empty string;
doc_id keeps its type; extra columns are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, string_bytes, table, words_of

BLOCK_BYTES = 2_000_000
#: A task that writes or reads the index holds a row group.
ROW_GROUP = {"parquet.block.size": 32 << 20}


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of the words of all documents, over blocks of about BLOCK_BYTES of text.

    A row has either term, n (times in the block) and postings, or place (in the block), doc_id and n_words.  Position p
    of the block is word p - d of document d of the block, counted over the block: a gap parts documents.
    """
    names = ["block", "term", "n", "postings", "place", "doc_id", "n_words"]

    def rows(block: int, size: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = string_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
                ids, texts = batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
                terms, doc, *_ = words_of(texts, lower=True, alnum=True)
                no = lambda kind, size=to - at: pa.nulls(size, kind)
                yield rows(block, to - at, no(pa.int64()), no(pa.int32()), no(pa.binary()), pa.array(np.arange(to - at, dtype=np.int32)), ids, pa.array(np.bincount(doc, minlength=to - at).astype(np.int64)))
                order = np.argsort(terms, kind="stable")
                posted, terms = (np.arange(len(terms)) + doc)[order].astype(np.uint32), terms[order]
                begin = np.flatnonzero(np.diff(terms, prepend=~terms[:1]))
                edges = np.append(begin, len(terms)).astype(np.int32)
                # differences within a term compress better
                steps = np.diff(posted, prepend=posted[:1])
                steps[begin] = posted[begin]
                n = len(begin)
                postings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * edges), pa.py_buffer(steps)])
                yield rows(block, n, pa.array(terms[begin].view(np.int64)), pa.array(np.diff(edges)), postings, pa.nulls(n, pa.int32()), pa.nulls(n, ids.type), pa.nulls(n, pa.int64()))
                at, block = to, block + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"block long, term long, n int, postings binary, place int, doc_id {kind}, n_words long")


def places(index: DataFrame) -> DataFrame:
    """(block, place, doc_id, n_words) of all documents of an index."""
    return index.where("place is not null").select("block", "place", "doc_id", "n_words")


def item_phrases(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, phrase): the windows of each item's words; an item of fewer words, but not none, is one phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, doc, *_ = words_of(batch.column(1), lower=True, alnum=True)
            n = np.bincount(doc, minlength=batch.num_rows)
            first, size = np.cumsum(n) - n, np.minimum(n, window)
            count = np.where(n > 0, n - size + 1, 0)
            owner = np.repeat(np.arange(batch.num_rows), count)
            begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            edges = np.concatenate([[0], np.cumsum(size[owner])])
            places = np.arange(edges[-1]) - np.repeat(edges[:-1] - begin, size[owner])
            phrases = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(terms[places].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), phrases], ["item", "phrase"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items.mapInArrow(run, "item string, phrase array<long>").distinct()


def candidates(index: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(block, phrase): distinct phrases all of whose terms the corpus has, in the blocks that hold their rarest term."""
    # stored, so that a join has plain shuffles on both sides and the rows of a frequent term can be split
    met = stored(index.select("block", "term", "n").join(terms, "term"), "met-terms")
    counts = stored(met.groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    spread = phrases.select("phrase", F.explode(F.array_distinct("phrase")).alias("term")).join(counts, "term")
    rarest = spread.groupBy("phrase").agg(F.count("*").alias("known"), F.min(F.struct("n", "term")).alias("least")).where(F.col("known") == F.size(F.array_distinct("phrase")))
    rarest = stored(rarest.select("phrase", F.col("least.term").alias("term")), "rarest")
    return met.select("block", "term").join(rarest, "term").select("block", "phrase")


def _agree(starts: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
    at = np.searchsorted(positions, starts - slop)
    return starts[(at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] <= starts + slop)]


def search_index(index: DataFrame, asked: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """Per document with a hit: block, place, spans (start, stop of words hit, merged), phrases; asked: (block, phrase).

    With slop 0 spans are exact occurrences; otherwise each term stands within slop of its place in the phrase.  terms
    has every term of the phrases asked for.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    kinds = (pa.int64(), pa.int32(), span, pa.list_(pa.list_(pa.int64())))

    def run(part: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "place": [], "spans": [], "phrases": []}
        phrases = wanted["phrase"].combine_chunks()
        size, flat = phrases.value_lengths().to_numpy(), phrases.flatten().to_numpy()
        where = np.cumsum(size) - size
        held, docs = (part.filter(part[c].is_valid()).sort_by(c) for c in ("term", "place"))
        own, n_words = held["term"].to_numpy(), docs["n_words"].to_numpy()
        if not len(own) or not len(flat):
            return pa.table([pa.array([], k) for k in kinds], names=list(out))
        ends = np.cumsum(held["n"].to_numpy().astype(np.int64))
        begin = ends - np.diff(ends, prepend=0)
        posted = np.cumsum(string_bytes(held["postings"])[0].view(np.uint32), dtype=np.int64)
        posted -= np.repeat(np.append(0, posted[ends[:-1] - 1]), ends - begin)
        first = np.cumsum(n_words + 1) - n_words - 1
        term = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        whole = np.logical_and.reduceat(own[term] == flat, where)
        cover, hits = np.zeros(int(first[-1] + n_words[-1]) + 2, np.int64), {}
        for k in np.flatnonzero(whole).tolist():
            length, phrase = size[k], term[where[k] : where[k] + size[k]]
            rarest = np.argsort((ends - begin)[phrase], kind="stable")
            lists = ((posted[begin[phrase[o]] : ends[phrase[o]]] - o) for o in rarest)  # noqa: B023
            starts = next(lists)
            for other in lists:
                starts = _agree(starts, other, slop)
                if not len(starts):
                    break
            at = np.searchsorted(first, starts, side="right") - 1
            inside = (at >= 0) & (starts >= first[at]) & (starts + length <= first[at] + n_words[at])
            np.add.at(cover, starts[inside], 1)
            np.add.at(cover, starts[inside] + length, -1)
            for d in set(at[inside].tolist()):
                hits.setdefault(d, []).append(k)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover) > 0]).astype(np.int8)))
        spans: dict[int, list] = {d: [] for d in hits}
        for d, s, e in zip((np.searchsorted(first, turns[0::2], side="right") - 1).tolist(), turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
            spans[d].append({"start": s - int(first[d]), "stop": e - int(first[d])})
        for d in sorted(hits):
            for c, x in zip(out, (part["block"][0].as_py(), d, spans[d], [phrases[k].as_py() for k in hits[d]]), strict=True):
                out[c].append(x)
        return pa.table([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

    named = asked.select(F.col("block").alias("of"), "phrase")
    both = index.join(terms, "term").select("block", "term", "n", "postings").unionByName(places(index).select("block", "place", "n_words"), allowMissingColumns=True)
    # stored, so that its size is known: the join is moved below the other one, where the whole index would be shuffled
    held = both.join(stored(asked.select("block").distinct(), "blocks"), "block", "left_semi")
    return held.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(run, "block long, place int, spans array<struct<start:int,stop:int>>, phrases array<array<long>>")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences), items (sorted), spans."""
    return find_in_index(stored(build_index(docs), "positions", **ROW_GROUP), benchmark, window, slop)


def find_in_index(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """As find_benchmark, over an index that is stored already."""
    by_item = stored(item_phrases(benchmark, window), "phrases")
    terms = stored(by_item.select(F.explode("phrase").alias("term")).distinct(), "phrase-terms")
    asked = stored(candidates(index, by_item.select("phrase").distinct(), terms), "candidates")
    hits = stored(search_index(index, asked, terms, slop), "hits")
    named = hits.select("block", "place", F.explode("phrases").alias("phrase")).join(by_item, "phrase")
    items = named.groupBy("block", "place").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stored(hits.select("block", "place", "spans").join(items, ["block", "place"]), "found")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]), F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return places(index).join(found, ["block", "place"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def contaminated():
    """Hit at all, and in a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated; texts are judged once for all rows that hold them."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    index = stored(build_index(docs.select(key.alias("doc_id"), "text")), "positions", **ROW_GROUP)
    found = find_in_index(index, benchmark)
    leave = stored(found.where(contaminated()).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    release(index)
    return docs.withColumn("__tkey", key).join(leave, F.col("__tkey") == F.col("__key"), "left_anti").drop("__tkey")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT g.rid, g.n, g.i, p.item FROM grams g JOIN phrases p ON g.n = p.n AND g.phrase = p.phrase),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
