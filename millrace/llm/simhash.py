"""SimHash near-duplicates, linked through a segment-popcount embedding.

The 64 bits of a fingerprint are 32 segments of two bits; the embedding is the vector of their popcounts.  The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so fingerprints within
`bits` of each other differ in at most `bits` groups of segments: of g groups, g - bits are equal.  The grid has a
cell for each choice of g - bits groups and each value of their popcounts; fingerprints that link share a cell.
Inside a cell candidates pass the Manhattan bound, then the exact distance, and only links that join what was
still apart leave the task.  Cells beyond `cell_limit` fingerprints are split into blocks, and every pair of
blocks is a task's work, so no cell is one task's and none is cut short.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated rows keep their rows;
very long texts are hashed in pieces; rows without doc_id take part, but name no component unless they are alone;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, stored, table
from .graph import components

SEED = 42
_PIECE = 1 << 15
#: Chance that two random two-bit segments have the same popcount.
_SAME = 0.375
_EVEN = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of the word shingles of a text, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        spans = zip(starts[at : min(at + _PIECE, n)], ends[at + k - 1 : at + k - 1 + _PIECE], strict=False)
        h = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in spans), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tkey")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, tkey): the fingerprint as a signed long, and the 64-bit hash that names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "tkey"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string"), text_key()).mapInArrow(run, f"doc_id {kind}, fp long, tkey long")


def embedding(fps: np.ndarray) -> np.ndarray:
    """The popcounts of the 32 two-bit segments, each in its own two bits."""
    return (fps & _EVEN) + ((fps >> np.uint64(1)) & _EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of embeddings: counts are 0, 1 or 2, so their unary codes differ in |x - y| bits."""
    high = np.uint64(0xAAAAAAAAAAAAAAAA)
    ua, ub = a | ((a & high) >> np.uint64(1)), b | ((b & high) >> np.uint64(1))
    return np.bitwise_count(ua ^ ub)


def grid(n: int, bits: int, row_cost: float = 100.0) -> list[np.ndarray]:
    """The masks of the cells, of as many groups as cost least for n fingerprints.

    With g groups a fingerprint has comb(g, bits) cells, each of which is shuffled and sorted, and is compared with
    those that it meets there by chance; a cell costs as much as row_cost comparisons.  At least two groups are equal
    in a cell: fingerprints of texts in one language are far from random, and a single group tells them badly apart.
    """

    def cost(groups: int) -> float:
        keep = groups - bits
        return comb(groups, keep) * (row_cost + n * _SAME ** (32 * keep / groups))

    groups = min(range(bits + 2, 33), key=cost)
    edges = np.linspace(0, 32, groups + 1).round().astype(int)
    parts = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(groups)]
    return [np.uint64(sum(chosen)) for chosen in combinations(parts, groups - bits)]


def _joined(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of the same cell (equal keys, adjacent): each fingerprint with its group's first."""
    n = len(keys)
    root, emb = np.arange(n), embedding(fps)
    alive = np.flatnonzero(keys[1:] == keys[:-1])
    step = 1
    while len(alive):
        i, j = alive, alive + step
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        near = manhattan(emb[i], emb[j]) <= bits
        i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = _find(root, x), _find(root, y)
            root[max(x, y)] = min(x, y)
        if near.any():
            while not np.array_equal(root, up := root[root]):
                root = up
        step += 1
        alive = alive[alive + step < n]
        alive = alive[keys[alive + step] == keys[alive]]
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        x = root[x]
    return x


def near_links(prints: DataFrame, bits: int = 4, cell_limit: int = 8192) -> DataFrame:
    """prints (fp, distinct) -> links (a, b) that connect all fingerprints within `bits` of each other."""
    masks = grid(prints.count(), bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            emb = embedding(fps)
            for k, mask in enumerate(masks):
                with np.errstate(over="ignore"):
                    keys = mix64((emb & mask) ^ mix64(np.full(1, k + 1, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0)], ["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lo, hi, cell, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            with np.errstate(over="ignore"):
                keys = mix64(mix64(cell.view(np.uint64) ^ (lo.astype(np.uint64) << np.uint64(32))) + hi.astype(np.uint64))
            new = (keys, fps.view(np.uint64))
            keys, fps = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
            # the last run may go on in the next batch
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
            held = (keys[cut:], fps[cut:])
            a, b = _joined(keys[:cut], fps[:cut], bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        if held is not None:
            a, b = _joined(*held, bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    celled = prints.select("fp").mapInArrow(cells, "cell long, fp long")
    large = celled.groupBy("cell").count().where(F.col("count") > cell_limit)
    celled = celled.join(large, "cell", "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / (cell_limit // 2)), F.lit(1)).cast("int"))
    celled = celled.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = celled.select(F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "cell", "fp")
    blocks = blocks.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "fp")
    return blocks.mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, tkey, fp, root, component_id) for every row of docs; component_id is the least doc_id reachable."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), bits))
    named = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    # stored, so that a join has plain shuffles on both sides and a hot group's rows can be split
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    by_print = stored(named.join(names, "root").select("fp", "root", "component_id"), "by-print")
    return prints.join(by_print, "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least doc_id (then text hash), once."""
    groups = near_groups(docs, shingle, bits)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    stay = groups.groupBy("root").agg(least.alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.tkey").alias("__key"))
    keyed = docs.withColumn("__tkey", text_key())
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__key")), "left_semi")
    # rows that repeat both doc_id and text are one document; copies meet before the shuffle
    return kept.dropDuplicates(["doc_id", "__tkey"]).select(*[f"`{c}`" for c in docs.columns])


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
