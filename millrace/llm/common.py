"""What several corpus operators share: shared-folder tables, reading, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one made for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables stored in each open `scratch`, the innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables stored within are deleted at the end, but for those that are taken from the list."""
    _SCRATCH.append(held := [])
    try:
        yield held
    finally:
        _SCRATCH.pop()
        release(*held)


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until `release` or the `scratch` around it deletes it.  options: more of the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `stored` made, once nothing that is still to run reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls have no bytes; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type.value_type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _mixer() -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)


#: A random 64-bit value for each byte, and the odd base of the polynomial.
BYTE_VALUE, BASE = _mixer()
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word under [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_ALNUM_TABLE = np.ones(256, bool)
_ALNUM_TABLE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of all texts; no word crosses from one text to the next."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span of bytes.  Spans must be sorted; works over pieces of about step bytes, plus the longest span."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(starts, base + step)))
            piece = BYTE_VALUE[data[base : ends[to - 1]]]
            up = powers(BASE, len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * up, out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            down = powers(_INVERSE, int(s[-1]) + 1)
            out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
    return out


def words_of(texts: pa.Array, lower: bool = False, alnum: bool = False):
    """(hash, doc, start, end, data) of all words of an Arrow string array."""
    data, offsets = string_bytes(texts)
    if lower:
        data = lowered(data)
    starts, ends = word_spans(data, offsets, _ALNUM_TABLE if alnum else _SPACE_TABLE)
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return span_hashes(data, starts, ends), docs, starts, ends, data


def concat_slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes start..start+count of each slice, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def n_words(column: str = "text"):
    """Native count of the words of a text column; null counts none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def bound(value, body):
    """body(value) as a native expression in which value is computed once."""
    return F.transform(F.array(value), body)[0]
