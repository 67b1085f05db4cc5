"""Vector code compression: each vector as sixteen one-byte codes, from codebooks learned over the whole table.

Whole vectors become integers and are packed in blocks of columns, one column a dimension.  A round is a treeAggregate
over the blocks: a task measures a part against its codebook dimension by dimension, adds the sums and counts of the
entries with np.add.at in 64-bit integers, and the partial tensors meet in a tree; only the last of them, whose size
is that of the codebooks, reaches the driver.  The arithmetic is exact, so no result depends on how rows are dealt.

Edge cases: a null vector, and one with a null or non-finite component, is left out, and so is one whose length is not
that of the vector with the smallest id (ties between repeated ids: the smaller vector); a length that 16 does not
divide is filled up with zeros; fewer than 64 vectors make codebooks with as many entries; a component beyond half a
million counts as half a million, so that squares fit in 64 bits; repeated rows count each for itself; a null id comes
after all others; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors in a block of columns.
BLOCK = 4096
#: The largest size of an integer component.
LIMIT = 1 << 27


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows whose vector has finite components only, with them as integers floor(256 * x) in `v`."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floor = lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(256.0) * c.cast("double")))).cast("int")
    return rows.where(x.isNotNull() & finite).withColumn("v", F.transform(x, floor))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def column_blocks(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(n, data): blocks of at most BLOCK vectors of one length, each the int32 values of its dimensions, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _padded(matrix(batch.column(0)[at : at + BLOCK]), parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.T.tobytes()], pa.binary())], ["n", "data"])

    return vectors.select("v").mapInArrow(run, "n long, data binary")


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each vector's part: dimensions x vectors against entries x dimensions; ties to the lower entry."""
    top = 1 + max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * top * top * max(1, len(part)) < 2**31 else np.int64
    part, book = part.astype(kind), book.astype(kind)
    apart = np.zeros((len(book), part.shape[1]), kind)
    for values, entries in zip(part, book.T, strict=True):
        step = values[None, :] - entries[:, None]
        apart += step * step
    code = apart.argmin(axis=0)
    return code, np.take_along_axis(apart, code[None, :], axis=0)[0].astype(np.int64)


def _add(total: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return total[0] + more[0], total[1] + more[1]


def learned(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x dimensions) after some rounds over all blocks; an entry that nothing is nearest to stays."""
    parts, entries, wide = books.shape
    context = blocks.sparkSession.sparkContext
    rows = blocks.select("n", "data").rdd
    depth = 2 if rows.getNumPartitions() <= 4096 else 3
    for _ in range(rounds):
        sent = context.broadcast(books)  # as large as the codebooks

        def counted(total, row, sent=sent):
            columns = np.frombuffer(row["data"], np.int32).reshape(parts, wide, row["n"])
            for p, (part, book) in enumerate(zip(columns, sent.value, strict=True)):
                code, _ = nearest(part, book)
                np.add.at(total[0][p], code, part.T.astype(np.int64))
                np.add.at(total[1][p], code, 1)
            return total

        sums, counts = rows.treeAggregate((np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)), counted, _add, depth)
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]
        sent.unpersist()
    return books


def first_books(vectors: DataFrame, id_key: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The parts of the vectors with the `entries` smallest ids; None where there is no vector.  At most `entries` rows are collected."""
    in_order = [F.col(id_key).asc_nulls_last(), F.col("v").asc()]
    first = vectors.select(id_key, "v").orderBy(*in_order).limit(1).collect()
    if not first:
        return None
    alike = vectors.where(F.size("v") == len(first[0].v)).select(id_key, "v").orderBy(*in_order).limit(entries).collect()
    x = _padded(np.array([r.v for r in alike], np.int64).reshape(len(alike), -1), parts)
    return x.reshape(len(alike), parts, -1).transpose(1, 0, 2)


def encoded(vectors: DataFrame, books: np.ndarray, wide: int) -> DataFrame:
    """vectors of `wide` components with code (two hex digits a part) and error in place of v."""
    names = [c for c in vectors.columns if c != "v"]
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _padded(matrix(part.column(len(names))), parts).T.reshape(parts, books.shape[2], part.num_rows)
                found = [nearest(columns, book) for columns, book in zip(x, books, strict=True)]
                digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                error = reduce(np.add, [error for _, error in found])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*names, "code", "error"])

    return vectors.where(F.size("v") == wide).select(*names, "v").mapInArrow(run, f"{kinds}, code string, error long")


def decoded(code: Column, books: np.ndarray) -> Column:
    """The components that a code stands for, as an array; native."""
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    held = [F.array(*(F.array(*map(F.lit, map(int, e))) for e in book)) for book in books]
    return F.flatten(F.array(*(F.get(held[p], entry(p)) for p in range(len(books)))))


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "v")
    start = first_books(vectors, "vec_id")
    if start is None:
        return vectors.limit(0).selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    wide = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()["n"]
    blocks = stored(column_blocks(vectors.where(F.size("v") == wide)), "blocks")
    books = learned(blocks, start)
    codes = stored(encoded(vectors, books, wide), "codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    # a plain join: Spark broadcasts the totals where their size allows, or else splits the labels with many rows
    joined = codes.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    apart = "(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT"

    def assigned(i: int) -> str:
        return f"a{i} AS (SELECT rid, p, any_value(x) AS x, min({apart} * 64 + k) AS m FROM parts JOIN c{i} USING (p) GROUP BY rid, p)"

    def moved(i: int) -> str:
        return (
            f"u{i} AS (SELECT p, m % 64 AS k, j, floor(sum(x[j]) / count(*)) AS e FROM a{i}, range(1, (SELECT d + 1 FROM width)) r(j) GROUP BY ALL), "
            f"c{i + 1} AS (SELECT c{i}.p, c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT p, k, list(e ORDER BY j) AS c FROM u{i} GROUP BY p, k) n USING (p, k))"
        )

    return f"""WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
width AS (SELECT len(v) // {PARTS} AS d FROM kept LIMIT 1),
parts AS (SELECT rid, vec_id, p, v[p * d + 1 : (p + 1) * d] AS x FROM kept, width, range({PARTS}) r(p)),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS k FROM kept ORDER BY vec_id, v LIMIT {ENTRIES}),
c0 AS (SELECT p, k, x AS c FROM parts JOIN first USING (rid)),
{assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
coded AS (SELECT rid, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY rid),
digest AS (SELECT sha256(string_agg(e::BIGINT::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS e, generate_subscripts(c, 1) AS j FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), digest"""


OP11_SQL = _sql()
