"""Requests, replies and stored records."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import json_text
from ..schema import Storing


def chat_request(prompt: Column, model: str, max_tokens: int) -> Column:
    """A chat body with one user message, as JSON text."""
    return F.concat(F.lit(f'{{"model":"{model}","max_tokens":{max_tokens},"messages":[{{"role":"user","content":'), json_text(prompt), F.lit("}]}"))


def chat_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, messages, n): the turns in order as one JSON array."""
    message = F.concat(F.lit('{"role":'), json_text(F.col("role")), F.lit(',"content":'), json_text(F.col("text")), F.lit("}"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"), F.count("*").alias("n"))
    return listed.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]")).alias("messages"), "n")


def full_batches(rows: DataFrame, position: str, size: int) -> DataFrame:
    """(id, n, first, last): batches of `size` rows by a gapless position; a last batch that is not full is left out."""
    batch = F.floor(F.col(position) / size).cast("long")
    grouped = rows.groupBy(batch.alias("b")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return grouped.where(F.col("n") == size).select(F.concat(F.lit("batch-"), F.format_string("%05d", "b")).alias("id"), "n", "first", "last")


def record(out: dict[str, Column], row_id: Column, error: Column) -> list[Column]:
    """The columns of a stored record: id and error are the run's own, whatever the parsed reply holds."""
    kept = {k: F.when(error.isNull(), v) for k, v in out.items() if k not in ("id", "error")}
    return [row_id.alias("id"), error.alias("error"), *[v.alias(k) for k, v in kept.items()]]


def parsed(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """rows with the declared columns of a JSON body; what the body does not have, or not so, is null."""
    names = [f.split(" ", 1)[0] for f in schema.split(", ")]
    return rows.withColumn("__body", F.from_json(body, schema)).select("*", *(F.col(f"__body.{n}").alias(n) for n in names)).drop("__body")


def cardinality_error(got: Column, want: Column) -> Column:
    """The error of a reply with another number of items than its request; null where they agree."""
    return F.when(got != want, F.concat(F.lit("parse: expected "), want, F.lit(" items, got "), got))


def conformed(rows: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """(id, error, ...) of rows (id, JSON object): the body's values as a declared schema holds them, or why it does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Storing(schema)
        for batch in batches:
            yield store.batch([{**json.loads(text), "id": i, "error": None} for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return rows.select(F.col("id").cast("string"), F.col(body).cast("string")).mapInArrow(run, schema)


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    """content as a data address on one line: Spark breaks what it encodes after 76 characters."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


def first_rows_failed(records: DataFrame, position: str, n: int) -> bool:
    """Whether the first n records by position are there and all are errors: the run should stop."""
    head = records.orderBy(position).limit(n).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("e")).first()
    return n > 0 and head["n"] == n == head["e"]


def batched(rows: DataFrame, position: str, value: str, size: int) -> DataFrame:
    """(id, n, items): the values of each batch of `size` rows in order, as the items of one request; the last may be short."""
    batch = F.floor(F.col(position) / size).cast("long")
    grouped = rows.groupBy(batch.alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("x"))
    return grouped.select(F.concat(F.lit("batch-"), F.format_string("%05d", "b")).alias("id"), "n", F.transform("x", lambda x: x["v"]).alias("items"))


def template_rows(rows: DataFrame, index: str, run: str, words: Sequence[str], length: int) -> DataFrame:
    """(id, seed, text) of a made-up prompt for each row; rows of different runs share no beginning.

    The text and the choice of words are fixed values.
    """
    i, bag = F.col("__i"), F.array(*map(F.lit, words))
    name = F.concat(F.lit(f"{run}-"), i.cast("string"))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.element_at(bag, ((i * 7 + j * 3) % len(words) + 1).cast("int")))
    text = F.concat(F.lit(f"[{run}] Summarise in one sentence (item "), i.cast("string"), F.lit("): "), F.array_join(chosen, " "))
    return rows.select(F.col(index).alias("__i")).select(name.alias("id"), F.crc32(F.encode(name, "UTF-8")).alias("seed"), text.alias("text"))
