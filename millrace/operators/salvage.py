"""Types for records that nobody declared: the first typed value of a column pins it, and a row that clashes is demoted.

A record is a JSON object.  Its values are laid out as rows (pos, path, kind), where a path runs through objects and
lists, so a nested clash is found like any other.  A column's kind is that of its first typed value in the order of
`pos` among the rows that stay; whole numbers and fractions share a column as fractions, and then a whole number that
no double holds does not fit.  A row that is demoted pins nothing, which may free a column for another kind: rounds of
aggregates and joins go on until no row changes.

A round demotes only rows whose fate is settled.  A clash is, once the pin's own row comes before every clash of the
round, for such rows stay.  A whole number is, once a row that has no such number itself brings fractions to its
column; where no row does, the first goes.  So the outcome is that of going through the rows one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept

NUMBERS = ("whole", "fraction")
UNSTORABLE = "unstorable"
#: The largest whole number up to which a double holds them all; a cast that may lose nothing ends here.
EXACT = 2**53


def _kind(value: Any) -> str:
    return "truth" if isinstance(value, bool) else "whole" if isinstance(value, int) else "fraction" if isinstance(value, float) else "text"


def laid_out(value: Any, path: tuple = (), inner: bool = False) -> Iterator[tuple[tuple, str, bool]]:
    """(path, kind, whether it is beyond EXACT) of the typed values of a JSON value.

    Nulls, empty lists and an empty object at the top say nothing; an empty object further in can't be stored.
    """
    if isinstance(value, dict):
        if not value and inner:
            yield path, UNSTORABLE, False
        items = [found for k, v in value.items() for found in laid_out(v, (*path, k), True)]
        if items:
            yield path, "object", False
        yield from items
    elif isinstance(value, list):
        items = [found for v in value for found in laid_out(v, (*path, 0), True)]
        if items:
            yield path, "list", False
        yield from items
    elif value is not None:
        yield path, _kind(value), isinstance(value, int) and abs(value) > EXACT


def row_kinds(text: str | None) -> list[tuple[str, str, bool]]:
    """The distinct (path, kind, too large) of a record; a path is a JSON list of keys, 0 for any item of a list.

    A path with two kinds in one record can't be stored, nor can a record that is no object or a number beyond 64 bits.
    """
    try:
        record = json.loads(text or "null")
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return [("[]", UNSTORABLE, False)]
    found: dict[str, set] = {}
    for key, value in record.items():
        for path, kind, inexact in laid_out(value, (key,), False):
            found.setdefault(json.dumps(path), set()).add((kind, inexact))
    out = []
    for path, kinds in found.items():
        names = {k for k, _ in kinds}
        inexact = any(x for _, x in kinds)
        if len(names) > 1 and not names <= set(NUMBERS) or len(names) > 1 and inexact:
            out.append((path, UNSTORABLE, False))
        else:
            out.append((path, "fraction" if "fraction" in names else names.pop(), inexact))
    return out


def pinned_kinds(schema: T.StructType) -> list[tuple[str, str]]:
    """(path, kind) of the columns of stored parts, for records that are to be appended to them."""

    def walk(t: T.DataType, path: tuple) -> Iterator[tuple[str, str]]:
        if isinstance(t, T.StructType):
            yield json.dumps(path), "object"
            for f in t.fields:
                yield from walk(f.dataType, (*path, f.name))
        elif isinstance(t, T.ArrayType):
            yield json.dumps(path), "list"
            yield from walk(t.elementType, (*path, 0))
        else:
            kind = "truth" if isinstance(t, T.BooleanType) else "whole" if isinstance(t, T.IntegralType) else "fraction" if isinstance(t, T.FractionalType) else "text"
            yield json.dumps(path), kind

    return [x for f in schema.fields if f.name not in ("id", "error") for x in walk(f.dataType, (f.name,))]


def typed_values(records: DataFrame, column: str = "out") -> DataFrame:
    """(pos, path, kind, inexact) of records (pos, JSON text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, *x) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in row_kinds(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["pos", "path", "kind", "inexact"])

    return records.select(F.col("pos").cast("long"), F.col(column).cast("string")).mapInArrow(run, "pos long, path string, kind string, inexact boolean")


def _class(kind):
    return F.when(kind.isin(*NUMBERS), "number").otherwise(kind)


def _clashes(live: DataFrame) -> DataFrame:
    """(pos, owner, path, error): values of another kind than the first of their path; owner is the pin's row."""
    pins = live.groupBy("path").agg(F.min_by(F.struct("pos", _class(F.col("kind")).alias("pinned")), "pos").alias("p")).select("path", F.col("p.pos").alias("owner"), "p.pinned")
    said = F.concat(F.col("path"), F.lit(": "), F.col("kind"), F.lit(" where the column holds "), F.col("pinned"))
    return live.join(pins, "path").where(_class(F.col("kind")) != F.col("pinned")).select("pos", "owner", "path", said.alias("error"))


def _imprecise(live: DataFrame) -> DataFrame:
    """(pos, path, error): whole numbers too large for a double, in columns that some row makes fractional."""
    fractional = live.where("kind = 'fraction'").select("path").distinct()
    return live.where("kind = 'whole' and inexact").join(fractional, "path", "left_semi").select("pos", "path", F.concat("path", F.lit(": a whole number too large for a double")).alias("error"))


def demoted_rows(values: DataFrame, pins: list[tuple[str, str]] = ()) -> DataFrame:
    """(pos, error) of the rows that can't be stored with the others, nor in columns of given kinds."""
    spark = values.sparkSession
    values = kept(values)
    gone = values.where(F.col("kind") == UNSTORABLE).select("pos", F.concat("path", F.lit(": can't be stored")).alias("error"))
    if pins:
        held = F.broadcast(spark.createDataFrame(list(pins), "path string, pinned string"))  # as many as the stored columns have parts
        value = F.col("kind")
        clash = (_class(value) != _class(F.col("pinned"))) | ((value == "fraction") & (F.col("pinned") == "whole")) | (F.col("inexact") & (F.col("pinned") == "fraction"))
        gone = gone.union(values.join(held, "path").where(clash).select("pos", F.concat(F.col("path"), F.lit(": "), value, F.lit(" where the column holds "), F.col("pinned")).alias("error")))
    first_error = lambda df: df.groupBy("pos").agg(F.min("error").alias("error"))
    gone = kept(first_error(gone))
    while True:
        live = values.join(gone, "pos", "left_anti")
        found = kept(_clashes(live))
        first = found.agg(F.min("pos").alias("pos")).first()["pos"]
        if first is None:
            break
        gone = kept(gone.union(first_error(found.where(F.col("owner") < first))))
    while True:
        live = values.join(gone, "pos", "left_anti")
        found = kept(_imprecise(live))
        first = found.agg(F.min("pos").alias("pos")).first()["pos"]
        if first is None:
            return gone
        clean = live.where("kind = 'fraction'").join(found.select("pos").distinct(), "pos", "left_anti").select("path").distinct()
        settled = found.join(clean, "path", "left_semi")
        gone = kept(gone.union(first_error(found.where(F.col("pos") == first) if settled.isEmpty() else settled)))


def salvaged(records: DataFrame, schema: T.StructType | None = None, column: str = "out") -> DataFrame:
    """records (pos, JSON text, ...) with error: why a row can't be stored with the others; its text is then null.

    schema: the columns of parts that are there already (reader.newest_schema).
    """
    gone = demoted_rows(typed_values(records, column), pinned_kinds(schema) if schema else [])
    error = F.concat(F.lit("parse output not storable: "), F.col("error"))
    rows = records.drop("error").join(gone, "pos", "left").withColumn("error", error)
    return rows.withColumn(column, F.when(F.col("error").isNull(), F.col(column)))


def stored_kinds(records: DataFrame, column: str = "out") -> DataFrame:
    """(path, kind) of the columns that the rows of `salvaged` make: what a part of them holds."""
    live = typed_values(records.where("error is null"), column)
    return live.groupBy("path").agg(F.max(F.when(F.col("kind") == "fraction", 2).when(F.col("kind") == "whole", 1).otherwise(0)).alias("n"), F.min("kind").alias("kind")).select("path", F.when(F.col("n") == 2, "fraction").otherwise(F.col("kind")).alias("kind"))
