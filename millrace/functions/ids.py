"""Row identifiers and shards, as native column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(value: Column) -> Column:
    """A string as JSON text, as Python's json.dumps(ensure_ascii=False) writes it."""
    whole = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(whole, 2, F.length(whole) - 2))


def _json(field: T.DataType, value: Column) -> Column:
    if isinstance(field, T.StringType):
        return json_text(value)
    if isinstance(field, T.BooleanType | T.IntegralType):
        return F.coalesce(value.cast("string"), F.lit("null"))
    if isinstance(field, T.DoubleType | T.FloatType):
        return F.when(value.isNull(), F.lit("null")).otherwise(float_text(value.cast("double")))
    if isinstance(field, T.BinaryType):
        return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.sha1(value), F.lit('"')))
    if isinstance(field, T.ArrayType):
        items = F.transform(value, lambda x: _json(field.elementType, x))
        return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    if isinstance(field, T.StructType):
        inner = canonical_json(field, lambda name: value[name])
        return F.when(value.isNull(), F.lit("null")).otherwise(inner)
    raise TypeError(f"{field.simpleString()} has no stable JSON; give an id column")


def float_text(value: Column) -> Column:
    """A double as Python's json writes it: the shortest digits, plain from 1e-4 up to 1e16, else with an exponent.

    The digits are the JVM's, or 16 digits where they are enough (before Java 19 it writes a 17th too many for some).
    Numbers under 1e-300 may keep digits that Python leaves out.
    """
    rounded = F.format_string("%.15e", value)
    java = F.when(rounded.try_cast("double") == value, F.replace(F.upper(rounded), F.lit("+"), F.lit(""))).otherwise(value.cast("string"))
    sign, digits, power = F.regexp_extract(java, "^-", 0), F.regexp_replace(F.regexp_extract(java, r"^-?([0-9]+)\.([0-9]+)", 0), "[-.]", ""), F.regexp_extract(java, r"E(-?[0-9]+)$", 1)
    whole = F.length(F.regexp_extract(java, r"^-?([0-9]+)\.", 1))
    bare = F.regexp_replace(F.regexp_replace(digits, "^0+(?=.)", ""), "(?<=.)0+$", "")
    lead = F.length(digits) - F.length(F.regexp_replace(digits, "^0+(?=.)", ""))
    point = whole - lead + F.coalesce(power.try_cast("int"), F.lit(0))  # the value is 0.bare times ten to this power
    n = F.length(bare)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare))
        .when(point >= n, F.concat(bare, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(bare, F.lit(1), point), F.lit("."), F.substring(bare, point + 1, n)))
    )
    e = point - 1
    mantissa = F.when(n > 1, F.concat(F.substring(bare, 1, 1), F.lit("."), F.substring(bare, F.lit(2), n))).otherwise(bare)
    exponent = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    text = F.when(bare == "0", F.lit("0.0")).when((e >= -4) & (e < 16), plain).otherwise(F.concat(mantissa, exponent))
    special = F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("Infinity")).when(value == float("-inf"), F.lit("-Infinity"))
    return F.coalesce(special, F.concat(sign, text))


def _ordered(schema: T.StructType) -> list[T.StructField]:
    return sorted(schema.fields, key=lambda f: f.name)


def canonical_json(schema: T.StructType, column=F.col) -> Column:
    """A row as JSON with sorted keys and the separators ', ' and ': '; bytes are the hex of their SHA-1."""
    parts = []
    for i, f in enumerate(_ordered(schema)):
        parts += [F.lit((", " if i else "{") + json.dumps(f.name, ensure_ascii=False) + ": "), _json(f.dataType, column(f.name))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _bytes_at(field: T.DataType, value: Column, path: Column) -> Column | None:
    """array of the JSON paths of the bytes in a value, or None where its type has none; path: JSON without the end."""
    none = F.array().cast("array<string>")
    if isinstance(field, T.BinaryType):
        return F.when(value.isNull(), none).otherwise(F.array(F.concat(path, F.lit("]"))))
    if isinstance(field, T.ArrayType):
        if _bytes_at(field.elementType, value, path) is None:
            return None
        inner = F.flatten(F.transform(value, lambda x, i: _bytes_at(field.elementType, x, F.concat(path, F.lit(", "), i.cast("string")))))
        return F.coalesce(inner, none)
    if isinstance(field, T.StructType):
        named = ((f, F.concat(path, F.lit(", " + json.dumps(f.name)))) for f in field.fields)
        found = [x for f, p in named if (x := _bytes_at(f.dataType, value[f.name], p)) is not None]
        return F.when(value.isNull(), none).otherwise(F.concat(*found)) if found else None
    return None


#: A fixed value: what the hashed text of a row with bytes begins with.
BYTES_MARK = "bytes-v1:"


def content_id(df: DataFrame, keys: Sequence[str] | None = None) -> Column:
    """The first 16 hex digits of the SHA-1 of the canonical JSON of the row (or of some of its columns).

    Of a row that holds bytes, at any depth, the hashed text also says where, so no string passes for bytes.
    """
    fields = [f for f in df.schema.fields if keys is None or f.name in keys]
    text = canonical_json(T.StructType(fields))
    found = [x for f in fields if (x := _bytes_at(f.dataType, F.col(f.name), F.lit("[" + json.dumps(f.name)))) is not None]
    if found:
        paths = F.array_sort(F.concat(*found))
        marked = F.concat(F.lit(BYTES_MARK + "["), F.array_join(paths, ", "), F.lit("]\n"), text)
        text = F.when(F.size(paths) > 0, marked).otherwise(text)
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16)


def shard_of(row_id: Column, world: int) -> Column:
    """The shard of an id: the first eight bytes of its SHA-1, big-endian and unsigned, modulo world."""
    check_shard(0, world)
    h = F.sha1(F.encode(row_id, "UTF-8"))
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(half(1), F.lit(world)) * (2**32 % world) + F.pmod(half(9), F.lit(world)), F.lit(world))


def check_shard(rank: int, world: int) -> None:
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (rank, world)):
        raise TypeError(f"a shard is two whole numbers, not {(rank, world)!r}")
    if not 0 <= rank < world:
        raise ValueError(f"a shard's rank is at least 0 and under its world, not {(rank, world)!r}")


def shard_select(df: DataFrame, rank: int, world: int, id_column: str = "id") -> DataFrame:
    check_shard(rank, world)
    return df.where(shard_of(F.col(id_column), world) == rank)


def index_id(index: Column, *parts: str | None) -> Column:
    """'part:part:000000012' from a row's index; unknown parts are left out."""
    return F.concat_ws(":", *[F.lit(p) for p in parts if p is not None], F.format_string("%09d", index))


def path_id(path: Column, root: str | None = None) -> Column:
    """A listed path as id: without its scheme, or relative to a root, outside which it is an error."""
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    if root is None:
        return plain
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base) & (F.length(plain) > len(base)), F.substring(plain, len(base) + 1, 2**31 - 1)).otherwise(F.raise_error(F.concat(F.lit("not under the root: "), plain)))


def with_id(df: DataFrame, id_key: str | None = None, id_keys: Sequence[str] | None = None, id_column: Column | None = None) -> DataFrame:
    """df with a non-empty string `id`: a given expression, a column, or the content."""
    chosen = id_column if id_column is not None else F.col(id_key) if id_key is not None else content_id(df, id_keys)
    chosen = chosen.cast("string")
    return df.withColumn("id", F.when(chosen.isNull() | (chosen == ""), F.raise_error(F.lit("a row id is null or empty"))).otherwise(chosen))


def safe_filename(row_id: Column) -> Column:
    """Whether an id can name a file: not empty, no separator, no leading dot."""
    return F.coalesce((row_id != "") & ~row_id.rlike(r"[/\\]") & ~row_id.startswith("."), F.lit(False))
