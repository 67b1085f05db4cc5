"""Which values fit which stored types, and which keys a declared schema leaves out; small helpers on Spark types.

A stored column keeps its type: a value fits if it is of the same kind and the cast loses nothing.  Whole numbers
may enter fractional columns, never the other way round; booleans, numbers and text never cross.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_KINDS = (
    ("bool", T.BooleanType),
    ("int", T.IntegralType),
    ("float", T.FractionalType),
    ("text", T.StringType),
    ("bytes", T.BinaryType),
    ("time", (T.TimestampType, T.TimestampNTZType)),
    ("date", T.DateType),
    ("list", T.ArrayType),
    ("struct", T.StructType),
)


class DoesNotFit(ValueError):
    """A value that the stored type cannot hold without loss."""


def kind(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return "decimal"
    return next((name for name, classes in _KINDS if isinstance(t, classes)), t.simpleString())


def fit(value: T.DataType, pinned: T.DataType) -> T.DataType | None:
    """The stored type after a value of another type: the pin, the pin with new struct fields, or None (a conflict)."""
    if value == pinned or isinstance(value, T.NullType):
        return pinned
    if isinstance(value, T.ArrayType) and isinstance(pinned, T.ArrayType):
        item = fit(value.elementType, pinned.elementType)
        return None if item is None else T.ArrayType(item)
    if isinstance(value, T.StructType) and isinstance(pinned, T.StructType):
        fields = {f.name: f.dataType for f in pinned.fields}
        for f in value.fields:
            if isinstance(f.dataType, T.NullType):
                continue
            target = fit(f.dataType, fields[f.name]) if f.name in fields else f.dataType
            if target is None:
                return None
            fields[f.name] = target
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    pair = (kind(value), kind(pinned))
    return pinned if pair[0] == pair[1] or pair == ("int", "float") else None


def is_untyped(t: pa.DataType) -> bool:
    """Whether values of a type say nothing about it: nulls, lists of nothing, objects without fields."""
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return is_untyped(t.value_type)
    return pa.types.is_null(t) or pa.types.is_struct(t) and t.num_fields == 0


_ALIKE = (
    (pa.types.is_boolean,),
    (pa.types.is_integer, pa.types.is_floating),
    (pa.types.is_string, pa.types.is_large_string),
    (pa.types.is_binary, pa.types.is_large_binary, pa.types.is_fixed_size_binary),
    (pa.types.is_decimal,),
    (pa.types.is_timestamp,),
    (pa.types.is_date,),
    (pa.types.is_time,),
    (pa.types.is_duration,),
)


def _alike(value: pa.DataType, stored: pa.DataType) -> bool:
    group = next((tests for tests in _ALIKE if any(t(value) for t in tests)), ())
    return any(t(stored) for t in group) and not (pa.types.is_floating(value) and pa.types.is_integer(stored))


def stored_as(values: pa.Array, target: pa.DataType, at: str) -> pa.Array:
    """An Arrow column as the stored type holds it; DoesNotFit if that would lose or change anything."""
    kind = values.type
    if kind == target:
        return values
    if is_untyped(kind):
        return pa.nulls(len(values), target)
    if pa.types.is_struct(kind) and pa.types.is_struct(target):
        held = dict(zip((f.name for f in kind), values.flatten(), strict=True))
        extra = sorted(held.keys() - {f.name for f in target})
        if extra:
            raise DoesNotFit("undeclared keys: " + ", ".join(f"{at}.{k}" for k in extra))
        made = [stored_as(held[f.name], f.type, f"{at}.{f.name}") if f.name in held else pa.nulls(len(values), f.type) for f in target]
        return pa.StructArray.from_arrays(made, fields=list(target), mask=values.is_null())
    if pa.types.is_list(kind) and pa.types.is_list(target):
        items = stored_as(values.flatten(), target.value_type, f"{at}[]")
        lengths = values.value_lengths().fill_null(0).to_pylist()
        offsets = [0]
        for n in lengths:
            offsets.append(offsets[-1] + n)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=target, mask=values.is_null())
    if not _alike(kind, target):
        raise DoesNotFit(f"{at}: {kind} is no {target}")
    try:
        return values.cast(target, safe=True)
    except pa.ArrowInvalid as e:
        raise DoesNotFit(f"{at}: {e}") from None


def _uniform(values: Sequence[Any], at: str, inner: bool = False) -> None:
    """DoesNotFit unless all values at each place are of one Python type, or whole and fractional numbers, or null.

    Arrow would join others without a word (True and 0.5, a date and 3).  Nor may an object within a value be empty:
    no file can tell it from null.
    """
    kinds = set(map(type, values)) - {type(None)}
    if kinds <= {int, float}:
        return
    if kinds <= {list, tuple}:
        _uniform([x for v in values if v is not None for x in v], f"{at}[]", True)
    elif len(kinds) > 1:
        raise DoesNotFit(f"{at}: values of several kinds: {', '.join(sorted(k.__name__ for k in kinds))}")
    elif kinds == {dict}:
        held = [v for v in values if v is not None]
        if inner and not all(held):
            raise DoesNotFit(f"{at}: an object without fields can't be stored")
        for key in dict.fromkeys(k for v in held for k in v):
            _uniform([v[key] for v in held if key in v], f"{at}.{key}", True)


class Storing:
    """Records as batches of a declared schema; a record that does not fit becomes an error row.

    A batch is built and cast column by column.  Only a batch that fails is halved until the records at fault are alone.
    """

    def __init__(self, schema: T.StructType):
        self.kind = to_arrow_schema(schema)

    def _columns(self, records: Sequence[dict]) -> pa.RecordBatch:
        extra = sorted({k for r in records for k in r if k not in self.kind.names})
        if extra:
            raise DoesNotFit(f"undeclared keys: {', '.join(map(str, extra))}")
        columns = {f.name: [None if (v := r.get(f.name)) == {} and isinstance(v, dict) else v for r in records] for f in self.kind}
        for name, values in columns.items():
            _uniform(values, name)
        try:
            made = [pa.array(values) for values in columns.values()]
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
            raise DoesNotFit(str(e)) from None
        return pa.RecordBatch.from_arrays([stored_as(x, f.type, f.name) for x, f in zip(made, self.kind, strict=True)], schema=self.kind)

    def _pieces(self, records: Sequence[dict]) -> Iterator[pa.RecordBatch]:
        try:
            yield self._columns(records)
        except DoesNotFit as e:
            if len(records) == 1:
                yield pa.RecordBatch.from_pylist([{"id": records[0]["id"], "error": f"parse output not storable: {e}"}], self.kind)
            else:
                yield from self._pieces(records[: len(records) // 2])
                yield from self._pieces(records[len(records) // 2 :])

    def batch(self, records: Sequence[dict]) -> pa.RecordBatch:
        if not records:
            return pa.RecordBatch.from_pylist([], self.kind)
        return pa.concat_batches(list(self._pieces(records)))


def conform(value: Any, t: T.DataType) -> Any:
    """One value as a declared type holds it; DoesNotFit if that would lose or change anything."""
    row = Storing(T.StructType([T.StructField("value", t)]))._columns([{"value": value}])
    return row.column(0)[0].as_py()


def undeclared(value: Any, t: T.DataType, at: str = "") -> list[str]:
    """Dotted paths of keys, at any depth and inside lists, that a declared type doesn't have; sorted."""
    out: set[str] = set()
    if isinstance(value, dict) and isinstance(t, T.StructType):
        types = {f.name: f.dataType for f in t.fields}
        for k, v in value.items():
            path = f"{at}.{k}" if at else str(k)
            out |= set(undeclared(v, types[k], path)) if k in types else {path}
    elif isinstance(value, list | tuple) and isinstance(t, T.ArrayType):
        for v in value:
            out |= set(undeclared(v, t.elementType, f"{at}[]"))
    return sorted(out)


def check_declared(schema: T.StructType) -> None:
    """A declared output schema has id and error as text, and every other column nullable."""
    fields = {f.name: f for f in schema.fields}
    for name in ("id", "error"):
        if name not in fields or not isinstance(fields[name].dataType, T.StringType):
            raise ValueError(f"the output schema must have {name} as a string")
    if not all(f.nullable for f in schema.fields if f.name != "id"):
        raise ValueError("every column of the output schema but id must be nullable")
