import datetime
from itertools import zip_longest

import pytest
from pyspark.sql import types as T

from millrace import schema as s

LONG, DOUBLE, TEXT, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


def struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@pytest.mark.parametrize(("value", "pin", "want"), [(LONG, LONG, LONG), (NULL, TEXT, TEXT), (LONG, DOUBLE, DOUBLE), (DOUBLE, LONG, None), (BOOL, LONG, None), (LONG, TEXT, None), (TEXT, LONG, None), (T.ArrayType(LONG), T.ArrayType(DOUBLE), T.ArrayType(DOUBLE)), (T.ArrayType(LONG), LONG, None), (struct(a=LONG, b=NULL), struct(a=DOUBLE), struct(a=DOUBLE)), (struct(b=TEXT), struct(a=DOUBLE), struct(a=DOUBLE, b=TEXT)), (struct(a=TEXT), struct(a=DOUBLE), None)])
def test_fit(value, pin, want):
    assert s.fit(value, pin) == want


@pytest.mark.parametrize(("value", "kind"), [(2**53 + 1, DOUBLE), (2**40, T.IntegerType()), (0.5, LONG), (2.0, LONG), (True, LONG), ("1", LONG), (1, TEXT), ({"a": 1, "x": 2}, struct(a=LONG))])
def test_values_that_do_not_fit(value, kind):
    with pytest.raises(s.DoesNotFit):
        s.conform(value, kind)


def test_values_that_fit():
    assert s.conform({"a": 1, "b": [1, 2]}, struct(a=DOUBLE, b=T.ArrayType(LONG), c=TEXT)) == {"a": 1.0, "b": [1, 2], "c": None}


def test_undeclared_keys_at_any_depth():
    kind = struct(a=T.ArrayType(struct(b=LONG)), c=struct(d=LONG))
    assert s.undeclared({"a": [{"b": 1, "x": 2}], "c": {"y": 1}, "z": 0}, kind) == ["a[].x", "c.y", "z"]


def test_declared_schema_needs_id_and_error():
    s.check_declared(struct(id=TEXT, error=TEXT, out=LONG))
    with pytest.raises(ValueError):
        s.check_declared(struct(id=TEXT, out=LONG))


# ---- records as batches

OUT = struct(id=TEXT, error=TEXT, n=LONG, x=DOUBLE, b=BOOL, s=struct(a=DOUBLE, l=T.ArrayType(LONG)), raw=T.BinaryType())


def test_records_that_fit_and_others_are_told_apart_in_any_company():
    good = {"n": 1, "x": 2, "b": True, "s": {"a": 1, "l": [1, None]}, "raw": b"x"}
    bad = [
        {"n": 1.0}, {"n": True}, {"n": "1"}, {"n": 2**63}, {"x": 2**53 + 1}, {"x": False}, {"b": 1}, {"s": [1]}, {"s": {"a": 1, "z": 0}}, {"s": {"l": [1, 0.5]}},
        {"s": {"l": [1, True]}}, {"s": {"a": {}}}, {"raw": "text"}, {"n": datetime.date(2020, 1, 1)}, {"other": 1}, {"n": object()}, {"x": 2**60},
    ]
    fine = [good, {}, {"s": {}}, {"s": {"l": []}}, {"s": None, "x": 0.5}, {"x": 2**53}]
    records = [r for pair in zip_longest(bad, fine * 3, fillvalue=good) for r in pair]
    rows = s.Storing(OUT).batch([{**r, "id": str(i), "error": None} for i, r in enumerate(records)]).to_pylist()
    assert [r["id"] for r in rows] == [str(i) for i in range(len(records))]
    for r, row in zip(records, rows, strict=True):
        alone = s.Storing(OUT).batch([{**r, "id": row["id"], "error": None}]).to_pylist()[0]
        assert row == alone and (row["error"] is not None) == any(r is x for x in bad), r
        assert row["error"] is None or row["error"].startswith("parse output not storable: ") and row["n"] is None
    assert rows[1] == {"id": "1", "error": None, "n": 1, "x": 2.0, "b": True, "s": {"a": 1.0, "l": [1, None]}, "raw": b"x"}


def test_undeclared_keys_are_named():
    row = s.Storing(OUT).batch([{"id": "1", "error": None, "s": {"z": {"y": 1}}}]).to_pylist()[0]
    assert row["error"] == "parse output not storable: undeclared keys: s.z"
    assert s.Storing(OUT).batch([]).num_rows == 0
