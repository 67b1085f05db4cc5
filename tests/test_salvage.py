"""Types of undeclared records: rounds of joins against going through the rows one by one."""

import json
import random

import pytest
from pyspark.sql import types as T

from millrace.operators import salvage


def one_by_one(rows, pins=()):
    """The positions of demoted rows: first typed value wins, then fractions that some whole number does not fit."""
    pins, owner, kept, gone = dict(pins), {}, [], set()
    number = lambda k: "number" if k in salvage.NUMBERS else k
    for pos, text in rows:
        found = salvage.row_kinds(text)
        fits = all(k != "unstorable" for _, k, _ in found)
        for path, k, inexact in found:
            if path in pins:
                fits &= number(k) == number(pins[path]) and not (k == "fraction" and pins[path] == "whole") and not (inexact and pins[path] == "fraction")
        fits = fits and all(owner.get(path, number(k)) == number(k) for path, k, _ in found)
        if fits:
            kept.append((pos, found))
            for path, k, _ in found:
                owner.setdefault(path, number(k))
        else:
            gone.add(pos)
    while True:
        fractional = {path for _, found in kept for path, k, _ in found if k == "fraction"}
        bad = next((pos for pos, found in kept if any(k == "whole" and x and path in fractional for path, k, x in found)), None)
        if bad is None:
            return gone
        kept = [x for x in kept if x[0] != bad]
        gone.add(bad)


@pytest.mark.parametrize(
    ("records", "demoted"),
    [
        (['{"a":1}', '{"a":"x"}', '{"a":2}'], {1}),
        (['{"a":"x","b":1}', '{"a":1,"b":"t"}', '{"b":2}'], {1}),
        (['{"a":1}', '{"a":"x","c":1}', '{"c":"t"}'], {1}),
        (['{"a":9007199254740993}', '{"a":0.5}'], {0}),
        (['{"a":9007199254740993}', '{"a":0.5,"b":"x"}', '{"b":1}'], {0, 2}),
        (['{"a":9007199254740993,"b":0.5}', '{"a":0.5,"b":9007199254740993}'], {0}),
        (['{"a":null}', '{"a":[]}', '{"a":{}}', '{"a":"x"}'], set()),
        (['{"a":{"b":{}}}', '{"a":{"b":1}}', '{"a":[{}]}'], {0, 2}),
        (['{"a":{"b":1}}', '{"a":{"b":0.5,"c":[1]}}', '{"a":{"c":["x"]}}', '{"a":3}'], {2, 3}),
        (['{"a":[1,"x"]}', '[1]', 'no json', None, '{"a":[1,0.5]}'], {0, 1, 2, 3}),
        ([], set()),
    ],
)
def test_golden_cases(spark, records, demoted):
    rows = list(enumerate(records))
    got = salvage.salvaged(spark.createDataFrame(rows, "pos long, out string")).collect()
    assert {r.pos for r in got if r.error is not None} == demoted == one_by_one(rows)
    assert all((r.out is None) == (r.error is not None) for r in got)


def test_random_records_against_one_by_one(spark):
    dice = random.Random(5)
    values = [1, 2, 0.5, 2**53 + 1, 2**60 + 1, "x", True, [1], [0.5], ["x"], {"k": 1}, {"k": "x"}, None, {}]
    for n in (12, 40):
        rows = [(i, json.dumps({k: dice.choice(values) for k in dice.sample("abcdef", dice.randint(1, 4))})) for i in range(n)]
        got = salvage.demoted_rows(salvage.typed_values(spark.createDataFrame(rows, "pos long, out string")))
        assert {r.pos for r in got.collect()} == one_by_one(rows)


def test_types_of_stored_parts_come_first(spark):
    stored = T._parse_datatype_string("id string, error string, a long, b double, o struct<k:string>")
    rows = list(enumerate(['{"a":0.5}', '{"b":3}', '{"b":9007199254740993}', '{"o":{"k":1}}', '{"new":1}', '{"new":"x"}', '{"o":{"more":1}}']))
    got = salvage.salvaged(spark.createDataFrame(rows, "pos long, out string"), stored)
    assert {r.pos for r in got.where("error is not null").collect()} == {0, 2, 3, 5} == one_by_one(rows, salvage.pinned_kinds(stored))
    kinds = {r.path: r.kind for r in salvage.stored_kinds(got).collect()}
    assert kinds == {'["b"]': "whole", '["new"]': "whole", '["o"]': "object", '["o", "more"]': "whole"}
