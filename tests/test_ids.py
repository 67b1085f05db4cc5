import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import ids


def python_id(row):
    return hashlib.sha1(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def test_golden_id(spark):
    df = spark.createDataFrame([("row 7",)], "text string")
    assert ids.with_id(df).first()["id"] == "0e88386f40ff2287"


def test_content_ids_equal_pythons(spark):
    rows = [
        {"b": 1, "a": 'quote " and \\ and é 日本 😀', "c": True, "d": ["x", None], "e": {"z": 1, "y": "s"}},
        {"b": -(2**60), "a": "line\nbreak\ttab", "c": None, "d": [], "e": {"z": None, "y": ""}},
        {"b": None, "a": None, "c": False, "d": None, "e": None},
    ]
    df = spark.createDataFrame(rows, "b long, a string, c boolean, d array<string>, e struct<z: long, y: string>")
    got = [r["id"] for r in ids.with_id(df).collect()]
    assert got == [python_id(r) for r in rows]


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, -1.5, 12.5, 0.1, 1e-4, 1.5e-5, 123456789.125, 1e15, 1e16, 1.25e22, 3.0e100, 100.0, 0.001, 7e-10, float("nan"), float("inf"), float("-inf"), 9007199254740993.0, 1234567890123456.7])
def test_floats_are_written_as_python_writes_them(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(ids.float_text(F.col("x"))).first()[0] == json.dumps(x)


def python_bytes_id(row):
    """The id of a row with bytes: their SHA-1 in the JSON, and where they are before it."""
    paths = []

    def plain(value, path):
        if isinstance(value, dict):
            return {k: plain(v, [*path, k]) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v, [*path, i]) for i, v in enumerate(value)]
        if isinstance(value, bytes):
            paths.append(path)
            return hashlib.sha1(value).hexdigest()
        return value

    body = json.dumps(plain(row, []), sort_keys=True, ensure_ascii=False)
    text = "bytes-v1:" + json.dumps(sorted(paths, key=json.dumps)) + "\n" + body if paths else body
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def test_ids_of_rows_with_bytes(spark):
    rows = [{"image": b"\x00\xff", "n": 1.5, "more": [b"a", None, b"b"], "in": {"z": b"", "y": "s"}}, {"image": None, "n": None, "more": None, "in": None}, {"image": b"", "n": 2.0, "more": [], "in": {"z": None, "y": hashlib.sha1(b"").hexdigest()}}]
    got = [r["id"] for r in ids.with_id(spark.createDataFrame(rows, "image binary, n double, more array<binary>, in struct<z: binary, y: string>")).collect()]
    assert got == [python_bytes_id(r) for r in rows]
    hexed = {**rows[0], "image": hashlib.sha1(rows[0]["image"]).hexdigest()}
    assert ids.with_id(spark.createDataFrame([hexed], "image string, n double, more array<binary>, in struct<z: binary, y: string>")).first()["id"] == python_bytes_id(hexed) != got[0]


def test_shard_is_the_unsigned_hash_prefix(spark):
    names = [f"id-{i}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "id string")
    for world in (1, 3, 7, 1000):
        got = {r[0]: r[1] for r in df.select("id", ids.shard_of(F.col("id"), world)).collect()}
        assert got == {n: int.from_bytes(hashlib.sha1(n.encode()).digest()[:8], "big") % world for n in names}


@pytest.mark.parametrize(("rank", "world", "error"), [(0, 0, ValueError), (3, 3, ValueError), (-1, 2, ValueError), (True, 2, TypeError), (0.0, 2, TypeError)])
def test_bad_shards(rank, world, error):
    with pytest.raises(error):
        ids.check_shard(rank, world)


def test_empty_ids_are_refused(spark):
    df = spark.createDataFrame([("",)], "k string")
    with pytest.raises(PySparkException):
        ids.with_id(df, id_key="k").collect()


def test_paths(spark):
    df = spark.createDataFrame([("s3://b/scans/v1/p.png",)], "p string")
    assert df.select(ids.path_id(F.col("p"))).first()[0] == "b/scans/v1/p.png"
    assert df.select(ids.path_id(F.col("p"), "b/scans/")).first()[0] == "v1/p.png"
    with pytest.raises(PySparkException):
        df.select(ids.path_id(F.col("p"), "other")).collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=20), min_size=1, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["id"] for r in ids.with_id(df).collect()] == [python_id({"text": t}) for t in texts]
