"""Files as inputs, ordered look-ahead, late decoding, and stored parts that can't be read."""

import base64
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from millrace.functions import ids
from millrace.plans.ahead import in_order, prepare_ahead
from millrace.sources import files, output, reader


def test_results_are_in_order_and_few_are_ahead():
    begun, drawn, most, lock = 0, 0, 0, threading.Lock()

    def items():
        nonlocal drawn
        for i in range(40):
            drawn += 1
            yield i

    def work(i):
        nonlocal begun
        with lock:
            begun += 1
        time.sleep(0.02 if i % 5 == 0 else 0.001)
        return None if i == 7 else i * i

    out = []
    for i, x in enumerate(in_order(items(), work, 4)):
        most = max(most, drawn - i)
        out.append(x)
    assert out == [None if i == 7 else i * i for i in range(40)] and most <= 5 and begun == 40


def test_an_exception_stands_in_its_place():
    def work(i):
        if i == 5:
            raise KeyError("five")
        return i

    def source():
        yield from range(3)
        raise OSError("gone")

    got = []
    with pytest.raises(KeyError, match="five"):
        got.extend(in_order(range(10), work, 3))
    assert list(in_order(range(3), work, 3)) == [0, 1, 2]
    seen, calls = [], in_order(source(), work, 8)
    with pytest.raises(OSError, match="gone"):
        for x in calls:
            seen.append(x)
    assert seen == [0, 1, 2]


def test_prepared_rows(spark):
    rows = spark.createDataFrame([(i, {"a": i}, [i, None]) for i in range(50)], "n long, m map<string,int>, xs array<int>")
    got = prepare_ahead(rows, lambda r: None if r["n"] == 3 else {"n": r["n"], "s": r["m"]["a"] + (r["xs"][0] or 0)}, "n long, s long", 3).collect()
    assert {r.n: r.s for r in got} == {None: None, **{i: 2 * i for i in range(50) if i != 3}}
    with pytest.raises(ValueError, match="prepare_ahead: ahead"):
        prepare_ahead(rows, dict, "n long", 0)


@pytest.fixture
def folder(tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02d}.bin").write_bytes(b"x" * (50 if i == 4 else 5))
    return tmp_path


def test_files_left_out_are_never_opened(spark, folder):
    """With a reader that may read 10 bytes at most, Spark itself would fail on the file of 50."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    opened = spark.sparkContext.accumulator(0)

    def read(path):
        opened.add(1)
        return files.fetch(path)

    try:
        known = spark.createDataFrame([("f04.bin", "x")], "id string, more string")
        pattern, root = f"{folder}/*.bin", str(folder)
        assert {r.id for r in files.file_rows(spark, pattern, root=root, known=known).collect()} == {f"f{i:02d}.bin" for i in range(12) if i != 4}
        assert [r.id for r in files.file_rows(spark, pattern, root=root, limit=2).orderBy("id").collect()] == ["f00.bin", "f01.bin"]
        assert files.file_rows(spark, pattern, root=root, limit=-1).count() == 0
        shards = [files.file_rows(spark, pattern, root=root, shard=(k, 3)).collect() for k in range(3)]
        assert sorted(r.id for s in shards for r in s) == [f"f{i:02d}.bin" for i in range(12)]
        rest = files.file_rows(spark, pattern, root=root, read=False, known=known, shard=(1, 3)).orderBy("id")
        want = [r.id for r in rest.collect()]
        assert [r.id for r in files.fetched(rest, 2, read).collect()] == want and 0 < len(want) < 12
        assert opened.value == len(want)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_content_is_in_no_shuffle(spark, folder):
    known = spark.createDataFrame([("f01.bin",)], "id string")
    plan = files.file_rows(spark, f"{folder}/*.bin", root=str(folder), known=known, limit=5)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow", 1)[1].split("\n", 1)[1]
    assert "content#" not in below and plan.count("MapInArrow") == 1


def test_a_file_that_is_gone_ends_the_job_at_its_place(spark, folder):
    rows = files.file_rows(spark, f"{folder}/*.bin", root=str(folder), read=False)
    gone = rows.select("id", "path", "length").union(spark.createDataFrame([("no", f"{folder}/none.bin", 1)], rows.schema))
    with pytest.raises(Exception, match="none.bin"):
        files.fetched(gone).collect()


def gray(width, height, step=1):
    return b"P5\n# made here\n%d %d\n255\n" % (width, height) + bytes((x * step + y) % 256 for y in range(height) for x in range(width))


def test_only_the_shards_images_are_decoded(spark):
    decoded = spark.sparkContext.accumulator(0)
    images = spark.createDataFrame([(f"im{i}", gray(9, 6)) for i in range(40)], "id string, content binary").repartition(5)

    def decode(row):
        decoded.add(1)
        return {"id": row["id"], "n": len(files.gray_image(row["content"])[2])}

    got = files.decoded_late(images, decode, "id string, n int", (1, 4)).where("id <> 'im3'").collect()
    mine = ids.shard_select(images, 1, 4).count()
    assert 0 < mine < 40 and decoded.value == mine and {r.n for r in got} == {54}


def test_images_are_halved_until_they_fit(spark):
    images = spark.createDataFrame([("a", gray(9, 5)), ("b", gray(2, 2))], "id string, content binary")
    got = {r.id: r for r in files.image_rows(images, 4).collect()}
    assert (got["a"].width, got["a"].height, got["b"].width) == (4, 2, 2)
    said = base64.b64decode(got["a"].uri.split(",")[1])
    assert files.gray_image(said) == (4, 2, bytes([0, 2, 4, 6, 2, 4, 6, 8]))
    for bad in (b"", b"P5\n2 2\n255\nabc", b"P6\n1 1\n255\nabc", b"P5 # no end"):
        with pytest.raises(ValueError):
            files.gray_image(bad)


# ---- parts that can't be read

KIND = pa.schema([("id", pa.string()), ("error", pa.string()), ("n", pa.int64())])


def part(folder, name, n, kind=KIND):
    pq.write_table(pa.Table.from_pylist([{"id": f"{name}{i}", "error": None, "n": i} for i in range(n)], kind), folder / f"part-{name}.parquet")


def test_lines_that_break_are_tried_again_and_broken_bytes_are_not(tmp_path, monkeypatch):
    part(tmp_path, "a", 3)
    (tmp_path / "part-b.parquet").write_bytes(b"PAR1 not parquet")
    tries, pauses, real = [], [], reader.filesystem

    class Flaky:
        def open_input_file(self, place):
            tries.append(place)
            if len(tries) < 3:
                raise OSError("line broke")
            return real(place)[0].open_input_file(place)

    monkeypatch.setattr(reader, "filesystem", lambda path: (Flaky(), path))
    assert reader.read_file(str(tmp_path / "part-a.parquet"), ["id"], pauses.append).num_rows == 3
    assert len(tries) == 3 and pauses == [0.5, 1.0]
    with pytest.raises(pa.ArrowInvalid):
        reader.read_file(str(tmp_path / "part-b.parquet"), ["id"], pauses.append)
    assert len(tries) == 4 and len(pauses) == 2
    tries.clear()
    monkeypatch.setattr(Flaky, "open_input_file", lambda self, place: (tries.append(1), exec("raise OSError('down')")))
    with pytest.raises(OSError, match="down"):
        reader.read_file("x", ["id"], pauses.append)
    assert len(tries) == 3


def test_unreadable_parts_are_named(spark, tmp_path):
    part(tmp_path, "a", 3)
    part(tmp_path, "b", 2)
    (tmp_path / "part-c.parquet").write_bytes(b"not parquet")
    (tmp_path / ".part-d.parquet").write_bytes(b"hidden")
    assert sorted(r.id for r in output.id_errors(spark, str(tmp_path)).collect()) == ["a0", "a1", "a2", "b0", "b1"]
    faults = reader.unreadable(spark, str(tmp_path)).collect()
    assert [r.name for r in faults] == ["part-c.parquet"] and faults[0].fault.startswith("ArrowInvalid")
    assert output.id_errors(spark, str(tmp_path / "none")).count() == 0 and not (tmp_path / "none").exists()


def test_the_newest_readable_footer_says_the_types(tmp_path, monkeypatch):
    assert reader.newest_schema(str(tmp_path / "none")) is None
    part(tmp_path, "1", 1)
    part(tmp_path, "2", 1, KIND.append(pa.field("more", pa.float64())))
    (tmp_path / "part-3.parquet").write_bytes(b"PAR1 cut off")
    monkeypatch.setattr(reader.pq.ParquetFile, "read_row_group", None)
    monkeypatch.setattr(reader.pq, "read_table", None)
    assert reader.newest_schema(str(tmp_path)) == T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("error", T.StringType()), ("n", T.LongType()), ("more", T.DoubleType()))])
    (tmp_path / "part-2.parquet").write_bytes(b"PAR1")
    assert reader.newest_schema(str(tmp_path)).fieldNames() == ["id", "error", "n"]
    (tmp_path / "part-1.parquet").unlink()
    assert reader.newest_schema(str(tmp_path)) is None
