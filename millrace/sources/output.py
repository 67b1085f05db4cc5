"""Durable output: parts that are published one by one, each with a manifest of its ids.

Spark's committers publish at the end of a job; here a part counts as soon as its task has renamed it, so a run that
is killed keeps what it finished.  Layout: `part-{ms}-{seq}-{uuid}.parquet` beside `__millrace/manifest/ids-part-*`
(Spark skips folders that begin with an underscore) and `__millrace/runs/*.done`, written last.
"""

from __future__ import annotations

import contextlib
import json
import sys
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators import resume
from .reader import filesystem, newest_schema, stored_records

SIDE = "__millrace"
FORMAT = "millrace_parts"


def _publish(path: str, name: str, data: pa.Table, attempts: int = 4, pause: float = 1.0) -> None:
    """Write under a hidden name, then rename; a write that fails is tried again after 1, 2 and 4 seconds."""
    for turn in range(attempts):
        fs, root = filesystem(path)
        hidden = f"{root}/.{name}.{uuid.uuid4().hex[:8]}"
        try:
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(hidden) as out:
                pq.write_table(data, out, compression="zstd")
            fs.move(hidden, f"{root}/{name}")
            return
        except OSError:
            with contextlib.suppress(OSError):
                fs.delete_file(hidden)
            if turn == attempts - 1:
                raise
            time.sleep(pause * 2**turn)


class PartWriter:
    """Collects records in a task and publishes a part when `flush_rows` are held or the oldest is `flush_s` old."""

    def __init__(self, path: str, flush_rows: int = 1000, flush_s: float = 10.0):
        self.path, self.flush_rows, self.flush_s = path, flush_rows, flush_s
        self.held: list[pa.RecordBatch] = []
        self.rows, self.since, self.seq = 0, 0.0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.since = self.since if self.rows else time.monotonic()
            self.held.append(batch)
            self.rows += batch.num_rows
        self.flush_due()

    def flush_due(self) -> None:
        if self.rows >= self.flush_rows or self.rows and time.monotonic() - self.since >= self.flush_s:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        data = pa.Table.from_batches(self.held)
        name = f"part-{int(time.time() * 1000):013d}-{self.seq:06d}-{uuid.uuid4().hex[:8]}.parquet"
        _publish(self.path, name, data)
        try:
            _publish(f"{self.path}/{SIDE}/manifest", f"ids-{name}", data.select(["id", "error"]))
        except OSError as e:  # the part is read where no manifest covers it
            print(f"no manifest of {name}: {e}", file=sys.stderr)
        self.held, self.rows, self.seq = [], 0, self.seq + 1


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, flush_rows: int, flush_s: float):
        self.path, self.flush_rows, self.flush_s = path, flush_rows, flush_s

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        out = PartWriter(self.path, self.flush_rows, self.flush_s)
        for batch in iterator:
            out.add(batch)
        out.flush()
        return WriterCommitMessage()

    def abort(self, messages: list) -> None:
        """Parts that are published stay: they hold finished rows."""


class DurableParts(DataSource):
    """df.write.format("millrace_parts").option("path", ...).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("parts are only appended")
        names = schema.fieldNames()
        if "id" not in names or "error" not in names:
            raise ValueError("records need the columns id and error")
        return _Writer(self.options["path"], int(self.options.get("flush_rows", 1000)), float(self.options.get("flush_s", 10)))


def append(records: DataFrame, path: str, flush_rows: int = 1000) -> None:
    records.sparkSession.dataSource.register(DurableParts)
    records.write.format(FORMAT).option("path", path).option("flush_rows", flush_rows).mode("append").save()


def write_marker(path: str, name: str, content: bytes) -> None:
    """A small file of a run beside its parts."""
    fs, root = filesystem(f"{path}/{SIDE}/runs")
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(content)


def has_marker(path: str, name: str) -> bool:
    fs, place = filesystem(f"{path}/{SIDE}/runs/{name}")
    return fs.get_file_info(place).type == FileType.File


def finish(path: str, name: str, stats: dict) -> None:
    """The marker of a finished run, with its counts; written last."""
    write_marker(path, f"{name}.done", json.dumps(stats).encode())


def parts(spark: SparkSession, path: str) -> DataFrame | None:
    """All records with part and pos, the order in which they were written; files that can't be read are skipped.

    None where there is no part.
    """
    if newest_schema(path) is None:
        return None
    found = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)
    return found.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("pos"))


def id_errors(spark: SparkSession, path: str) -> DataFrame:
    """(id, error) of all records: from the manifests, and from the parts that no readable manifest covers.

    A file that stays unreadable is named on the task's error stream (`reader.unreadable` lists them).
    """
    manifests = stored_records(spark, f"{path}/{SIDE}/manifest").where("fault is null")
    held = stored_records(spark, path).where("fault is null")
    bare = resume.uncovered_parts(held.select("name", "id", "error"), manifests.select("name").distinct())
    return manifests.select("id", "error").union(bare.select("id", "error"))


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """The last success of every id, without id and error: the input of a next stage keeps id."""
    found = parts(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return resume.healed(found)
