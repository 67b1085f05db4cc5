"""Where a run's records go: durable parts, one file per success, or a sink of the user's own."""

from __future__ import annotations

import os
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from itertools import islice
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import output
from .output import PartWriter
from .telemetry import TickLog


class NothingFits(RuntimeError):
    """None of a task's first records could be stored: the sink is set up wrongly."""


class Rows(ABC):
    """The writer of one task: `add` gives the (id, error) of each record as it was stored or refused."""

    @abstractmethod
    def add(self, records: list[dict]) -> list[tuple[str, str | None]]: ...

    def add_batch(self, records: pa.RecordBatch) -> tuple[int, int]:
        """How many of some records were stored, and how many not: as plain dicts, unless a sink takes batches."""
        errors = [error for _, error in self.add(records.to_pylist())] if records.num_rows else []
        failed = sum(e is not None for e in errors)
        return len(errors) - failed, failed

    def due(self) -> None:
        """Called while nothing ends, so that what is held does not grow old."""

    def close(self) -> None:
        """All records of the task are given."""


class Sink(ABC):
    """What a run needs of an output; it travels to the tasks."""

    @abstractmethod
    def known(self, spark: SparkSession) -> DataFrame:
        """(id, error) of what is stored already; must not create the output."""

    @abstractmethod
    def rows(self, schema: T.StructType) -> Rows: ...

    def ticks(self, shard: int) -> TickLog | None:
        """Where a task's ticks go, if anywhere."""
        return None

    def finish(self, name: str, stats: dict) -> None:
        """The run has ended well."""

    def ask_to_stop(self, name: str) -> bool:
        """Leave word for a run's tasks that they should stop; whether that is possible."""
        return False

    def stop_asked(self, name: str) -> bool:
        """Whether a run's tasks should stop; tasks ask every few seconds."""
        return False


class _Parts(Rows):
    def __init__(self, sink: PartsSink, schema: T.StructType):
        self.kind = to_arrow_schema(schema)
        self.out = PartWriter(sink.path, sink.flush_rows, sink.flush_s)

    def add(self, records: list[dict]) -> list[tuple[str, str | None]]:
        if records:
            self.out.add(pa.RecordBatch.from_pylist(records, self.kind))
        return [(r["id"], r["error"]) for r in records]

    def add_batch(self, records: pa.RecordBatch) -> tuple[int, int]:
        self.out.add(records)
        ok = records.column("error").null_count
        return ok, records.num_rows - ok

    def due(self) -> None:
        self.out.flush_due()

    def close(self) -> None:
        self.out.flush()


class PartsSink(Sink):
    """Parquet parts with manifests (sources/output)."""

    def __init__(self, path: str, flush_rows: int = 1000, flush_s: float | None = None):
        self.path, self.flush_rows = path, flush_rows
        local = "://" not in path or path.startswith("file:")
        self.flush_s = flush_s if flush_s is not None else 10.0 if local else 60.0

    def known(self, spark: SparkSession) -> DataFrame:
        return output.id_errors(spark, self.path)

    def rows(self, schema: T.StructType) -> Rows:
        return _Parts(self, schema)

    def ticks(self, shard: int) -> TickLog:
        return TickLog(self.path, shard)

    def finish(self, name: str, stats: dict) -> None:
        output.finish(self.path, name, stats)

    def ask_to_stop(self, name: str) -> bool:
        output.write_marker(self.path, f"{name}.stop", b"")
        return True

    def stop_asked(self, name: str) -> bool:
        return output.has_marker(self.path, f"{name}.stop")


class _Files(Rows):
    FIRST = 32

    def __init__(self, sink: FilesSink):
        self.sink, self.refused, self.fitted = sink, 0, False

    def _reason(self, record: dict) -> str | None:
        name = str(record["id"])
        if not name or any(c in name for c in "/\\") or name.startswith("."):
            return f"id {name!r} is not a safe filename"
        return f"no {self.sink.key!r} value" if record.get(self.sink.key) is None else None

    def add(self, records: list[dict]) -> list[tuple[str, str | None]]:
        out = []
        for r in records:
            error = r["error"]
            if error is None:
                reason = self._reason(r)
                if reason is None:
                    self.fitted = True
                    self._put(r)
                else:
                    error, self.refused = f"not written: {reason}", self.refused + 1
                    if not self.fitted and self.refused >= self.FIRST:
                        raise NothingFits(f"the first {self.FIRST} records were not written; the last: {reason}")
            out.append((r["id"], error))
        return out

    def _put(self, record: dict) -> None:
        folder, value = self.sink.folder, record[self.sink.key]
        hidden = f"{folder}/.{record['id']}.{uuid.uuid4().hex[:8]}.tmp"
        with open(hidden, "wb") as f:
            f.write(bytes(value) if isinstance(value, bytes | bytearray) else str(value).encode())
        os.replace(hidden, f"{folder}/{record['id']}{self.sink.ending}")


class FilesSink(Sink):
    """A file per success, named after its id, in a folder that all tasks share; failures leave none and run again."""

    def __init__(self, folder: str, ending: str = ".txt", key: str = "text"):
        if "://" in str(folder):
            raise ValueError(f"files go to a folder, not to {folder!r}")
        if not ending.startswith(".") or "/" in ending or ".." in ending:
            raise ValueError(f"unsafe ending {ending!r}")
        self.folder, self.ending, self.key = str(folder), ending, key

    def known(self, spark: SparkSession) -> DataFrame:
        """The ids that have a file.  Names are read by the file system, so an id is whatever its file is called."""
        if not os.path.isdir(self.folder):
            return spark.createDataFrame([], "id string, error string")
        ending, folder = self.ending, self.folder

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                with os.scandir(folder) as found:
                    names = (x.name for x in found if x.name.endswith(ending) and not x.name.startswith("."))
                    while part := list(islice(names, 10_000)):
                        yield pa.RecordBatch.from_pydict({"id": [n[: -len(ending)] for n in part]})

        # one task reads the folder: a folder can't be listed in parts
        return spark.range(1, numPartitions=1).mapInArrow(listed, "id string").select("id", F.lit(None).cast("string").alias("error"))

    def rows(self, schema: T.StructType) -> Rows:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        return _Files(self)


def as_sink(target: Any, flush_rows: int | None = None) -> Sink:
    """A path is a folder of parts; a Sink is itself, and then has settings of its own."""
    if isinstance(target, str | os.PathLike):
        return PartsSink(str(target), flush_rows or 1000)
    if not isinstance(target, Sink):
        raise TypeError(f"{type(target).__name__} is neither a path nor a Sink")
    if flush_rows is not None:
        raise ValueError("flush_rows is for a path; a Sink has settings of its own")
    return target
