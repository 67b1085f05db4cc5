"""Ticks of a run on disk: JSON lines in a run's folder, written whole at growing intervals, read as a table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .output import SIDE, filesystem

# The keys of a tick and their types.
TICK = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("t", "tok_s", "kv", "hits", "latency_s", "source_s", "prep_s", "sink_s", "loop_lag_s")]
    + [T.StructField(n, T.LongType()) for n in ("limit", "inflight", "waiting", "running", "bp", "ok", "retries", "preempts", "prep_n", "prep_workers", "requests")]
    + [T.StructField(n, T.BooleanType()) for n in ("input_bound", "queues")]
    + [T.StructField(n, T.StringType()) for n in ("reason", "bound_by", "engine")]
)
#: Ticks between two writes at least, by whether the output is local; and the share of the ticks so far.
EVERY, SHARE = {True: 30, False: 150}, 4


class TickLog:
    """A task's ticks; `note` adds one and writes the whole file when it is time to."""

    def __init__(self, path: str, shard: int = 0):
        self.folder, self.name = f"{path}/{SIDE}/telemetry", f"telemetry-shard{shard}-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}.jsonl"
        self.local, self.ticks, self.due = "://" not in path or path.startswith("file:"), [], EVERY[True]
        self.due = EVERY[self.local]

    def note(self, tick: dict) -> None:
        self.ticks.append(tick)
        if len(self.ticks) >= self.due:
            self.write()
            self.due = len(self.ticks) + max(EVERY[self.local], len(self.ticks) // SHARE)

    def write(self) -> None:
        if not self.ticks:
            return
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/.{self.name}") as out:
            out.write("".join(json.dumps(t) + "\n" for t in self.ticks).encode())
        fs.move(f"{root}/.{self.name}", f"{root}/{self.name}")


def write_ticks(of: DataFrame, path: str) -> None:
    """Ticks (some of a tick's keys) that are a table already, as the files of a run: one of each task, by its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = TickLog(path)
        for batch in batches:
            for tick in batch.to_pylist():
                log.note(tick)
        log.write()
        yield pa.RecordBatch.from_pydict({"n": [len(log.ticks)]})

    of.mapInArrow(run, "n long").agg(F.sum("n")).first()


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The ticks of all runs and tasks of an output, with the file they stand in; of the old layout, at its root, too."""
    found = spark.createDataFrame([], T.StructType([*TICK.fields, T.StructField("file", T.StringType())]))
    for folder in (f"{path}/{SIDE}/telemetry", path):
        try:
            ticks = spark.read.schema(TICK).option("pathGlobFilter", "telemetry-*.jsonl").json(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = found.unionByName(ticks.selectExpr("*", "_metadata.file_name as file"))
    return found
