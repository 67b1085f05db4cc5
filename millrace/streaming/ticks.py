"""Ticks and runs of failures while attempts are still coming in, with state that a restart takes up again.

Each micro-batch writes what it has changed, under its own number and over what an earlier try of the same batch left;
reading takes the last word on each tick or run.  After any number of restarts the tables equal those of
`operators.telemetry` over all attempts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import telemetry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "lane long, start long, stop long, n long"


class Runs(StatefulProcessor):
    """A lane's run of failures that no success has ended yet; gives each run that has changed, open ones too.

    A batch may bring a lane's attempts in any order, but no attempt from before those of an earlier batch.
    """

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start long, stop long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, stop, n = self.open.get() if self.open.exists() else (None, None, 0)
        changed = []
        for at, failed in sorted((a, f) for part in rows for a, f in zip(part[self.order].tolist(), part["failed"].tolist(), strict=True)):
            if failed:
                start, stop, n = at if n == 0 else start, at, n + 1
                continue
            if n:
                changed.append((key[0], start, stop, n))
            start, stop, n = None, None, 0
        if n:
            changed.append((key[0], start, stop, n))
            self.open.update((start, stop, n))
        else:
            self.open.clear()
        yield pd.DataFrame(changed, columns=["lane", "start", "stop", "n"])

    def close(self) -> None:
        pass


def _keep(changes: DataFrame, folder: str, checkpoint: str, mode: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_ticks(attempts: DataFrame, seconds: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Ticks of a stream of attempts (at, ok, pressure, tokens) as they grow; ends when all that is there is read."""
    return _keep(telemetry.ticks(attempts, seconds), folder, checkpoint, "update")


def keep_runs(attempts: DataFrame, order: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs of failures of a stream of attempts (lane, failed and an order of whole numbers), each lane by its state."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = attempts.select(F.col("lane").cast("long").alias("lane"), F.col(order).cast("long").alias(order), "failed")
    changes = rows.groupBy("lane").transformWithStateInPandas(Runs(order), RUN, "update", "None")
    return _keep(changes, folder, checkpoint, "update")


def _latest(spark: SparkSession, folder: str, keys: list[str], schema: str) -> DataFrame:
    try:
        found = spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    kept = [c for c in found.columns if c not in ("batch", *keys)]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("last")).select(*keys, "last.*")


def kept_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder, ["t"], "t long, ok long, bp long, tokens long")


def kept_runs(spark: SparkSession, folder: str, threshold: int) -> DataFrame:
    return _latest(spark, folder, ["lane", "start"], RUN).where(F.col("n") >= threshold)
