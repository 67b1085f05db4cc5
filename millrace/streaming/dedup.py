"""Exactly-once admission of a growing input: ids seen before, in any batch, are dropped.

No watermark: an id stays known for good, which is what a resumable run promises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids
from ..sources import output


def admitted(stream: DataFrame, id_key: str | None = None) -> DataFrame:
    rows = stream if "id" in stream.columns else ids.with_id(stream, id_key=id_key)
    return rows.dropDuplicates(["id"])


def ingest(spark: SparkSession, source: str, schema, path: str, checkpoint: str, id_key: str | None = None) -> StreamingQuery:
    """Append what a folder of Parquet has gained to durable parts, as successes; ends when all is read."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        output.append(batch.selectExpr("*", "cast(null as string) as error"), path)

    return admitted(stream, id_key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
