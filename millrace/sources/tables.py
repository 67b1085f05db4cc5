"""Tables as inputs with ids: the limit first, then the shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def table_rows(spark: SparkSession, path: str, *, kind: str = "parquet", columns: Sequence[str] | None = None, id_key: str | None = None, index_parts: Sequence[str] | None = None, limit: int | None = None, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """Rows of a table with id: a column, the content, or the place in the table ('part:part:000000012').

    The place counts the files by name and the rows in them; a limit takes the first input rows, before the shard.
    """
    df = spark.read.format(kind).load(path)
    chosen = list(columns) if columns is not None else df.columns
    if id_key is not None and id_key not in chosen:
        chosen.append(id_key)
    if index_parts is None and limit is None:
        rows = df.select(*chosen)
        rows = ids.with_id(rows, id_key=id_key)
    else:
        placed = df.select(*chosen, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        sizes = df.select(F.col("_metadata.file_name").alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
        ahead = sizes.select("__file", F.coalesce(F.sum("__n").over(_by_file()), F.lit(0)).alias("__ahead"))
        placed = placed.join(ahead, "__file").withColumn("__pos", F.col("__ahead") + F.col("__row"))
        if limit is not None:
            placed = placed.where(F.col("__pos") < max(0, limit))
        index = ids.index_id(F.col("__pos"), *index_parts) if index_parts is not None else None
        rows = ids.with_id(placed, id_key=id_key, id_keys=chosen, id_column=index).drop("__file", "__row", "__ahead", "__pos")
    return ids.shard_select(rows, *shard)


def _by_file():
    from pyspark.sql import Window

    return Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
