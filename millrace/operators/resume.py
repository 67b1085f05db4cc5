"""Resuming a run: which ids are done, which rows are left, and the merge of what several runs wrote.

Stored records are rows (id, error, part, pos, ...): error is null for a success, part and pos order the writes.
Two questions about an error differ on purpose: for resuming, an empty error counts as done; for reading, only a
null error is a success.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_done() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def id_states(records: DataFrame) -> DataFrame:
    """(id, done, failed): whether any record of an id is done, and whether any has failed."""
    return records.groupBy("id").agg(F.bool_or(is_done()).alias("done"), F.bool_or(~is_done()).alias("failed"))


def existing_ids(records: DataFrame, retry_errors: bool = False) -> DataFrame:
    states = id_states(records)
    return (states.where("done") if retry_errors else states).select("id")


def error_only_ids(records: DataFrame) -> DataFrame:
    return id_states(records).where("failed and not done").select("id")


def not_known(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """rows whose key is not among the known ones; nulls are never known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def union_parts(*parts: DataFrame) -> DataFrame:
    """Parts of one output as one table: columns by name, those that a part lacks as nulls."""
    out, *more = parts
    for part in more:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def uncovered_parts(parts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Parts (part-x), by name, that no manifest (ids-part-x) covers; with whatever columns they have."""
    covered = manifests.select(F.regexp_replace("name", "^ids-", "").alias("name"))
    return parts.join(covered, "name", "left_anti")


def first_wins(rows: DataFrame, order: str) -> DataFrame:
    """One row per id, the first by an input position.

    A ranking by id: rows that can't be first leave before the shuffle, and no whole row waits in an aggregate.
    """
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def skip_done(rows: DataFrame, records: DataFrame, order: str, retry_errors: bool = False) -> DataFrame:
    """The rows still to do: those whose id is not there yet, each id once."""
    return first_wins(rows.join(existing_ids(records, retry_errors), "id", "left_anti"), order)


def resume_states(rows: DataFrame, records: DataFrame, retry_errors: bool = False) -> DataFrame:
    """(id, n, skip, errored) of each id of rows: how many rows, whether they are left out, whether they have only failed.

    Only ids pass the join and the shuffle, whatever else the rows hold.
    """
    known = rows.groupBy("id").agg(F.count("*").alias("n")).join(id_states(records), "id", "left")
    skip = F.coalesce(F.col("done"), F.lit(False)) if retry_errors else F.col("done").isNotNull()
    return known.select("id", "n", skip.alias("skip"), F.coalesce(F.col("failed") & ~F.col("done"), F.lit(False)).alias("errored"))


def state_counts(retry_errors: bool = False) -> list[Column]:
    """The counters of a run as aggregates over resume_states: rows_total, rows_done_prior, rows_errored_prior, rows_deduped, rows_to_do."""
    n, s = F.col("n"), F.col("skip")
    return [
        F.sum(n).alias("rows_total"),
        F.sum(F.when(s, n).otherwise(0)).alias("rows_done_prior"),
        F.sum(F.when(s & F.col("errored") & F.lit(not retry_errors), n).otherwise(0)).alias("rows_errored_prior"),
        F.sum(F.when(~s, n - 1).otherwise(0)).alias("rows_deduped"),
        F.count_if(~s).alias("rows_to_do"),
    ]


def resume_counts(rows: DataFrame, records: DataFrame, retry_errors: bool = False) -> DataFrame:
    """One row: rows_total, rows_done_prior, rows_errored_prior, rows_deduped, rows_to_do."""
    return resume_states(rows, records, retry_errors).agg(*state_counts(retry_errors))


def healed(records: DataFrame) -> DataFrame:
    """The last success of each id, by part and place in it; ids that only failed are left out."""
    kept = [c for c in records.columns if c not in ("error", "part", "pos")]
    best = F.max_by(F.struct(*kept), F.struct("part", "pos")).alias("r")
    return records.where("error is null").groupBy("id").agg(best).select("r.*")


def record_status(records: DataFrame) -> DataFrame:
    """(id, status): ok, healed (an error and a success), errored."""
    good, bad = F.bool_or(F.col("error").isNull()), F.bool_or(F.col("error").isNotNull())
    return records.groupBy("id").agg(F.when(good & bad, "healed").when(good, "ok").otherwise("errored").alias("status"))


def output_audit(records: DataFrame) -> DataFrame:
    per = records.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("e"))
    return per.agg(F.sum("n").alias("records"), F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.sum("e").alias("errors"))


def by_position(rows: DataFrame, column: str, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """rows with their 0-based position in the order of a column of distinct whole numbers.

    Buckets between approximate quantiles (as many as shuffle partitions, 5,000 at most, whatever the rows) are counted
    and summed, so no task sorts more than a bucket; the quantiles are all that the driver sees.
    """
    n = min(buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 5000)
    cuts = sorted(set(rows.stat.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cut = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="__at", outputCol="__b").transform(rows.withColumn("__at", F.col(column).cast("double"))).drop("__at")
    sizes = cut.groupBy("__b").agg(F.count("*").alias("__n"))
    ahead = sizes.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    return cut.join(F.broadcast(ahead), "__b").withColumn(name, (F.col("__ahead") + within).cast("long")).drop("__b", "__ahead")  # a row a bucket
