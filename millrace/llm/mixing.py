"""Mixing sources to target weights by a time-varying curriculum.

Each source follows a piecewise-linear weight schedule over the run, t in [0, 1].  The integral of the
schedule is the source's weight in the mix; the schedule's running integral is its cumulative token demand.
A document that begins at word c of its source's (shuffled, repeated) stream is needed when the demand reaches
c, so the inverse of the cumulative demand at c is its training position, and the mix is the documents
range-sorted by position, a document as often as it is taken.

Edge cases: null texts have no words; a null source is a source of its own, last in order; documents without
words take nothing and have no position; repeated rows are taken each for itself; rows that agree in doc_id, source
and size share a place in an order that may change; extra columns are ignored by `assign_positions`; an empty table
gives an empty result.  The windows over sources hold a row per source, so sources must be few enough for one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

Schedule = Sequence[tuple[float, float]]

#: Weight over time of the sources by rank, repeating; they integrate to 5, 2 and 1.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _inverse(schedule: Schedule, u: Column) -> Column:
    """The t at which the schedule's running integral is u of the whole; piece by piece a quadratic."""
    total, done, expr = integral(schedule), 0.0, None
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        c = F.greatest(u * F.lit(total) - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * c, F.lit(0.0)))
        below = F.lit(w0) + root
        at = F.when(below > 0, F.lit(t0) + F.lit(2.0) * c / F.when(below > 0, below)).otherwise(F.lit(t0))
        done += area
        pieces.append((done / total, F.least(at, F.lit(t1))))
    for bound, at in reversed(pieces):
        expr = at if expr is None else F.when(u <= F.lit(bound), at).otherwise(expr)
    return expr


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> plus rank, weight and target; one row per source.

    Targets are min(most * size, level * weight): sources at their cap, found in order of cap per weight, pass
    their excess to the rest by weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("cap", cap).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = F.col("weight") * (F.col("total") - F.col("capped")) / F.col("open")
    # the level is set by the first source, in that order, which stays under its cap
    ranked = ranked.withColumn("stays", own < F.col("cap"))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("stays"), F.struct(F.col("total") - F.col("capped"), F.col("open"))), ignorenulls=True).over(in_order)
    ranked = ranked.withColumn("level", first)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level.col1") / F.col("level.open"))
    return ranked.withColumn("target", target).select("source", "source_size", "rank", "target")


def assign_positions(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, share: float = 1.0, most: float = 3.0, bucket_digits: int = 3, carry: Sequence[Column] = ()) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, copies (position and words of each).

    The order of a source's documents is that of the MD5 of doc_id, or of the text's hash where that is null.  Running sums go by buckets of that hash
    (16 ** bucket_digits for each source), so the largest source is spread as widely as any.  `carry`: more columns.
    Sizes are stored, so that words are counted once.
    """
    sized = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(F.col("text").cast("string")).cast("string").alias("__none"), *carry).withColumn("dice", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("__none"))))
    sized = stored(sized.drop("__none").withColumn("bucket", F.substring("dice", 1, bucket_digits)), "sizes")
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("cell").over(over), F.lit(0)))
    totals = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    targets = source_targets(totals, [integral(s) for s in curriculum], share, most)
    cells = cells.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "rank", "target")
    placed = sized.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("begin", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    whole = F.floor("target")
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("begin") - F.lit(k) * F.col("source_size"))) for k in range(math.ceil(most))]
    copies = []
    for k, take in enumerate(takes):
        u = (F.col("begin") + F.lit(k) * F.col("source_size")) / F.col("target")
        when = None
        for j, schedule in enumerate(curriculum):
            mine = F.col("rank") % len(curriculum) == j
            when = F.when(mine, _inverse(schedule, u)) if when is None else when.when(mine, _inverse(schedule, u))
        copies.append(F.when(take > 0, F.struct(when.alias("position"), take.alias("words"))))
    carried = [c for c in placed.columns if c.startswith("__")]
    return placed.select("doc_id", "source", "size", "source_size", "target", sum(takes[1:], takes[0]).alias("taken"), F.array_compact(F.array(*copies)).alias("copies"), *carried)


def in_training_order(placed: DataFrame) -> DataFrame:
    """Rows range-sorted by position; those without one come last."""
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """A row for each copy that the mix takes, in training order: the document with size, taken (of this copy) and position."""
    own = [c for c in docs.columns if c not in ("size", "taken", "position")]
    assigned = assign_positions(docs, curriculum, carry=[F.struct(*[f"`{c}`" for c in own]).alias("__row")])
    placed = assigned.select("doc_id", "__row", "size", F.inline("copies").alias("position", "taken"))
    return in_training_order(placed).select("__row.*", "size", "taken", "position")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = assign_positions(table(spark, sf_dir, "documents"))
    placed = assigned.withColumn("position", F.get("copies", F.lit(0))["position"])
    return in_training_order(placed).select("doc_id", "size", "source_size", "target", "taken", "position")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS dice
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank, 3.0::DOUBLE * source_size AS cap,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM totals),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight FROM ranked),
opened AS (
  SELECT *, coalesce(sum(cap) OVER w, 0.0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS open
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, min(CASE WHEN weight * (total - capped) / open < cap THEN cap / weight END) OVER () AS first_key FROM opened),
leveled AS (
  SELECT *, arg_min(total - capped, rank) FILTER (cap / weight = first_key) OVER () AS spread,
         arg_min(open, rank) FILTER (cap / weight = first_key) OVER () AS shares FROM levels),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN first_key IS NULL OR cap / weight < first_key THEN cap ELSE weight * spread / shares END AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY dice, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS begin_at
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - begin_at)) AS t0,
         greatest(0, least(size, floor(target)::BIGINT - begin_at - source_size)) AS t1,
         greatest(0, least(size, floor(target)::BIGINT - begin_at - 2 * source_size)) AS t2,
         begin_at / target AS u
  FROM placed)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
       CASE WHEN t0 > 0 THEN CASE rank % 3
         WHEN 0 THEN least(0.0 + 2.0 * greatest(u * 5.0, 0.0) / (7.5 + sqrt(greatest(56.25 + -10.0 * greatest(u * 5.0, 0.0), 0.0))), 1.0)
         WHEN 1 THEN least(0.0 + 2.0 * greatest(u * 2.0, 0.0) / (1.0 + sqrt(greatest(1.0 + 4.0 * greatest(u * 2.0, 0.0), 0.0))), 1.0)
         ELSE least(0.0 + 2.0 * greatest(u * 1.0, 0.0) / (0.5 + sqrt(greatest(0.25 + 2.0 * greatest(u * 1.0, 0.0), 0.0))), 1.0) END END AS position
FROM took
"""
