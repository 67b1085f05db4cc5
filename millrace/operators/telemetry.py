"""Statistics of runs and ticks: counts, sliding evidence, islands of failures, verdicts and advice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The flag that raises each engine's ceiling.
CEILING_FLAG = {
    "vllm": "--max-num-seqs {n}",
    "sglang": "--max-running-requests {n}",
    "llamacpp": "-np {n} (per-slot context halves unless -c is raised too)",
    "trtllm": "--max_batch_size {n}",
    "tei": "--max-concurrent-requests {n} (rejects with 429 above the cap — TEI does not queue)",
}


def micros(ts: str = "ts") -> Column:
    """Microseconds of a time without zone since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def ticks(events: DataFrame, seconds: int) -> DataFrame:
    """Attempts (at in microseconds, ok, pressure, tokens) -> a row per tick that has any: t, ok, bp, tokens."""
    t = F.floor(F.col("at") / (seconds * 1_000_000)).cast("long")
    return events.groupBy(t.alias("t")).agg(F.count_if("ok").alias("ok"), F.count_if("pressure").alias("bp"), F.sum("tokens").cast("long").alias("tokens"))


def tick_deltas(of: DataFrame, seconds: int) -> DataFrame:
    """ticks with the change of tokens and of time since the tick before, and tokens a second."""
    before = Window.orderBy("t")
    gap = (F.col("t") - F.lag("t").over(before)) * seconds
    return of.withColumn("gap_s", gap).withColumn("tok_s", F.round(F.try_divide(F.col("tokens"), gap), 1))


def overloaded(bp: Column, ok: Column, share: float = 0.05) -> Column:
    return (bp > 0) & (bp >= share * (bp + ok))


def breaker_runs(attempts: DataFrame, order: str, failed: Column, threshold: int) -> DataFrame:
    """(start, stop, n): runs of at least threshold consecutive failures in each lane; lane parts the work."""
    w = Window.partitionBy("lane").orderBy(order)
    marked = attempts.withColumn("__bad", failed).withColumn("__island", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("__bad").groupBy("lane", "__island").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= threshold).drop("__island")


def pressure_once(attempts: DataFrame, row: str, order: str, pressure: Column) -> DataFrame:
    """attempts with their ordinal in the row, and `counted`: whether this is the row's first with pressure."""
    w = Window.partitionBy(row).orderBy(order)
    so_far = F.sum(pressure.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return attempts.withColumn("attempt", F.row_number().over(w).cast("long")).withColumn("counted", pressure & (so_far == 1))


def latency_p50(attempts: DataFrame, key: str, order: str, value: str, last: int = 128) -> DataFrame:
    """The exact median of the last attempts of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return attempts.withColumn("__n", n).where(F.col("__n") <= last).groupBy(key).agg(F.median(value).alias("p50"), F.count("*").alias("n"))


def evidence(samples: DataFrame, epoch: str, order: str, last: int = 16) -> DataFrame:
    """samples (ok, rows_s) with the sums the window rule reads: over the last samples of an epoch but the first."""
    w = Window.partitionBy(epoch).orderBy(order)
    recent = w.rowsBetween(-(last - 1), 0)
    n, ok = F.count("*").over(recent), F.sum("ok").over(recent)
    first = F.first("rows_s").over(recent)
    mean = F.try_divide(F.sum("rows_s").over(recent) - first, n - 1)
    return samples.withColumn("n", n).withColumn("completions", ok).withColumn("rows_mean", mean)


def sufficient(samples: DataFrame, epoch: str, order: str, limit: str, last: int = 16) -> DataFrame:
    """evidence with tokens_mean, and whether it suffices to judge a window: two samples, and as many completions as the limit.

    Means leave an epoch's first sample out; that of tokens is there only if every other sample of the reading has some.
    """
    recent = Window.partitionBy(epoch).orderBy(order).rowsBetween(-(last - 1), 0)
    first = lambda c: F.first(c).over(recent)
    known = F.count("tok_s").over(recent) - F.when(first("tok_s").isNull(), 0).otherwise(1)
    total = F.sum("tok_s").over(recent) - F.coalesce(first("tok_s"), F.lit(0.0))
    judged = evidence(samples, epoch, order, last)
    enough = (F.col("completions") >= F.col(limit)) & (F.col("n") >= 2)
    return judged.withColumn("tokens_mean", F.when(known == F.col("n") - 1, F.try_divide(total, known))).withColumn("enough", enough)


def preempt_deltas(readings: DataFrame, lane: str, order: str, value: str = "preempts") -> DataFrame:
    """readings with `preempted`: the counter's rise; a fall counts one, a gap or the first reading none."""
    before = F.lag(value).over(Window.partitionBy(lane).orderBy(order))
    rise = F.col(value) - before
    return readings.withColumn("preempted", F.when(F.col(value).isNull() | before.isNull(), 0).when(rise >= 0, rise).otherwise(1).cast("long"))


def bound_by(dt: Column, source: Column, prep: Column, sink: Column, acquire: Column, lag: Column, inflight: Column, limit: Column, workers: Column) -> Column:
    """What bound a tick: source, prep, sink, loop, engine, or null."""
    each = prep / F.greatest(F.lit(1), workers)
    most = F.greatest(source, each, sink)
    stage = F.when(source == most, "source").when(each == most, "prep").otherwise("sink")
    return (
        F.when(dt <= 0, F.lit(None).cast("string"))
        .when((inflight < 0.5 * limit) & (most >= 0.25 * dt), stage)
        .when((workers == 0) & (prep >= 0.5 * dt), "prep")
        .when(lag >= 0.5 * dt, "loop")
        .when((inflight >= limit) | (acquire > source + prep), "engine")
    )


def histogram(of: DataFrame, column: str, prefix: str = "") -> DataFrame:
    chosen = of.where(F.col(column).isNotNull() & (F.col(column) != "") & F.col(column).startswith(prefix))
    return chosen.groupBy(column).agg(F.count("*").alias("n"))


def advise_ceiling(of: DataFrame, dialect: str | None, final_limit: int, flags: Mapping[str, str] = CEILING_FLAG) -> DataFrame:
    """(hint), one row at most: running pinned under the limit while a queue stands, in ticks (t, running, waiting)."""
    read = of.where("running is not null").withColumn("queued", F.coalesce(F.col("waiting"), F.lit(0)) > 0)
    counts = read.agg(F.count("*").alias("ticks"), F.count_if("queued").alias("q"))
    modes = read.where("queued").groupBy("running").agg(F.count("*").alias("freq"), F.min("t").alias("t0"))
    mode = modes.agg(F.max(F.struct("freq", (-F.col("t0")).alias("first"), "running")).alias("m")).select("m.freq", "m.running")
    both = counts.crossJoin(mode)  # one row each
    flag = F.replace(F.lit(flags.get(dialect or "", "raise the server's max concurrent requests")), F.lit("{n}"), (2 * F.col("running")).cast("string"))
    held = (F.col("ticks") >= 5) & (F.col("q") / F.col("ticks") >= 0.5) & (F.col("running") != 0) & (F.col("freq") / F.col("q") >= 0.7) & (F.col("running") < final_limit)
    share = F.floor(100 * F.col("q") / F.col("ticks")).cast("long")
    hint = F.concat(F.lit("server ceiling: running pinned at "), F.col("running").cast("string"), F.lit(" with a standing queue for "), share.cast("string"), F.lit("% of the run — relaunch with "), flag)
    return both.where(held).select(hint.alias("hint"))


def advise_input(of: DataFrame) -> DataFrame:
    """One row: what share of ticks each client stage bound, and its cost: ms a row of prep and source, % of loop."""
    share = lambda v: F.count_if(F.col("bound_by") == v) / F.count("*")
    prep = F.bround(1000 * F.sum("prep_s") / F.greatest(F.lit(1), F.sum("prep_n")), 0).cast("long")
    source = F.bround(1000 * F.sum("source_s") / F.greatest(F.lit(1), F.sum(F.col("ok") + F.col("bp"))), 0).cast("long")
    loop = F.least(F.lit(100), F.bround(100 * F.sum("loop_lag_s") / F.greatest(F.max("t"), F.lit(1e-9)), 0)).cast("long")
    seen = F.count("*") >= 3
    return of.agg(F.when(seen & (share("prep") >= 0.3), prep).alias("prep_ms"), F.when(seen & (share("source") >= 0.3), source).alias("source_ms"), F.when(seen & (share("loop") >= 0.3), loop).alias("loop_pct"))


def input_hints(advice: DataFrame, prepare_workers: int = 0) -> DataFrame:
    """(hint): what advise_input found, in words; a row for each stage that bound the run."""
    # The texts that are shown.
    many = f"PREP-BOUND: prep is still the bottleneck at {prepare_workers} workers (%d ms/row): raise prepare_workers, or move the work to prepare_ahead with a process pool"
    few = "PREP-BOUND: to_request took %d ms/row on average; if it releases the GIL (Pillow, ffmpeg, I/O) set pump(prepare_workers=4), otherwise prepare rows ahead of the pump with prepare_ahead(rows, fn, executor=ProcessPoolExecutor())"
    source = "SOURCE-BOUND: the source took %d ms/row; prefetch it (prepare_ahead / bucket_rows(prefetch=)), select fewer columns, or shard the input"
    loop = "LOOP-BOUND: the event loop was blocked %d%% of the run (parse, and any to_request share under the prep threshold); keep parse cheap and move to_request work off the loop"
    said = [F.when(F.col(c).isNotNull(), F.format_string(text, c)) for c, text in (("prep_ms", many if prepare_workers >= 4 else few), ("source_ms", source), ("loop_pct", loop))]
    return advice.select(F.explode(F.array_compact(F.array(*said))).alias("hint"))


def silent_seconds(of: DataFrame, order: str, lane: str, seconds: float) -> DataFrame:
    """ticks (ok, inflight, lim) with the seconds so far in which a full window completed nothing."""
    w = Window.partitionBy(lane).orderBy(order)
    silent = (F.col("ok") == 0) & (F.col("inflight") >= F.col("lim"))
    island = F.sum(F.when(silent, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = of.withColumn("__silent", silent).withColumn("__island", island)
    run = Window.partitionBy(lane, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(F.when(F.col("__silent"), F.lit(float(seconds))).otherwise(0.0)).over(run)
    return marked.withColumn("silent_s", so_far).drop("__silent", "__island")


def rounded_tick(t: Column, tok_s: Column, *seconds: Column) -> list[Column]:
    """A tick's numbers as they are stored: t and tok_s to one place, seconds to three, halves to even."""
    return [F.bround(t, 1), F.bround(tok_s, 1), *[F.bround(s, 3) for s in seconds]]


def recounted(processed: Column, failed: Column, demoted: Column) -> Column:
    """struct(processed, failed) after rows that a flush turned into errors; at most those that were processed."""
    moved = F.least(demoted, processed)
    return F.struct((processed - moved).alias("processed"), (failed + moved).alias("failed"))


def token_rate(attempts: DataFrame, key: str, seconds: float, tokens: str = "tokens") -> DataFrame:
    """(key, tokens_per_s) to one place."""
    return attempts.groupBy(key).agg(F.round(F.try_divide(F.sum(tokens), F.lit(float(seconds))), 1).alias("tokens_per_s"))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, p90), interpolated."""
    return rows.groupBy(key).agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"))


def window_scores(runs: DataFrame) -> DataFrame:
    """(cell, score, dropped): the self-tuned window's median rate over the best fixed window's, in runs that are complete.

    runs: cell, arm (auto, warmup or a fixed window), rate, ok, failed, rows.  Warm-ups do not count; runs with
    failures, missing rows or no rate are dropped and counted.  A cell without both sides has no score.
    """
    tried = runs.where("arm <> 'warmup'").withColumn("whole", F.expr("failed = 0 and ok = rows and rate > 0"))
    arms = tried.groupBy("cell", "arm").agg(F.median(F.when(F.col("whole"), F.col("rate"))).alias("rate"), F.count_if(~F.col("whole")).alias("dropped"))
    auto, fixed = F.max(F.when(F.col("arm") == "auto", F.col("rate"))), F.max(F.when(F.col("arm") != "auto", F.col("rate")))
    return arms.groupBy("cell").agg(F.try_divide(auto, fixed).alias("score"), F.sum("dropped").alias("dropped"))


def running_clock(of: DataFrame, order: str, seconds: float) -> DataFrame:
    """ticks with clock_s, the seconds that they add up to; ticks of one run, whose number is small."""
    return of.withColumn("clock_s", F.sum(F.lit(seconds)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def oldest_open(attempts: DataFrame, lane: str, order: str, at: str, now: int) -> DataFrame:
    """(lane, oldest_s): the age of each lane's oldest attempt that no later one has followed, in whole seconds."""
    done = F.lead(at).over(Window.partitionBy(lane).orderBy(order))
    return attempts.withColumn("__done", done).where("__done is null").groupBy(lane).agg(F.floor(F.max(F.lit(now) - F.col(at)) / 1_000_000).cast("long").alias("oldest_s"))


def rollup(of: DataFrame, t: str = "t", tokens: str = "tokens", ok: str = "ok") -> DataFrame:
    """One row of a run's ticks: how many, most and mean tokens, their change from first to last, most successes."""
    return of.agg(F.count("*").alias("ticks"), F.max(tokens).alias("max_tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"), (F.max_by(tokens, t) - F.min_by(tokens, t)).alias("change"), F.max(ok).alias("max_ok"))


def starved(bound: Column, inflight: Column, limit: Column) -> Column:
    """Whether the client side starved the endpoint: a client stage bound the tick with the window under half used."""
    return bound.isin("source", "prep", "sink") & (inflight < 0.5 * limit)
