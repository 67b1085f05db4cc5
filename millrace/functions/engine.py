"""Readings of inference engines: gauges, capacities, request units, and the arithmetic of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (engine, prefix of its metrics, metric, field, key of a counter pair).
METRICS = (
    ("vllm", "vllm", "num_requests_waiting", "waiting", None),
    ("vllm", "vllm", "num_requests_running", "running", None),
    ("vllm", "vllm", "kv_cache_usage_perc", "kv", None),
    ("vllm", "vllm", "gpu_cache_usage_perc", "kv", None),
    ("vllm", "vllm", "gpu_prefix_cache_hit_rate", "hits", None),
    ("vllm", "vllm", "num_preemptions_total", "preempts", None),
    ("vllm", "vllm", "prefix_cache_queries_total", "prefix_counts", "queries"),
    ("vllm", "vllm", "prefix_cache_hits_total", "prefix_counts", "hits"),
    ("vllm", "vllm", "gpu_prefix_cache_queries_total", "prefix_counts", "queries"),
    ("vllm", "vllm", "gpu_prefix_cache_hits_total", "prefix_counts", "hits"),
    ("sglang", "sglang", "num_queue_reqs", "waiting", None),
    ("sglang", "sglang", "num_running_reqs", "running", None),
    ("sglang", "sglang", "token_usage", "kv", None),
    ("sglang", "sglang", "cache_hit_rate", "hits", None),
    ("sglang", "sglang", "num_retracted_requests_total", "preempts", None),
    ("llamacpp", "llamacpp", "requests_deferred", "waiting", None),
    ("llamacpp", "llamacpp", "requests_processing", "running", None),
    ("trtllm", "trtllm", "num_requests_waiting", "waiting", None),
    ("trtllm", "trtllm", "num_requests_running", "running", None),
    ("tei", "te", "queue_size", None, None),
)


def metric_names(spark: SparkSession) -> DataFrame:
    """(name, engine, field, key): both spellings of each metric."""
    rows = [(f"{prefix}{sep}{name}", engine, field, key) for engine, prefix, name, field, key in METRICS for sep in (":", "_")]
    return spark.createDataFrame(rows, "name string, engine string, field string, key string")


def samples(bodies: DataFrame) -> DataFrame:
    """(scrape, body) -> (scrape, line, name, labels, value) of the sample lines of metrics text.

    Comments and values that are not finite are left out; braces inside quoted labels are read over.
    """
    lines = bodies.select("scrape", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    form = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(?:[^"}]|"(?:[^"\\]|\\.)*")*\})?[ \t]+([^ \t]+)'
    parsed = lines.select("scrape", "line", *[F.regexp_extract("text", form, i).alias(n) for i, n in ((1, "name"), (2, "labels"), (3, "v"))])
    value = F.col("v").try_cast("double")
    return parsed.where("name <> ''").select("scrape", "line", "name", "labels", value.alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def gauges(bodies: DataFrame) -> DataFrame:
    """One row per scrape with a known metric: dialect and the combined fields; counts add up, ratios take the last."""
    spark = bodies.sparkSession
    known = samples(bodies).join(F.broadcast(metric_names(spark)), "name")  # 40 fixed rows
    total = lambda f: F.sum(F.when(F.col("field") == f, F.floor("value"))).cast("long").alias(f)
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("line"))).alias(f)
    return known.groupBy("scrape").agg(F.max_by("engine", "line").alias("dialect"), total("waiting"), total("running"), total("preempts"), last("kv"), last("hits"))


def hit_rates(counts: DataFrame) -> DataFrame:
    """(scrape, labels, queries, hits) -> (scrape, rate): new hits over new queries since the reading before.

    Null on the first reading, if a label set came, went or lacks a counter, if a counter fell, or without queries.
    """
    from pyspark.sql import Window

    scrapes = counts.select("scrape").distinct().withColumn("before", F.lag("scrape").over(Window.orderBy("scrape")))
    now = counts.join(scrapes, "scrape").select("scrape", "before", "labels", "queries", "hits")
    then = counts.select(F.col("scrape").alias("before"), "labels", F.col("queries").alias("q0"), F.col("hits").alias("h0"))
    sizes = counts.groupBy(F.col("scrape").alias("before")).agg(F.count("*").alias("had"))
    both = now.join(then, ["before", "labels"], "left")
    dq, dh = F.col("queries") - F.col("q0"), F.col("hits") - F.col("h0")
    odd = F.coalesce(dq < 0, F.lit(True)) | F.coalesce(dh < 0, F.lit(True))
    per = both.groupBy("scrape", "before").agg(F.count("*").alias("has"), F.bool_or(odd).alias("odd"), F.sum(dq).alias("q"), F.sum(dh).alias("h"))
    good = ~F.col("odd") & (F.col("has") == F.col("had")) & (F.col("q") > 0)
    return per.join(sizes, "before", "left").select("scrape", F.when(good, F.least(F.col("h") / F.col("q"), F.lit(1.0))).alias("rate"))


def capacity(path: Column, body: Column) -> Column:
    """struct(requests, queues, engine) that an info body reports, or null."""
    v = F.try_parse_json(body)
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()

    def count(of: Column, key: str) -> Column:
        x = F.try_variant_get(of, f"$.{key}", "variant")
        n = F.try_variant_get(x, "$", "long")
        return F.when((F.schema_of_variant(x) == "BIGINT") & (n > 0), n)

    def found(n: Column, engine: str, queues: bool) -> Column:
        return F.struct(n.alias("requests"), F.lit(queues).alias("queues"), F.lit(engine).alias("engine"))

    # an entry a rank, under loads, or the body itself, a list or one; their sum, if all are counts
    entries = F.coalesce(F.try_variant_get(v, "$.loads", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))
    ranks = F.transform(entries, lambda e: F.when(F.try_variant_get(e, "$.num_running_reqs", "variant").isNotNull(), count(e, "max_running_requests")))
    all_ = F.when((F.size(ranks) > 0) & F.forall(ranks, lambda n: n.isNotNull()), F.aggregate(ranks, F.lit(0).cast("long"), lambda a, n: a + n))
    out = F.when((path == "/v1/loads") & all_.isNotNull(), found(all_, "sglang", True))
    # Where an engine says it, under which key, and the keys that its body has besides.
    for at, key, engine, queues, *signature in (
        ("/get_server_info", "max_running_requests", "sglang", True, "max_prefill_tokens"),
        ("/props", "total_slots", "llamacpp", True, "default_generation_settings"),
        ("/info", "max_concurrent_requests", "tei", False, "max_batch_tokens", "model_id"),
        ("/server_info", "max_batch_size", "trtllm", True, "disaggregated_params"),
    ):
        there = (path == at) & count(v, key).isNotNull()
        for s in signature:
            there = there & has(s)
        out = out.when(there, found(count(v, key), engine, queues))
    return out


def request_units(route: Column, body: Column) -> Column:
    """The inputs that a request body holds: a list counts its items; token ids, or a pair to /predict, are one."""
    v = F.try_parse_json(body)

    def units(key: str) -> Column:
        items = F.try_variant_get(v, f"$.{key}", "array<variant>")
        kinds = F.transform(items, lambda x: F.schema_of_variant(x))
        ids = F.forall(kinds, lambda k: k == "BIGINT")
        pair = F.rtrim(F.regexp_replace(route, "/+$", "")).endswith("/predict") & (F.size(items) == 2) & F.forall(kinds, lambda k: k == "STRING")
        return F.when(F.size(items) > 0, F.when(ids | pair, F.lit(1)).otherwise(F.size(items)))

    return F.coalesce(units("input"), units("inputs"), units("texts"), F.lit(1)).cast("long")


def server_root(endpoint: Column) -> Column:
    """An endpoint without a last /v1 segment, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(endpoint, r"[?#].*$", ""), "/+$", ""), "/v1$", "")


def above(ceiling: Column) -> Column:
    return F.greatest(ceiling + 1, F.floor(ceiling * 9 / 8))


def below(ceiling: Column) -> Column:
    return ceiling - F.greatest(F.lit(1), F.floor(ceiling / 8))


def start_window(requests: Column, queues: Column, lowest: int = 2, highest: int = 512, default: int = 64, target_waiting: int = 8) -> Column:
    """Where a window begins: over a queueing capacity by a band, at a rejecting one, else the default."""
    start = F.when(requests.isNull(), F.lit(default)).when(queues, requests + F.least(requests, F.lit(2 * target_waiting))).otherwise(requests)
    top = F.when(requests.isNotNull() & ~queues, F.least(F.lit(highest), requests)).otherwise(F.lit(highest))
    low = F.when(requests.isNotNull() & ~queues, F.least(F.lit(lowest), requests)).otherwise(F.lit(lowest))
    return F.least(top, F.greatest(low, start)).cast("long")


def clamped(n: Column, ceiling: Column, lowest: int = 2, highest: int = 512) -> Column:
    """A window within its bounds and under a ceiling where there is one; the lowest bound wins."""
    top = F.when(ceiling.isNull(), F.lit(highest)).otherwise(F.least(F.lit(highest), below(ceiling)))
    return F.greatest(F.lit(lowest), F.least(top, n)).cast("long")


def patience(tick_s: Column, latency_s: Column, ticks: int = 3) -> Column:
    """Seconds for which a full, silent window is borne: some ticks, or three times the latency if that is longer."""
    return F.greatest(ticks * tick_s, 3 * latency_s)  # greatest leaves nulls out


def throughput_ratio(tok_s: Column, rows_s: Column, other_tok_s: Column, other_rows_s: Column) -> Column:
    """One reading over another, in tokens when both have them, else in rows; over nothing it is infinite."""
    over = lambda a, b: F.when(b == 0, F.lit(float("inf"))).otherwise(F.try_divide(a, b))
    return F.when(tok_s.isNotNull() & other_tok_s.isNotNull(), over(tok_s, other_tok_s)).otherwise(over(rows_s, other_rows_s))


def settled_by(opened: Column, latency_s: Column, widened: Column) -> Column:
    """When a trial window's own readings have arrived."""
    return opened + 2 * latency_s * F.greatest(F.lit(1.0), widened)
