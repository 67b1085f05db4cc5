"""The registered queries of the resumable-run operators, each beside the SQL that must give the same rows.

`documents` are the input rows, `labels` stand for stored output (quality 1: a success, 0: an error; toxic 1: a
later success), `events` for the log of attempts (an error event is a failed attempt, `value` its latency).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import engine, ids, outcomes
from .operators import records, resume, telemetry
from .plans.calls import Policy, call_rows
from .sources import tables
from .sources.shared import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two earlier runs, from labels."""
    x = table(spark, sf_dir, "labels")
    error = F.when((F.col("quality") == 0) & (F.col("doc_id") % 7 == 0), "").when(F.col("quality") == 0, "http 500 after retries: ")
    first = x.select(F.col("doc_id").cast("string").alias("id"), error.alias("error"), F.lit("part-0000000000001-000000-aaaaaaaa.parquet").alias("part"), F.col("doc_id").alias("pos"), F.lit("first").alias("out"))
    second = x.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 == 0, "transport: reset").alias("error"), F.lit("part-0000000000002-000000-bbbbbbbb.parquet").alias("part"), F.col("doc_id").alias("pos"), F.lit("second").alias("out"))
    return first.union(second)


STORED = """stored AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 AND doc_id % 7 = 0 THEN '' WHEN quality = 0 THEN 'http 500 after retries: ' END AS error,
         'part-0000000000001-000000-aaaaaaaa.parquet' AS part, doc_id AS pos, 'first' AS out FROM labels
  UNION ALL
  SELECT doc_id::VARCHAR, CASE WHEN doc_id % 5 = 0 THEN 'transport: reset' END, 'part-0000000000002-000000-bbbbbbbb.parquet', doc_id, 'second' FROM labels WHERE toxic = 1),
states AS (SELECT id, bool_or(coalesce(error, '') = '') AS done, bool_or(coalesce(error, '') <> '') AS failed FROM stored GROUP BY id)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as attempts: at (microseconds), ok, pressure, tokens, latency, lane (the user)."""
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", telemetry.micros().alias("at"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "error").alias("pressure"), k.alias("tokens"), F.col("value").alias("latency"), F.col("user_id").alias("lane"))


ATTEMPTS = """attempts AS (
  SELECT event_id, epoch_us(ts) AS at_us, event_type <> 'error' AS ok, event_type = 'error' AS pressure,
         (props->>'$.k')::BIGINT AS tokens, value AS latency, user_id AS lane FROM events)"""
HOURS = f"""{ATTEMPTS},
ticks AS (SELECT at_us // 3600000000 AS t, count(*) FILTER (ok) AS ok, count(*) FILTER (pressure) AS bp, sum(tokens)::BIGINT AS tokens FROM attempts GROUP BY 1)"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.ticks(attempts(spark, sf_dir), 3600)


# ---- identifiers, shards, sources ------------------------------------------------------------------------------


@query("""SELECT doc_id, substr(sha1('{"doc_id": ' || doc_id || ', "lang": ' || to_json(lang)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || '}'), 1, 16) AS id FROM documents""")
def content_ids(spark, sf_dir):
    return ids.with_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "id")


@query("""SELECT id, doc_id FROM (SELECT substr(sha1('{"text": ' || to_json(text)::VARCHAR || '}'), 1, 16) AS id, doc_id,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_by_content(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id", "text"), id_keys=["text"])
    return resume.first_wins(rows.select("id", "doc_id"), "doc_id")


@query("""SELECT (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 7)::BIGINT AS shard, count(*) AS n FROM documents GROUP BY 1""")
def shard_of_counts(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id"), id_key="doc_id")
    return rows.groupBy(ids.shard_of(F.col("id"), 7).alias("shard")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents WHERE ('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 4 = 0""")
def shard_select_r0_k4(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id"), id_key="doc_id")
    return ids.shard_select(rows, 0, 4).select("doc_id")


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, count(*) AS covered FROM orders""")
def shard_partition_check(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "orders").select("o_orderkey"), id_key="o_orderkey")
    parts = [ids.shard_select(rows, r, 5) for r in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count("o_orderkey").alias("covered"))


@query("""SELECT doc_id, 'docs:train:' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 9, '0') AS id FROM documents""")
def index_ids(spark, sf_dir):
    return tables.table_rows(spark, f"{sf_dir}/documents.parquet", columns=["doc_id"], index_parts=("docs", None, "train")).select("doc_id", "id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
WHERE pos < 300 AND ('0x' || substr(sha1('train:' || lpad(pos::VARCHAR, 9, '0')), 1, 16))::UBIGINT % 3 = 1""")
def limit_then_shard(spark, sf_dir):
    return tables.table_rows(spark, f"{sf_dir}/documents.parquet", columns=["doc_id"], index_parts=("train",), limit=300, shard=(1, 3)).select("doc_id")


@query("""SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS id FROM pages""")
def path_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.path_id(F.col("url")).alias("id"))


@query("""SELECT page_id, substr(p, 6) AS id FROM (SELECT page_id, 'data/' || regexp_replace(url, '^[a-zA-Z]+://', '') AS p FROM pages)""")
def path_ids_root(spark, sf_dir):
    path = F.concat(F.lit("s3://data/"), F.regexp_replace("url", "^[a-zA-Z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", ids.path_id(path, "data").alias("id"))


@query("""SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def path_skip(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return resume.not_known(table(spark, sf_dir, "pages").select("page_id"), known, "page_id")


@query(r"""SELECT page_id, id <> '' AND NOT regexp_matches(id, '[/\\]') AND NOT starts_with(id, '.') AS safe
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'p' || page_id WHEN 2 THEN '.' || page_id ELSE '' END AS id FROM pages)""")
def safe_filename(spark, sf_dir):
    n = F.col("page_id")
    name = F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("p"), n)).when(n % 4 == 2, F.concat(F.lit("."), n)).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", ids.safe_filename(name).alias("safe"))


# ---- resuming and merging --------------------------------------------------------------------------------------


@query(f"""WITH {STORED} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM states)""")
def resume_anti_join(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id"), id_key="doc_id")
    return resume.skip_done(rows, stored(spark, sf_dir), "doc_id").select("doc_id")


@query(f"""WITH {STORED} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM states WHERE done)""")
def resume_retry_errors(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id"), id_key="doc_id")
    return resume.skip_done(rows, stored(spark, sf_dir), "doc_id", retry_errors=True).select("doc_id")


@query(f"""WITH {STORED} SELECT id FROM states WHERE failed AND NOT done""")
def error_only_ids(spark, sf_dir):
    return resume.error_only_ids(stored(spark, sf_dir))


@query(f"""WITH {STORED} SELECT id FROM states""")
def existing_ids_all(spark, sf_dir):
    return resume.existing_ids(stored(spark, sf_dir))


@query("""SELECT 'part-' || lpad(doc_id::VARCHAR, 6, '0') || '.parquet' AS name FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def existing_ids_uncovered(spark, sf_dir):
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".parquet")).alias("name")
    return resume.uncovered_parts(table(spark, sf_dir, "documents").select(name("part-")), table(spark, sf_dir, "labels").select(name("ids-part-")))


@query(f"""WITH {STORED} SELECT id, arg_max(out, part || lpad(pos::VARCHAR, 12, '0')) AS out FROM stored WHERE error IS NULL GROUP BY id""")
def healed_latest(spark, sf_dir):
    return resume.healed(stored(spark, sf_dir))


@query(f"""WITH {STORED} SELECT id, CASE WHEN bool_or(error IS NULL) AND bool_or(error IS NOT NULL) THEN 'healed' WHEN bool_or(error IS NULL) THEN 'ok' ELSE 'errored' END AS status FROM stored GROUP BY id""")
def record_status(spark, sf_dir):
    return resume.record_status(stored(spark, sf_dir))


@query(f"""WITH {STORED} SELECT sum(n)::BIGINT AS records, count(*) AS unique_ids, count(*) FILTER (n > 1) AS repeated_ids, sum(e)::BIGINT AS errors
FROM (SELECT id, count(*) AS n, count(error) AS e FROM stored GROUP BY id)""")
def output_audit(spark, sf_dir):
    return resume.output_audit(stored(spark, sf_dir))


_COUNTS = """SELECT sum(n)::BIGINT AS rows_total, coalesce(sum(n) FILTER (skip), 0)::BIGINT AS rows_done_prior, {errored} AS rows_errored_prior,
  coalesce(sum(n - 1) FILTER (NOT skip), 0)::BIGINT AS rows_deduped, count(*) FILTER (NOT skip) AS rows_to_do
FROM (SELECT i.id, i.n, {skip} AS skip, coalesce(failed AND NOT done, false) AS errored
      FROM (SELECT (doc_id // 2)::VARCHAR AS id, count(*) AS n FROM documents GROUP BY 1) i LEFT JOIN states USING (id))"""


def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("long").alias("half"))
    return ids.with_id(rows, id_key="half")


@query(f"WITH {STORED} " + _COUNTS.format(skip="done IS NOT NULL", errored="coalesce(sum(n) FILTER (skip AND errored), 0)::BIGINT"))
def run_stats(spark, sf_dir):
    return resume.resume_counts(_halved(spark, sf_dir), stored(spark, sf_dir))


@query(f"WITH {STORED} " + _COUNTS.format(skip="coalesce(done, false)", errored="0::BIGINT"))
def run_stats_retry(spark, sf_dir):
    return resume.resume_counts(_halved(spark, sf_dir), stored(spark, sf_dir), retry_errors=True)


@query(f"""WITH {STORED}, r AS (SELECT (doc_id // 2)::VARCHAR AS id FROM documents)
SELECT count(*) AS rows_total, count(*) FILTER (k.id IS NULL) - count(DISTINCT r.id) FILTER (k.id IS NULL) AS rows_deduped, count(DISTINCT r.id) FILTER (k.id IS NULL) AS rows_left, 0::BIGINT AS unaccounted
FROM r LEFT JOIN (SELECT DISTINCT id FROM stored) k USING (id)""")
def stats_reconcile(spark, sf_dir):
    """The counts of a run against the rows that its resume join really leaves."""
    rows, prior = _halved(spark, sf_dir), stored(spark, sf_dir)
    left = resume.skip_done(rows, prior, "doc_id").agg(F.count("*").alias("rows_left"))
    both = resume.resume_counts(rows, prior).crossJoin(left)  # one row each
    return both.select("rows_total", "rows_deduped", "rows_left", (F.col("rows_total") - F.col("rows_done_prior") - F.col("rows_deduped") - F.col("rows_left")).alias("unaccounted"))


@query(f"""WITH {STORED} SELECT id, out, NULL::VARCHAR AS note FROM stored WHERE part LIKE '%aaaaaaaa%' UNION ALL BY NAME SELECT id, 'n' || pos AS note, NULL::VARCHAR AS out FROM stored WHERE part LIKE '%bbbbbbbb%'""")
def schema_union_parts(spark, sf_dir):
    s = stored(spark, sf_dir)
    one = s.where(F.col("part").contains("aaaaaaaa")).select("id", "out")
    two = s.where(F.col("part").contains("bbbbbbbb")).select("id", F.concat(F.lit("n"), F.col("pos")).alias("note"))
    return resume.union_parts(one, two)


# ---- requests, replies, records --------------------------------------------------------------------------------


@query("""SELECT doc_id, '{"model":"m","max_tokens":64,"messages":[{"role":"user","content":' || to_json(text)::VARCHAR || '}]}' AS body FROM documents""")
def request_bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.chat_request(F.col("text"), "m", 64).alias("body"))


@query("""SELECT conv_id, '[' || string_agg('{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn) || ']' AS messages, count(*) AS n FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    return records.chat_transcripts(table(spark, sf_dir, "conversations"))


@query("""SELECT 'batch-' || lpad(b::VARCHAR, 5, '0') AS id, n, first, last FROM (
  SELECT (pos // 64) AS b, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE length(left(text, 1200)) > 100) GROUP BY 1) WHERE n = 64""")
def embedding_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.length(F.left("text", F.lit(1200))) > 100).select("doc_id")
    return records.full_batches(resume.by_position(rows, "doc_id").withColumn("id", F.col("doc_id")), "pos", 64)


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def parse_props(spark, sf_dir):
    return records.parsed(table(spark, sf_dir, "events"), "props", "k long").select("event_id", "k")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN (props->>'$.k')::BIGINT WHEN 1 THEN floor((props->>'$.k')::BIGINT / 2)::BIGINT ELSE 0 END AS tokens FROM events""")
def usage_tokens(spark, sf_dir):
    n, k = F.col("event_id") % 5, F.get_json_object("props", "$.k").cast("long")
    value = F.when(n == 0, k.cast("string")).when(n == 1, (k / 2).cast("string")).when(n == 2, "true").when(n == 3, (-k - 1).cast("string")).otherwise('"7"')
    body = F.concat(F.lit('{"usage":{"prompt_tokens":'), value, F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", outcomes.token_count(body, "$.usage.prompt_tokens").alias("tokens"))


@query("""SELECT event_id, event_id % 4 <= 1 AS readable FROM events""")
def json_object_replies(spark, sf_dir):
    n = F.col("event_id") % 4
    body = F.when(n == 0, F.col("props")).when(n == 1, F.lit("{}")).when(n == 2, F.lit("[1]")).otherwise(F.lit("<html>"))
    return table(spark, sf_dir, "events").select("event_id", outcomes.is_json_object(body).alias("readable"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'http 400: bad' END AS error, CASE WHEN quality <> 0 THEN toxic::BIGINT END AS score FROM labels""")
def record_build(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    error = F.when(F.col("quality") == 0, "http 400: bad")
    out = {"score": F.col("toxic").cast("long"), "id": F.lit("of the reply"), "error": F.lit("of the reply")}
    return x.select(*records.record(out, F.col("doc_id").cast("string"), error))


@query("""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) <> 1 + doc_id % 3 THEN 'parse: expected ' || (1 + doc_id % 3) || ' items, got ' || len(string_split(text, chr(10))) END AS error FROM documents""")
def batch_cardinality(spark, sf_dir):
    got, want = F.size(F.split("text", "\n")), (1 + F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", records.cardinality_error(got, want).alias("error"))


@query("""SELECT page_id, 'data:text/html;base64,' || to_base64(encode(url)) AS uri FROM pages""")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.data_uri(F.encode("url", "UTF-8"), "text/html").alias("uri"))


# ---- attempts --------------------------------------------------------------------------------------------------

_STATUS = "CASE event_id % 7 WHEN 0 THEN 301 WHEN 1 THEN 400 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 429 WHEN 5 THEN 500 ELSE 503 END"


@query(f"""SELECT event_id, status, status >= 500 OR status = 429 AS retry, status >= 500 OR (status = 429 AND ra IS NULL) AS pressure, status >= 500 AS breaker_fail,
  CASE WHEN status < 400 THEN 'http ' || status || ': endpoint redirects — use the final URL' WHEN status < 500 AND status <> 429 THEN 'http ' || status || ': ' || left(props, 300)
  ELSE 'http ' || status || ' after retries: ' || left(props, 300) END AS error
FROM (SELECT event_id, props, {_STATUS} AS status, CASE WHEN event_id % 7 IN (4, 6) THEN '5' END AS ra FROM events)""")
def classify_status(spark, sf_dir):
    n = F.col("event_id") % 7
    codes = F.array(*map(F.lit, (301, 400, 404, 429, 429, 500, 503)))
    e = table(spark, sf_dir, "events").withColumn("status", F.element_at(codes, (n + 1).cast("int"))).withColumn("ra", F.when(n.isin(4, 6), "5"))
    return e.select("event_id", "status", outcomes.classify(F.col("status"), F.col("ra"), F.col("props")).alias("o")).select("event_id", "status", "o.*")


@query("""SELECT event_id, least(power(2, event_id % 9), 60)::DOUBLE AS next_delay, least(power(2, event_id % 9) / 2, 60)::DOUBLE * (value / 1000) AS wait FROM events WHERE event_id % 9 > 0""")
def retry_ladder_wait(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 9 > 0)
    delay = F.least(F.pow(F.lit(2.0), F.col("event_id") % 9) / 2, F.lit(60.0))
    # the dice come from the table, so that the ladder repeats
    return e.select("event_id", outcomes.next_wait(delay, F.lit(None).cast("double"), F.col("value") / 1000).alias("x")).select("event_id", "x.next_delay", "x.wait")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN (event_id % 100)::DOUBLE END AS seconds FROM events""")
def retry_after_seconds(spark, sf_dir):
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.col("value").cast("string")).when(n == 1, (F.col("event_id") % 100).cast("string")).when(n == 2, "1.5.3").otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", outcomes.retry_after_seconds(text).alias("seconds"))


@query(f"""WITH {ATTEMPTS}, e AS (SELECT lane, list('e' || tokens % 3 ORDER BY at_us, event_id) FILTER (NOT ok) AS x FROM attempts GROUP BY lane)
SELECT lane, CASE WHEN x IS NULL THEN 'retry budget exhausted' WHEN x[1] = x[-1] THEN x[-1] ELSE x[-1] || ' (first attempt: ' || x[1] || ')' END AS error FROM e""")
def row_error_first_last(spark, sf_dir):
    a = attempts(spark, sf_dir)
    item = F.when(~F.col("ok"), F.struct("at", "event_id", F.concat(F.lit("e"), F.col("tokens") % 3).alias("x")))
    listed = a.groupBy("lane").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return listed.select("lane", outcomes.row_error(F.transform("xs", lambda s: s["x"])).alias("error"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/v1', '/+$', ''), '/v1$', '') AS root FROM pages""")
def server_root(spark, sf_dir):
    endpoint = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), F.lit("/v1/?key=1"))
    return table(spark, sf_dir, "pages").select("page_id", engine.server_root(endpoint).alias("root"))


@query(f"""WITH {ATTEMPTS}, m AS (SELECT *, sum(CASE WHEN pressure THEN 0 ELSE 1 END) OVER (PARTITION BY lane ORDER BY event_id) AS g FROM attempts)
SELECT lane, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM m WHERE pressure GROUP BY lane, g HAVING count(*) >= 2""")
def breaker_runs(spark, sf_dir):
    return telemetry.breaker_runs(attempts(spark, sf_dir), "event_id", F.col("pressure"), 2)


@query(f"""WITH {ATTEMPTS} SELECT event_id, row_number() OVER (PARTITION BY lane ORDER BY event_id) AS attempt,
  pressure AND sum(pressure::INT) OVER (PARTITION BY lane ORDER BY event_id) = 1 AS counted FROM attempts""")
def pressure_once_per_row(spark, sf_dir):
    return telemetry.pressure_once(attempts(spark, sf_dir), "lane", "event_id", F.col("pressure")).select("event_id", "attempt", "counted")


@query(f"""WITH {ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY event_id DESC) AS n FROM attempts WHERE ok)
SELECT lane, median(latency) AS p50, count(*) AS n FROM r WHERE n <= 16 GROUP BY lane""")
def latency_p50_last(spark, sf_dir):
    return telemetry.latency_p50(attempts(spark, sf_dir).where("ok"), "lane", "event_id", "latency", 16)


# ---- ticks, evidence, verdicts ---------------------------------------------------------------------------------


@query(f"WITH {HOURS} SELECT t, ok, bp, tokens FROM ticks")
def ticks_hourly(spark, sf_dir):
    return hours(spark, sf_dir)


@query(f"WITH {HOURS} SELECT t, (t - lag(t) OVER (ORDER BY t)) * 3600 AS gap_s, round(tokens / ((t - lag(t) OVER (ORDER BY t)) * 3600)::DOUBLE, 1) AS tok_s FROM ticks")
def tick_deltas(spark, sf_dir):
    return telemetry.tick_deltas(hours(spark, sf_dir), 3600).select("t", "gap_s", "tok_s")


@query(f"WITH {HOURS} SELECT t, bp > 0 AND bp >= 0.05::DOUBLE * (bp + ok) AS overloaded, bp / (bp + ok)::DOUBLE AS share FROM ticks")
def overloaded_ticks(spark, sf_dir):
    h = hours(spark, sf_dir)
    return h.select("t", telemetry.overloaded(F.col("bp"), F.col("ok")).alias("overloaded"), (F.col("bp") / (F.col("bp") + F.col("ok"))).alias("share"))


@query(f"""WITH {HOURS}, s AS (SELECT t, t // 24 AS epoch, ok, ok / 3600.0::DOUBLE AS rows_s FROM ticks)
SELECT t, count(*) OVER w AS n, (sum(ok) OVER w)::BIGINT AS completions,
  round(CASE WHEN count(*) OVER w > 1 THEN (sum(rows_s) OVER w - first(rows_s) OVER w) / (count(*) OVER w - 1) END, 9) AS rows_mean
FROM s WINDOW w AS (PARTITION BY epoch ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def evidence_last16(spark, sf_dir):
    s = hours(spark, sf_dir).select("t", F.floor(F.col("t") / 24).alias("epoch"), "ok", (F.col("ok") / F.lit(3600.0)).alias("rows_s"))
    return telemetry.evidence(s, "epoch", "t").select("t", "n", "completions", F.round("rows_mean", 9).alias("rows_mean"))


@query(f"""WITH {HOURS}, c AS (SELECT t, t // 24 AS lane, CASE WHEN t % 11 <> 0 THEN tokens END AS preempts FROM ticks),
l AS (SELECT *, lag(preempts) OVER (PARTITION BY lane ORDER BY t) AS p FROM c)
SELECT t, (CASE WHEN preempts IS NULL OR p IS NULL THEN 0 WHEN preempts >= p THEN preempts - p ELSE 1 END)::BIGINT AS preempted FROM l""")
def preempt_delta(spark, sf_dir):
    c = hours(spark, sf_dir).select("t", F.floor(F.col("t") / 24).alias("lane"), F.when(F.col("t") % 11 != 0, F.col("tokens")).alias("preempts"))
    return telemetry.preempt_deltas(c, "lane", "t").select("t", "preempted")


_RATES = f"""WITH {HOURS}, c AS (SELECT t AS scrape, l AS labels, (tokens * (l + 1) + t)::DOUBLE AS queries, (tokens + t * l)::DOUBLE AS hits FROM ticks, (VALUES (0), (1)) v(l) WHERE l = 0 OR t % 13 <> 0),
s AS (SELECT scrape, lag(scrape) OVER (ORDER BY scrape) AS before FROM (SELECT DISTINCT scrape FROM c)),
n AS (SELECT scrape, count(*) AS had FROM c GROUP BY scrape),
b AS (SELECT c.scrape, s.before, c.queries - p.queries AS dq, c.hits - p.hits AS dh FROM c JOIN s USING (scrape) LEFT JOIN c p ON p.scrape = s.before AND p.labels = c.labels),
g AS (SELECT scrape, before, count(*) AS has, bool_or(coalesce(dq < 0, true) OR coalesce(dh < 0, true)) AS odd, sum(dq) AS q, sum(dh) AS h FROM b GROUP BY scrape, before)
SELECT g.scrape, CASE WHEN NOT odd AND has = had AND q > 0 THEN least(h / q, 1.0) END AS rate FROM g LEFT JOIN n ON n.scrape = g.before"""


@query(_RATES)
def prefix_hit_rate(spark, sf_dir):
    both = hours(spark, sf_dir).withColumn("l", F.explode(F.array(F.lit(0), F.lit(1)))).where("l = 0 or t % 13 <> 0")
    c = both.select(F.col("t").alias("scrape"), F.col("l").alias("labels"), (F.col("tokens") * (F.col("l") + 1) + F.col("t")).cast("double").alias("queries"), (F.col("tokens") + F.col("t") * F.col("l")).cast("double").alias("hits"))
    return engine.hit_rates(c)


def _metrics_text() -> Column:
    t, n = F.col("t"), lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("# HELP vllm:num_requests_waiting queued\nvllm:num_requests_waiting{model=\"a}b\",x=\"1\"} "), n("bp"), F.lit('\nvllm:num_requests_waiting{model="c"} '), n("ok"),
        F.lit("\nvllm:kv_cache_usage_perc "), (t % 100 / 100).cast("string"), F.lit("\nvllm_kv_cache_usage_perc 0.5\nvllm:num_preemptions_total NaN\nother_metric 3\nvllm:num_requests_running +Inf\n"), F.when(t % 2 == 0, F.lit("vllm:num_requests_running 7.9")).otherwise(""),
    )


@query(f"""WITH {HOURS} SELECT t AS scrape, 'vllm' AS dialect, bp + ok AS waiting, CASE WHEN t % 2 = 0 THEN 7::BIGINT END AS running, NULL::BIGINT AS preempts, 0.5::DOUBLE AS kv, NULL::DOUBLE AS hits FROM ticks""")
def parse_gauges(spark, sf_dir):
    return engine.gauges(hours(spark, sf_dir).select(F.col("t").alias("scrape"), _metrics_text().alias("body")))


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'vllm' WHEN 'view' THEN 'sglang' WHEN 'error' THEN 'tei' END AS engine, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2""")
def metric_lookup(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "vllm_num_requests_waiting").when(F.col("event_type") == "view", "sglang:token_usage").when(F.col("event_type") == "error", "te_queue_size").otherwise("none")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("name", name)
    return e.join(F.broadcast(engine.metric_names(spark)), "name").select("event_type", "engine", "n")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'sglang' WHEN 1 THEN 'llamacpp' WHEN 2 THEN 'tei' WHEN 3 THEN 'trtllm' END AS engine, CASE WHEN event_id % 6 < 4 THEN k END AS requests,
  least(CASE WHEN event_id % 6 = 2 THEN least(512, k) ELSE 512 END, greatest(CASE WHEN event_id % 6 = 2 THEN least(2, k) ELSE 2 END, CASE WHEN event_id % 6 >= 4 THEN 64 WHEN event_id % 6 = 2 THEN k ELSE k + least(k, 16) END))::BIGINT AS start
FROM (SELECT event_id, (props->>'$.k')::BIGINT + 1 AS k FROM events)""")
def capacity_from_info(spark, sf_dir):
    n, k = F.col("event_id") % 6, (F.get_json_object("props", "$.k").cast("long") + 1).cast("string")
    path = F.element_at(F.array(*map(F.lit, ("/get_server_info", "/props", "/info", "/server_info", "/info", "/props"))), (n + 1).cast("int"))
    body = (
        F.when(n == 0, F.concat(F.lit('{"max_prefill_tokens":1,"max_running_requests":'), k, F.lit("}")))
        .when(n == 1, F.concat(F.lit('{"default_generation_settings":{},"total_slots":'), k, F.lit("}")))
        .when(n == 2, F.concat(F.lit('{"model_id":"x","max_batch_tokens":9,"max_concurrent_requests":'), k, F.lit("}")))
        .when(n == 3, F.concat(F.lit('{"disaggregated_params":0,"max_batch_size":'), k, F.lit("}")))
        .when(n == 4, F.concat(F.lit('{"max_concurrent_requests":'), k, F.lit("}")))
        .otherwise(F.lit('{"default_generation_settings":{},"total_slots":true}'))
    )
    c = table(spark, sf_dir, "events").select("event_id", engine.capacity(path, body).alias("c"))
    return c.select("event_id", "c.engine", "c.requests", engine.start_window(F.col("c.requests"), F.col("c.queues")).alias("start"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS units FROM events""")
def tei_units(spark, sf_dir):
    n = (F.col("event_id") % 6 + 1).cast("int")
    bodies = ('{"input":["a","b","c"]}', '{"inputs":[1,2,3]}', '{"inputs":["a","b"]}', '{"inputs":["a","b"]}', '{"texts":["a",1]}', "[]")
    routes = ("/embeddings", "/embed", "/predict/", "/embed", "/rerank", "/embed")
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), n)
    return table(spark, sf_dir, "events").select("event_id", engine.request_units(at(routes), at(bodies)).alias("units"))


@query("""SELECT c_custkey, greatest(w + 1, w * 9 // 8) AS above, w - greatest(1, w // 8) AS below FROM (SELECT c_custkey, 1 + c_custkey % 700 AS w FROM customer)""")
def ceiling_math(spark, sf_dir):
    w = 1 + F.col("c_custkey") % 700
    return table(spark, sf_dir, "customer").select("c_custkey", engine.above(w).cast("long").alias("above"), engine.below(w).cast("long").alias("below"))


_TICKS = f"""{HOURS}, v AS (SELECT t, ok, bp, ok % 7 / 8.0::DOUBLE AS source, tokens % 5 / 4.0::DOUBLE AS prep, bp % 3 / 4.0::DOUBLE AS sink, tokens % 3 / 2.0::DOUBLE AS acquire, t % 5 / 4.0::DOUBLE AS lag, (ok + bp) AS inflight, 20 + t % 4 AS lim, t % 3 AS workers FROM ticks),
e AS (SELECT *, prep / greatest(1, workers) AS each FROM v),
judged AS (SELECT *, CASE WHEN inflight < 0.5 * lim AND greatest(source, each, sink) >= 0.5 THEN CASE WHEN source >= each AND source >= sink THEN 'source' WHEN each >= sink THEN 'prep' ELSE 'sink' END
  WHEN workers = 0 AND prep >= 1 THEN 'prep' WHEN lag >= 1 THEN 'loop' WHEN inflight >= lim OR acquire > source + prep THEN 'engine' END AS bound_by FROM e)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    v = hours(spark, sf_dir).select("t", "ok", "bp", (c("ok") % 7 / F.lit(8.0)).alias("source"), (c("tokens") % 5 / F.lit(4.0)).alias("prep"), (c("bp") % 3 / F.lit(4.0)).alias("sink"), (c("tokens") % 3 / F.lit(2.0)).alias("acquire"), (c("t") % 5 / F.lit(4.0)).alias("lag"), (c("ok") + c("bp")).alias("inflight"), (20 + c("t") % 4).alias("lim"), (c("t") % 3).alias("workers"))
    return v.withColumn("bound_by", telemetry.bound_by(F.lit(2.0), c("source"), c("prep"), c("sink"), c("acquire"), c("lag"), c("inflight"), c("lim"), c("workers")))


@query(f"WITH {_TICKS} SELECT t, bound_by FROM judged")
def bound_by_verdict(spark, sf_dir):
    return _judged(spark, sf_dir).select("t", "bound_by")


@query(f"WITH {_TICKS} SELECT bound_by, count(*) AS n FROM judged WHERE bound_by IS NOT NULL GROUP BY 1")
def bound_by_counts(spark, sf_dir):
    return telemetry.histogram(_judged(spark, sf_dir), "bound_by")


@query(f"WITH {_TICKS} SELECT bool_or(bound_by IN ('source', 'prep', 'sink') AND inflight < 0.5 * lim) AS input_bound FROM judged")
def input_bound_any(spark, sf_dir):
    return _judged(spark, sf_dir).agg(F.bool_or(telemetry.starved(F.col("bound_by"), F.col("inflight"), F.col("lim"))).alias("input_bound"))


@query(f"""WITH {HOURS} SELECT reason, count(*) AS n FROM (SELECT CASE t % 4 WHEN 0 THEN 'cut:bp' WHEN 1 THEN 'hold' WHEN 2 THEN 'cut:queue' ELSE 'trial:up' END AS reason FROM ticks) WHERE reason LIKE 'cut:%' GROUP BY 1""")
def cut_reasons(spark, sf_dir):
    n = F.col("t") % 4
    reasons = hours(spark, sf_dir).select(F.when(n == 0, "cut:bp").when(n == 1, "hold").when(n == 2, "cut:queue").otherwise("trial:up").alias("reason"))
    return telemetry.histogram(reasons, "reason", "cut:")


@query(f"""WITH {HOURS}, r AS (SELECT t, CASE WHEN t % 10 < 8 THEN 48 ELSE 40 + t % 8 END AS running, CASE WHEN t % 6 = 0 THEN 0 ELSE 20 END AS waiting FROM ticks WHERE t % 17 <> 0),
q AS (SELECT count(*) AS ticks, count(*) FILTER (waiting > 0) AS q FROM r),
m AS (SELECT running, count(*) AS freq FROM r WHERE waiting > 0 GROUP BY 1 ORDER BY count(*) DESC, min(t) LIMIT 1)
SELECT 'server ceiling: running pinned at ' || running || ' with a standing queue for ' || (100 * q // ticks) || '% of the run — relaunch with --max-num-seqs ' || 2 * running AS hint
FROM q, m WHERE ticks >= 5 AND q / ticks::DOUBLE >= 0.5 AND running <> 0 AND freq / q::DOUBLE >= 0.7 AND running < 128""")
def advise_ceiling(spark, sf_dir):
    t = F.col("t")
    r = hours(spark, sf_dir).select("t", F.when(t % 17 != 0, F.when(t % 10 < 8, F.lit(48)).otherwise(40 + t % 8)).alias("running"), F.when(t % 6 == 0, 0).otherwise(20).alias("waiting"))
    return telemetry.advise_ceiling(r, "vllm", 128)


#: A run whose client side is slow: each third of its ticks is bound by another of its stages.
_BUSY = f"""{_TICKS}, busy AS (SELECT t - (SELECT min(t) FROM judged) AS t, ok, bp, prep, source, lag, CASE row_number() OVER (ORDER BY t) % 3 WHEN 0 THEN 'prep' WHEN 1 THEN 'source' ELSE 'loop' END AS bound_by FROM judged)"""


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, at = _judged(spark, sf_dir), Window.orderBy("t")
    bound = F.element_at(F.array(*map(F.lit, ("prep", "source", "loop"))), (F.row_number().over(at) % 3 + 1).cast("int"))
    t = F.col("t") - F.min("t").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return j.select(t.alias("t"), "ok", "bp", bound.alias("bound_by"), F.col("prep").alias("prep_s"), F.col("source").alias("source_s"), F.col("lag").alias("loop_lag_s"), (F.col("ok") + F.col("bp")).alias("prep_n"))


@query(f"""WITH {_BUSY}, a AS (SELECT count(*) AS n, count(*) FILTER (bound_by = 'prep') AS p, count(*) FILTER (bound_by = 'source') AS s, count(*) FILTER (bound_by = 'loop') AS l,
  sum(prep) AS sp, sum(ok + bp) AS rows_, sum(source) AS ss, sum(lag) AS sl, max(t) AS t FROM busy)
SELECT CASE WHEN n >= 3 AND p / n::DOUBLE >= 0.3 THEN round_even(1000 * sp / greatest(1, rows_), 0)::BIGINT END AS prep_ms, CASE WHEN n >= 3 AND s / n::DOUBLE >= 0.3 THEN round_even(1000 * ss / greatest(1, rows_), 0)::BIGINT END AS source_ms,
  CASE WHEN n >= 3 AND l / n::DOUBLE >= 0.3 THEN least(100, round_even(100 * sl / greatest(t, 1e-9), 0)::BIGINT) END AS loop_pct FROM a""")
def advise_input(spark, sf_dir):
    return telemetry.advise_input(_busy(spark, sf_dir))


@query(f"""WITH {HOURS} SELECT count(*) AS ticks, max(tokens) AS max_tokens, round(avg(tokens), 6) AS mean_tokens, (arg_max(tokens, t) - arg_min(tokens, t))::BIGINT AS change, max(ok) AS max_ok FROM ticks""")
def telemetry_rollup(spark, sf_dir):
    return telemetry.rollup(hours(spark, sf_dir))


@query("""WITH r AS (SELECT user_id % 10 AS cell, CASE event_type WHEN 'click' THEN 'auto' WHEN 'purchase' THEN 'warmup' ELSE event_type END AS arm, value AS rate, event_id % 9 = 4 AS failed, event_id % 7 <> 2 AS every FROM events),
m AS (SELECT cell, arm, median(rate) FILTER (NOT failed AND every AND rate > 0) AS med, count(*) FILTER (failed OR NOT every OR rate <= 0) AS dropped FROM r WHERE arm <> 'warmup' GROUP BY 1, 2)
SELECT cell, round(max(med) FILTER (arm = 'auto') / max(med) FILTER (arm <> 'auto'), 9) AS score, sum(dropped)::BIGINT AS dropped FROM m GROUP BY cell""")
def matrix_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    arm = F.when(F.col("event_type") == "click", "auto").when(F.col("event_type") == "purchase", "warmup").otherwise(F.col("event_type"))
    failed, ok = (F.col("event_id") % 9 == 4).cast("long"), F.when(F.col("event_id") % 7 == 2, 99).otherwise(100)
    runs = e.select((F.col("user_id") % 10).alias("cell"), arm.alias("arm"), F.col("value").alias("rate"), ok.alias("ok"), failed.alias("failed"), F.lit(100).alias("rows"))
    return telemetry.window_scores(runs).withColumn("score", F.round("score", 9))


@query("""SELECT lang, median(n_chars)::DOUBLE AS median, quantile_cont(n_chars, 0.9)::DOUBLE AS p90 FROM documents GROUP BY lang""")
def bench_statistics(spark, sf_dir):
    return telemetry.spread(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query(f"""WITH {ATTEMPTS} SELECT lane, round(sum(tokens) / 60.0::DOUBLE, 1) AS tokens_per_s FROM attempts GROUP BY lane""")
def tokens_per_sec(spark, sf_dir):
    return telemetry.token_rate(attempts(spark, sf_dir), "lane", 60)


@query(f"""WITH {HOURS} SELECT t, (sum(2) OVER (ORDER BY t))::DOUBLE AS clock_s FROM ticks""")
def running_clock(spark, sf_dir):
    return telemetry.running_clock(hours(spark, sf_dir), "t", 2.0).select("t", "clock_s")


@query(f"""WITH {ATTEMPTS}, o AS (SELECT lane, event_id, at_us, lead(at_us) OVER (PARTITION BY lane ORDER BY event_id) AS done FROM attempts)
SELECT lane, max(1706745600000000 - at_us) // 1000000 AS oldest_s FROM o WHERE done IS NULL GROUP BY lane""")
def oldest_inflight(spark, sf_dir):
    return telemetry.oldest_open(attempts(spark, sf_dir), "lane", "event_id", "at", 1706745600000000)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 OR value = 0 THEN 30.0 ELSE least(value, 30.0) END::DOUBLE AS capped, CASE WHEN event_id % 5 <> 0 AND value <> 0 THEN value + 30.0 + 1800.0 END::DOUBLE AS total FROM events""")
def timeouts(spark, sf_dir):
    limit = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", outcomes.capped_timeout(limit, 30).alias("capped"), outcomes.total_timeout(limit, F.lit(30.0), F.lit(1800.0)).alias("total"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(replace(url, '/', '--'), '[^A-Za-z0-9._@-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", outcomes.slug(F.col("url")).alias("slug"))


@query(f"""WITH {HOURS}, v AS (SELECT t, t // 120 AS lane, CASE WHEN t % 6 < 3 THEN 0 ELSE ok END AS ok, 20 + t % 2 AS inflight, 21 AS lim FROM ticks),
m AS (SELECT *, ok = 0 AND inflight >= lim AS silent, sum(CASE WHEN ok = 0 AND inflight >= lim THEN 0 ELSE 1 END) OVER (PARTITION BY lane ORDER BY t) AS g FROM v)
SELECT t, sum(CASE WHEN silent THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY lane, g ORDER BY t) AS silent_s FROM m""")
def silent_seconds(spark, sf_dir):
    t = F.col("t")
    v = hours(spark, sf_dir).select("t", F.floor(t / 120).alias("lane"), F.when(t % 6 < 3, 0).otherwise(F.col("ok")).alias("ok"), (20 + t % 2).alias("inflight"), F.lit(21).alias("lim"))
    return telemetry.silent_seconds(v, "t", "lane", 2.0).select("t", "silent_s")


@query(f"""WITH {HOURS} SELECT t, ok - least(bp, ok) AS processed, bp + least(bp, ok) AS failed FROM ticks""")
def demotion_recount(spark, sf_dir):
    h = hours(spark, sf_dir).select("t", telemetry.recounted(F.col("ok"), F.col("bp"), F.col("bp")).alias("r"))
    return h.select("t", "r.*")


@query("""SELECT event_id, round_even(value, 1) AS t, round_even(value / 3, 3) AS seconds FROM events""")
def tick_rounding(spark, sf_dir):
    t, _, seconds = telemetry.rounded_tick(F.col("value"), F.col("value"), F.col("value") / 3)
    return table(spark, sf_dir, "events").select("event_id", t.alias("t"), seconds.alias("seconds"))


@query(f"""WITH {STORED} SELECT (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 3)::BIGINT AS rank, count(*) AS left_to_do FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM states) GROUP BY 1""")
def fanout_by_rank(spark, sf_dir):
    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id"), id_key="doc_id")
    each = None
    for rank in range(3):
        left = resume.skip_done(ids.shard_select(rows, rank, 3), stored(spark, sf_dir), "doc_id")
        one = left.select(F.lit(rank).cast("long").alias("rank"))
        each = one if each is None else each.union(one)
    return each.groupBy("rank").agg(F.count("*").alias("left_to_do"))


# ---- more of rows, engines and windows --------------------------------------------------------------------------


@query("""SELECT 'batch-' || lpad((pos // 50)::VARCHAR, 5, '0') AS id, count(*) AS n, list(lang ORDER BY pos) AS items
FROM (SELECT lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY pos // 50""")
def request_batches(spark, sf_dir):
    rows = resume.by_position(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return records.batched(rows, "pos", "lang", 50)


@query("""SELECT 'run-' || i AS id, '[run] Summarise in one sentence (item ' || i || '): ' || array_to_string(list_transform(range(6), lambda j: ['red', 'blue', 'green', 'grey', 'pink'][(i * 7 + j * 3) % 5 + 1]), ' ') AS text FROM (SELECT event_id AS i FROM events)""")
def prompt_templates(spark, sf_dir):
    return records.template_rows(table(spark, sf_dir, "events"), "event_id", "run", ("red", "blue", "green", "grey", "pink"), 6).select("id", "text")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 50)::DOUBLE WHEN 1 THEN greatest(epoch_us(date_trunc('second', ts)) // 1000000 - 1706000000, 0)::DOUBLE END AS seconds FROM events""")
def retry_after_dates(spark, sf_dir):
    n = F.col("event_id") % 3
    date = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    text = F.when(n == 0, (F.col("event_id") % 50).cast("string")).when(n == 1, date).otherwise("Tomorrow, 01 Jan")
    return table(spark, sf_dir, "events").select("event_id", outcomes.retry_after_seconds(text, F.lit(1706000000)).alias("seconds"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 * k WHEN 1 THEN k + 1 WHEN 3 THEN k END AS requests FROM (SELECT event_id, (props->>'$.k')::BIGINT + 1 AS k FROM events)""")
def rank_capacity_sum(spark, sf_dir):
    k, n = (F.get_json_object("props", "$.k").cast("long") + 1).cast("string"), F.col("event_id") % 5
    rank = lambda x: F.concat(F.lit('{"num_running_reqs":3,"max_running_requests":'), x, F.lit("}"))
    body = (
        F.when(n == 0, F.concat(F.lit('{"loads":['), rank(k), F.lit(","), rank(k), F.lit("]}")))
        .when(n == 1, F.concat(F.lit("["), rank(k), F.lit(","), rank(F.lit("1")), F.lit("]")))
        .when(n == 2, F.concat(F.lit("["), rank(k), F.lit(","), rank(F.lit("true")), F.lit("]")))
        .when(n == 3, rank(k))
        .otherwise(F.lit('{"loads":[]}'))
    )
    return table(spark, sf_dir, "events").select("event_id", engine.capacity(F.lit("/v1/loads"), body)["requests"].alias("requests"))


@query("""SELECT c_custkey, greatest(2, least(CASE WHEN c % 3 = 0 THEN 512 ELSE least(512, g - greatest(1, g // 8)) END, n))::BIGINT AS clamped,
  greatest(3 * t, CASE WHEN c % 4 > 0 THEN 3 * (c % 5) / 2.0 ELSE 0 END)::DOUBLE AS patience, CASE WHEN b = 0 THEN 'Infinity'::DOUBLE ELSE a / b END AS ratio, (c + 2 * (c % 5) * greatest(1.0, w))::DOUBLE AS settled
FROM (SELECT c_custkey, c_custkey AS c, c_custkey % 900 AS n, 1 + c_custkey % 300 AS g, 1 + c_custkey % 2 AS t, (c_custkey % 11)::DOUBLE AS a, (c_custkey % 6)::DOUBLE AS b, (c_custkey % 4 / 2.0)::DOUBLE AS w FROM customer)""")
def window_bounds(spark, sf_dir):
    c = F.col("c_custkey")
    ceiling, latency = F.when(c % 3 != 0, 1 + c % 300), F.when(c % 4 > 0, c % 5 / F.lit(2.0))
    ratio = engine.throughput_ratio(F.when(c % 2 == 0, c % 11).cast("double"), (c % 11).cast("double"), (c % 6).cast("double"), (c % 6).cast("double"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", engine.clamped(c % 900, ceiling).alias("clamped"), engine.patience((1 + c % 2).cast("double"), latency).alias("patience"),
        ratio.alias("ratio"), engine.settled_by(c.cast("double"), (c % 5).cast("double"), c % 4 / F.lit(2.0)).alias("settled"),
    )


# The texts of the hints are shown as they are here.
@query(f"""WITH {_BUSY}, a AS (SELECT count(*) AS n, count(*) FILTER (bound_by = 'prep') AS p, count(*) FILTER (bound_by = 'source') AS s, count(*) FILTER (bound_by = 'loop') AS l,
  sum(prep) AS sp, sum(ok + bp) AS rows_, sum(source) AS ss, sum(lag) AS sl, max(t) AS t FROM busy)
SELECT 'PREP-BOUND: prep is still the bottleneck at 4 workers (' || round_even(1000 * sp / greatest(1, rows_), 0)::BIGINT || ' ms/row): raise prepare_workers, or move the work to prepare_ahead with a process pool' AS hint FROM a WHERE n >= 3 AND p / n::DOUBLE >= 0.3
UNION ALL SELECT 'SOURCE-BOUND: the source took ' || round_even(1000 * ss / greatest(1, rows_), 0)::BIGINT || ' ms/row; prefetch it (prepare_ahead / bucket_rows(prefetch=)), select fewer columns, or shard the input' FROM a WHERE n >= 3 AND s / n::DOUBLE >= 0.3
UNION ALL SELECT 'LOOP-BOUND: the event loop was blocked ' || least(100, round_even(100 * sl / greatest(t, 1e-9), 0)::BIGINT) || '% of the run (parse, and any to_request share under the prep threshold); keep parse cheap and move to_request work off the loop' FROM a WHERE n >= 3 AND l / n::DOUBLE >= 0.3""")
def input_hints(spark, sf_dir):
    return telemetry.input_hints(telemetry.advise_input(_busy(spark, sf_dir)), 4)


@query("""SELECT n_name, substr(sha1('bytes-v1:[["n_comment"]]' || chr(10) || '{"n_comment": "' || sha1(n_comment) || '", "n_name": ' || to_json(n_name)::VARCHAR || ', "n_nationkey": ' || n_nationkey || ', "share": ' || (n_nationkey / 4.0::DOUBLE)::VARCHAR || '}'), 1, 16) AS id
FROM (SELECT *, n_name || ' bytes' AS n_comment FROM nation)""")
def bytes_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.encode(F.concat("n_name", F.lit(" bytes")), "UTF-8").alias("n_comment"), (F.col("n_nationkey") / F.lit(4.0)).alias("share"))
    return ids.with_id(n).select("n_name", "id")


@query(f"""WITH {HOURS} SELECT count(*) AS ticks, sum(ok)::BIGINT AS ok, sum(bp)::BIGINT AS bp, max(t)::DOUBLE AS last FROM ticks""")
def telemetry_scan(spark, sf_dir):
    """Ticks written by the log of a run, one for each task that has some, then read back."""
    from .sources import telemetry as ticks

    folder = scratch(spark)
    ticks.write_ticks(hours(spark, sf_dir).select(F.col("t").cast("double").alias("t"), "ok", "bp", F.lit("hold").alias("reason")).repartition(3), folder)
    return ticks.read_ticks(spark, folder).agg(F.count("*").alias("ticks"), F.sum("ok").alias("ok"), F.sum("bp").alias("bp"), F.max("t").alias("last"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 11 = 3 THEN 'http 400: refused' WHEN doc_id % 11 = 4 THEN 'client: ValueError: no reply' END AS error,
  CASE WHEN doc_id % 11 NOT IN (3, 4) THEN length(text)::BIGINT END AS size FROM documents""")
def pump_local_model(spark, sf_dir):
    """The call stage with a local function in place of an endpoint."""
    from pyspark.sql import types as T

    from .plans.calls import Failed

    def send(body: dict) -> dict:
        if body["n"] % 11 == 3:
            raise Failed("http 400: refused")
        return {"size": len(body["text"])} if body["n"] % 11 != 4 else {}

    def parse(row: dict, reply: dict) -> dict:
        if "size" not in reply:
            raise ValueError("no reply")
        return {"size": reply["size"]}

    rows = ids.with_id(table(spark, sf_dir, "documents").select("doc_id", "text"), id_key="doc_id")
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("error", T.StringType()), T.StructField("size", T.LongType())])
    return call_rows(rows, lambda row: {"n": row["doc_id"], "text": row["text"]}, send, parse, out, Policy(window=4, attempts=1))


from . import catalog_live  # noqa: E402, F401  registers its queries
