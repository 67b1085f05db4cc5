"""The registered queries of what runs while rows are on their way: calls, storing, decoding, streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ATTEMPTS, HOURS, attempts_of, hours, query, request_batches, table
from .operators import records, salvage, telemetry
from .plans.ahead import prepare_ahead
from .plans.calls import Policy, call_rows
from .sources import files
from .sources.shared import scratch
from .streaming import ticks


@query("""SELECT CASE WHEN doc_id % 10 <> 3 THEN doc_id END AS doc_id, CASE WHEN doc_id % 10 <> 3 THEN coalesce(length(text), 0) END AS size, CASE WHEN doc_id % 10 <> 3 THEN lang || '/' || coalesce(source, '') END AS origin FROM documents""")
def prepared_rows(spark, sf_dir):
    def prepare(row: dict) -> dict | None:
        return None if row["doc_id"] % 10 == 3 else {"doc_id": row["doc_id"], "size": len(row["text"] or ""), "origin": f"{row['lang']}/{row['source'] or ''}"}

    return prepare_ahead(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), prepare, "doc_id long, size long, origin string", 4)


@query("""SELECT 'batch-' || lpad(b::VARCHAR, 5, '0') AS id, CASE WHEN b % 5 = 2 THEN 'client: ValueError: batch refused' WHEN b % 5 = 3 THEN 'parse output not storable: undeclared keys: more' END AS error,
  CASE WHEN b % 5 NOT IN (2, 3) THEN n END AS items, CASE WHEN b % 5 NOT IN (2, 3) THEN total END AS total, CASE WHEN b % 5 NOT IN (2, 3) THEN first END AS first
FROM (SELECT pos // 50 AS b, count(*) AS n, sum(length(lang))::BIGINT AS total, arg_min(lang, pos) AS first FROM (SELECT lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1)""")
def called_batches(spark, sf_dir):
    """Batches of rows as requests of one call each, as an embedding endpoint takes them; a local function answers."""

    def send(body: dict) -> dict:
        asked = json.loads(json.dumps(body))
        if asked["batch"] % 5 == 2:
            raise ValueError("batch refused")
        return {"data": [len(x) for x in asked["input"]], "first": asked["input"][0], "odd": asked["batch"] % 5 == 3}

    def parse(reply: dict) -> dict:
        out = {"items": len(reply["data"]), "total": sum(reply["data"]), "first": reply["first"]}
        return out | {"more": 1} if reply["odd"] else out

    kind = T._parse_datatype_string("id string, error string, items long, total long, first string")
    to_request = lambda row: {"input": row["items"], "batch": int(row["id"].removeprefix("batch-"))}
    return call_rows(request_batches(spark, sf_dir), to_request, send, parse, kind, Policy(window=4))


# Values and the columns that are to hold them; the pairs that fit are in the SQL.
_VALUES = ("null", "5", "1099511627776", "9007199254740993", "2.0", "0.5", "true", '"1"', "[1,2]", "[1,0.5]", '{"a":1}', '{"a":1,"b":2}', '{"a":{}}', "[]")
_COLUMNS = ("long", "int", "double", "boolean", "string", "array<double>", "struct<a:double>", "array<long>")


@query("""SELECT id, CASE v WHEN 0 THEN true WHEN 13 THEN true WHEN 1 THEN c IN (0, 1, 2) WHEN 2 THEN c IN (0, 2) WHEN 3 THEN c = 0 WHEN 4 THEN c = 2 WHEN 5 THEN c = 2 WHEN 6 THEN c = 3 WHEN 7 THEN c = 4
  WHEN 8 THEN c IN (5, 7) WHEN 9 THEN c = 5 WHEN 10 THEN c = 6 ELSE false END AS fits, CASE WHEN v IN (1, 2) AND c = 2 THEN (CASE v WHEN 1 THEN 5 ELSE 1099511627776 END)::DOUBLE WHEN v = 4 AND c = 2 THEN 2.0 WHEN v = 5 AND c = 2 THEN 0.5 END AS number
FROM (SELECT doc_id::VARCHAR AS id, doc_id % 14 AS v, doc_id // 14 % 8 AS c FROM documents)""")
def conformed_values(spark, sf_dir):
    """Which JSON values a column of a declared type stores."""
    n = F.col("doc_id")
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (n % len(_VALUES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.concat(F.lit('{"v":'), value, F.lit("}")).alias("body"), (F.floor(n / len(_VALUES)) % len(_COLUMNS)).alias("c"))
    out = None
    for c, kind in enumerate(_COLUMNS):
        held = records.conformed(rows.where(F.col("c") == c), "body", T._parse_datatype_string(f"id string, error string, v {kind}"))
        part = held.select("id", F.col("error").isNull().alias("fits"), (F.col("v") if kind == "double" else F.lit(None).cast("double")).alias("number"))
        out = part if out is None else out.union(part)
    return out


def _undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, out): records that clash here and there, in an order."""
    n = F.col("doc_id")
    fields = F.array_compact(
        F.array(
            F.when(n % 97 == 5, '"n":"many"').when(n % 89 == 7, '"n":"bad","extra":1').otherwise(F.concat(F.lit('"n":'), F.coalesce(F.length("text"), F.lit(0)).cast("string"))),
            F.when(n % 89 == 8, '"extra":"s"').when(n % 89 == 9, '"extra":2'),
            F.when(n % 83 == 11, '"m":9007199254740993').when(n % 79 == 3, '"m":0.5').when(n % 7 == 1, '"m":1'),
            F.when(n % 61 == 4, '"o":{"k":"x"}').when(n % 53 == 6, '"o":{"k":1,"e":{}}').when(n % 5 == 0, '"o":{"k":1,"l":[null]}').otherwise('"o":null'),
        )
    )
    return table(spark, sf_dir, "documents").select(n.alias("pos"), F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("out"))


_CLASH = """d AS (SELECT doc_id AS pos, doc_id % 97 = 5 OR doc_id % 89 IN (7, 9) AND doc_id > 8 OR doc_id = 7 OR (doc_id % 61 = 4) OR (doc_id % 53 = 6 AND doc_id % 61 <> 4) AS clash, doc_id % 83 = 11 AS big, doc_id % 83 <> 11 AND doc_id % 79 = 3 AS half FROM documents),
e AS (SELECT pos, clash OR big AND EXISTS (SELECT 1 FROM d WHERE half AND NOT clash) AS gone FROM d)"""


@query(f"WITH {_CLASH} SELECT pos, gone FROM e")
def salvaged_rows(spark, sf_dir):
    """Which records can't be stored with the others, where nothing is declared."""
    return salvage.salvaged(_undeclared(spark, sf_dir)).select("pos", F.col("error").isNotNull().alias("gone"))


@query("""SELECT * FROM (VALUES ('["extra"]', 'text'), ('["m"]', 'fraction'), ('["n"]', 'whole'), ('["o"]', 'object'), ('["o", "k"]', 'whole')) v(path, kind)
WHERE kind <> 'text' OR EXISTS (SELECT 1 FROM documents WHERE doc_id % 89 = 8 AND doc_id % 97 <> 5 AND doc_id % 61 <> 4 AND doc_id % 53 <> 6)""")
def salvaged_kinds(spark, sf_dir):
    """The columns that the records make which stay."""
    return salvage.stored_kinds(salvage.salvaged(_undeclared(spark, sf_dir)))


@query("""SELECT id, w AS width, 1 AS height, 37 + 4 * ((length('P5' || w || ' 1255') + 3 + w + 2) // 3) AS size
FROM (SELECT doc_id::VARCHAR AS id, octet_length(encode(coalesce(text, '')))::INTEGER AS w FROM documents) WHERE ('0x' || substr(sha1(id), 1, 16))::UBIGINT % 4 = 1""")
def late_decoded(spark, sf_dir):
    """A shard's texts, each the one line of a gray image: decoded after the shard is taken, and encoded for a request."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    header = F.concat(F.lit("P5\n"), F.octet_length(content).cast("string"), F.lit(" 1\n255\n"))
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.encode(header, "UTF-8"), content).alias("content"))
    return files.image_rows(images, 1 << 30, (1, 4)).select("id", "width", "height", F.length("uri").cast("long").alias("size"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # a pattern: a stream takes no single file
    return attempts_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))


@query(f"WITH {HOURS} SELECT * FROM ticks")
def streamed_ticks(spark, sf_dir):
    """Ticks as a stream makes them."""
    folder = scratch(spark)
    ticks.keep_ticks(_events(spark, sf_dir), 3600, f"{folder}/ticks", f"{folder}/state").awaitTermination()
    return ticks.kept_ticks(spark, f"{folder}/ticks")


@query(f"""WITH {ATTEMPTS}, m AS (SELECT *, sum(CASE WHEN pressure THEN 0 ELSE 1 END) OVER (PARTITION BY lane ORDER BY event_id) AS g FROM attempts)
SELECT lane, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM m WHERE pressure GROUP BY lane, g HAVING count(*) >= 2""")
def streamed_runs(spark, sf_dir):
    """Runs of failures as a stream finds them, with a state for each lane."""
    folder = scratch(spark)
    attempts = _events(spark, sf_dir).withColumn("failed", F.col("pressure"))
    ticks.keep_runs(attempts, "event_id", f"{folder}/runs", f"{folder}/state").awaitTermination()
    return ticks.kept_runs(spark, f"{folder}/runs", 2)


@query(f"""WITH {HOURS}, s AS (SELECT t, t // 24 AS epoch, ok, ok / 3600.0::DOUBLE AS rows_s, CASE WHEN t % 29 <> 0 THEN tokens / 3600.0::DOUBLE END AS tok_s, 20 + t % 40 AS lim FROM ticks),
w AS (SELECT *, count(*) OVER r AS n, sum(ok) OVER r AS done, count(tok_s) OVER r AS known, sum(tok_s) OVER r AS total, first(tok_s) OVER r AS f FROM s WINDOW r AS (PARTITION BY epoch ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT t, done >= lim AND n >= 2 AS enough, CASE WHEN n > 1 AND known - (f IS NOT NULL)::INT = n - 1 THEN round((total - coalesce(f, 0)) / (n - 1), 9) END AS tokens_mean FROM w""")
def evidence_sufficient(spark, sf_dir):
    s = hours(spark, sf_dir).select("t", F.floor(F.col("t") / 24).alias("epoch"), "ok", (F.col("ok") / F.lit(3600.0)).alias("rows_s"), F.when(F.col("t") % 29 != 0, F.col("tokens") / F.lit(3600.0)).alias("tok_s"), (20 + F.col("t") % 40).alias("lim"))
    return telemetry.sufficient(s, "epoch", "t", "lim").select("t", "enough", F.round("tokens_mean", 9).alias("tokens_mean"))
