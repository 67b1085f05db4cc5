import io
import json
import random
import threading
import time
from decimal import Decimal
from fractions import Fraction
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import types as T

from millrace.functions import ids
from millrace.operators import resume
from millrace.plans import requests
from millrace.plans.calls import Breaker, Failed, Policy, Request, ServerLost, attempt, call_rows, ended_calls, http_json
from millrace.plans.pump import AllFailed, pump
from millrace.settings import Interval
from millrace.sources import files, output, sinks, tables
from millrace.streaming import dedup

OUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("error", T.StringType()), T.StructField("said", T.StringType())])
QUICK = Policy(window=4, attempts=3, first_delay=0.01, longest_delay=0.02)


@pytest.fixture
def rows(spark):
    return ids.with_id(spark.createDataFrame([(f"row {i}", i) for i in range(60)], "text string, n int"), id_key="n")


def echo(body):
    if body["n"] % 10 == 3:
        raise Failed("http 400: poison")
    return {"said": body["text"].upper()}


REQUEST, PARSE = (lambda row: {"n": row["n"], "text": row["text"]}), (lambda row, reply: {"said": reply["said"], "id": "ignored"})


def test_run_resume_and_heal(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    first = pump(rows, REQUEST, echo, PARSE, path, OUT, policy=QUICK, flush_rows=7, partitions=3)
    assert (first.rows_processed, first.rows_failed, first.rows_unaccounted) == (54, 6, 0)
    again = pump(rows, REQUEST, echo, PARSE, path, OUT, policy=QUICK)
    assert (again.rows_done_prior, again.rows_errored_prior, again.rows_processed) == (60, 6, 0)
    healed = pump(rows, REQUEST, lambda body: {"said": "ok"}, PARSE, path, OUT, policy=QUICK, retry_errors=True)
    assert (healed.rows_processed, healed.rows_failed) == (6, 0)
    got = {r.id: r.said for r in output.read_output(spark, path).collect()}
    assert got == {str(i): "ok" if i % 10 == 3 else f"ROW {i}" for i in range(60)}
    audit = resume.output_audit(output.parts(spark, path)).first().asDict()
    assert audit == {"records": 66, "unique_ids": 60, "repeated_ids": 6, "errors": 6}
    assert list((tmp_path / "out/__millrace/runs").glob("*.done"))


def test_shards_are_disjoint_and_cover(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    for rank in range(3):
        pump(rows, REQUEST, echo, PARSE, path, OUT, policy=QUICK, shard=(rank, 3), fail_fast=0)
    assert resume.output_audit(output.parts(spark, path)).first()["unique_ids"] == 60
    assert output.parts(spark, path).count() == 60
    stats = [json.loads(f.read_text()) for f in (tmp_path / "out/__millrace/runs").glob("*.done")]
    assert sorted((s["rank"], s["world"]) for s in stats) == [(k, 3) for k in range(3)] and sum(s["rows_processed"] + s["rows_failed"] for s in stats) == 60


def test_all_failed_stores_nothing(spark, rows, tmp_path):
    def refuse(body):
        raise Failed("http 400: no")

    with pytest.raises(AllFailed):
        pump(rows, REQUEST, refuse, PARSE, str(tmp_path / "out"), OUT, policy=QUICK)
    assert output.id_errors(spark, str(tmp_path / "out")).count() == 0


def test_finished_rows_survive_a_killed_job(spark, rows, tmp_path):
    path = str(tmp_path / "out")

    def die(frames):
        for f in frames:
            if (f.n == 59).any():
                raise RuntimeError("killed")
            # more than the pipes between the workers hold
            yield f.assign(said="x" * 50_000, error=None)[["id", "error", "said"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        with pytest.raises(Exception, match="killed"):
            output.append(rows.repartition(1).sortWithinPartitions("n").mapInPandas(die, OUT), path, flush_rows=5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = output.id_errors(spark, path).count()
    assert 0 < kept < 60
    done = pump(rows, REQUEST, echo, PARSE, path, OUT, policy=QUICK, fail_fast=0)
    assert (done.rows_done_prior, done.rows_processed + done.rows_failed) == (kept, 60 - kept)


def test_parts_without_manifest_and_unreadable_files(spark, rows, tmp_path):
    path = tmp_path / "out"
    pump(rows, REQUEST, echo, PARSE, str(path), OUT, policy=QUICK, fail_fast=0)
    victim = sorted((path / "__millrace/manifest").glob("*.parquet"))[0]
    victim.unlink()
    (path / "part-9999999999999-000000-broken00.parquet").write_bytes(b"not parquet")
    assert output.id_errors(spark, str(path)).select("id").distinct().count() == 60


def test_unstorable_replies_are_error_rows(spark, rows, tmp_path):
    bad = lambda row, reply: {"said": row["n"]} if row["n"] == 5 else {"said": "s", "more": 1} if row["n"] == 6 else {"said": "s"}
    pump(rows, REQUEST, lambda body: {}, bad, str(tmp_path / "o"), OUT, policy=QUICK)
    errors = {r.id: r.error for r in output.id_errors(spark, str(tmp_path / "o")).where("error is not null").collect()}
    assert set(errors) == {"5", "6"} and all(e.startswith("parse output not storable") for e in errors.values())


def test_over_http_with_faults(spark, tmp_path):
    """Fault plan: once 500, once 429, once no JSON, a dropped line recover; always 400 and always 500 do not."""
    seen, lock = {}, threading.Lock()

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            kind = body["kind"]
            with lock:
                seen[body["n"]] = n = seen.get(body["n"], 0) + 1
            status, text = 200, b'{"said": "yes"}'
            if kind == "400":
                status, text = 400, b"bad"
            elif kind == "500" or kind == "500once" and n == 1:
                status, text = 500, b"down"
            elif kind == "429once" and n == 1:
                status, text = 429, b"slow"
            elif kind == "junk" and n == 1:
                text = b"<html>"
            elif kind == "drop" and n == 1:
                self.connection.close()
                return
            self.send_response(status)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    kinds = ["ok", "500once", "429once", "junk", "drop", "400", "500"] * 3
    df = ids.with_id(spark.createDataFrame(list(enumerate(kinds)), "n int, kind string"), id_key="n")
    send = http_json(f"http://127.0.0.1:{server.server_port}/v1", "/chat", timeout=10)
    policy = Policy(window=3, attempts=3, first_delay=0.01, longest_delay=0.02, breaker=1000)
    stats = pump(df, lambda row: {"n": row["n"], "kind": row["kind"]}, send, lambda row, r: {"said": r["said"]}, str(tmp_path / "o"), OUT, policy=policy, fail_fast=0)
    server.shutdown()
    assert (stats.rows_processed, stats.rows_failed) == (15, 6)
    errors = {r.error for r in output.id_errors(spark, str(tmp_path / "o")).where("error is not null").collect()}
    assert errors == {"http 400: bad", "http 500 after retries: down"}


def test_table_and_file_sources(spark, tmp_path):
    spark.createDataFrame([("alpha", "a1"), ("beta", "b2"), ("gamma", "c3"), ("alpha", "a4")], "text string, key string").coalesce(1).write.parquet(str(tmp_path / "t"))
    at = lambda **k: [r.id for r in tables.table_rows(spark, str(tmp_path / "t"), **k).orderBy("id").collect()]
    assert at(index_parts=["train"]) == [f"train:{i:09d}" for i in range(4)]
    assert at(id_key="key", limit=3) == ["a1", "b2", "c3"]
    assert len(set(at(columns=["text"]))) == 3
    (tmp_path / "f/v1").mkdir(parents=True)
    for n, x in (("v1/a.png", b"one"), ("v1/b.png", b"two"), ("c.txt", b"no")):
        (tmp_path / "f" / n).write_bytes(x)
    found = files.file_rows(spark, f"{tmp_path}/f/*/*.png", root=str(tmp_path / "f"))
    assert {r.id: bytes(r.content) for r in found.collect()} == {"v1/a.png": b"one", "v1/b.png": b"two"}
    known = spark.createDataFrame([("v1/a.png",)], "id string")
    assert [r.id for r in files.file_rows(spark, f"{tmp_path}/f/*/*.png", root=str(tmp_path / "f"), known=known, read=False).collect()] == ["v1/b.png"]


def test_stream_admits_each_id_once(spark, tmp_path):
    schema = "k string, v int"
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    for batch in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        dedup.ingest(spark, src, schema, out, chk, id_key="k").awaitTermination()
    assert sorted(r.id for r in output.parts(spark, out).collect()) == ["a", "b", "c"]


# ---- calls and writers, without Spark


def call_inputs(n):
    return iter([{"id": str(i), "n": i, "text": "t"} for i in range(n)])


def test_records_leave_as_their_calls_end():
    def send(body):
        time.sleep(1.5 if body["n"] == 0 else 0.01)
        return {"said": "x"}

    began, at = time.monotonic(), {}
    for records in ended_calls(call_inputs(30), REQUEST, send, PARSE, OUT, Policy(window=3, attempts=1)):
        for r in records.to_pylist():
            at[r["id"]] = time.monotonic() - began
    assert len(at) == 30 and at["0"] >= 1.5 and sum(t < 1.2 for t in at.values()) == 29


def test_old_rows_are_published_although_few_have_come(tmp_path):
    sink = sinks.PartsSink(str(tmp_path / "o"), flush_rows=1000, flush_s=0.3)
    out = sink.rows(OUT)
    out.add([{"id": "1", "error": None, "said": "x"}])
    assert not list((tmp_path / "o").glob("*.parquet"))
    time.sleep(0.35)
    out.due()
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 1
    out.close()
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 1


def test_writes_are_tried_again(tmp_path, monkeypatch):
    calls, real = [], output.pq.write_table

    def flaky(*a, **k):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("full")
        real(*a, **k)

    monkeypatch.setattr(output.pq, "write_table", flaky)
    monkeypatch.setattr(output.time, "sleep", lambda s: None)
    out = sinks.PartsSink(str(tmp_path / "o")).rows(OUT)
    out.add([{"id": "1", "error": None, "said": "x"}])
    out.close()
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 1 and not list((tmp_path / "o").glob(".part*"))


def test_breaker_ends_the_run_and_its_time_is_not_the_rows():
    down, policy = Failed("http 503 after retries: ", True, True), Policy(attempts=3, first_delay=0, longest_delay=0, breaker=2, probe_s=0.05, open_s=0.3)

    def never(body):
        raise down

    with pytest.raises(ServerLost):
        attempt(never, {"n": 1}, policy, Breaker(2, 0.05, 0.3), random.Random(1))
    tries = []

    def late(body):
        tries.append(body)
        if len(tries) < 6:
            raise down
        return {"said": "x"}

    patient = Policy(attempts=3, first_delay=0, budget_s=0.1, breaker=2, probe_s=0.05, open_s=5)
    assert attempt(late, {"n": 1}, patient, Breaker(2, 0.05, 5), random.Random(1)) == {"said": "x"}
    assert requests.probe_body() in tries


def test_retry_after_is_a_number_or_a_date():
    at = 1_700_000_000
    assert [requests.retry_after(x, at) for x in (None, "", "5", "1.5", "1.5.3", "soon", "Tue, 14 Nov 2023 22:13:30 GMT", "Tue, 14 Nov 2023 22:13:10 GMT", "²", "Tue, 99 Nov 99999 22:13:10 GMT")] == [None, None, 5.0, 1.5, None, None, 10.0, 0.0, None, None]


def test_forms_headers_and_kept_connections():
    seen, lock = [], threading.Lock()

    class Stub(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            with lock:
                seen.append((self.client_address, self.path, dict(self.headers), body))
            self.send_response(200)
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = http_json(f"http://127.0.0.1:{server.server_port}/v1", "/chat", headers={"Authorization": "Bearer x"})
    form = Request(form={"model": "m"}, files={"file": ("a.wav", b"\x00\x01", "audio/wav"), "more": io.BytesIO(b"zz")}, route="/audio", headers={"X-One": "1"})
    for asked in ({"a": 1}, form, {"b": 2}):
        assert send(asked) == {}
    server.shutdown()
    assert len({s[0] for s in seen}) == 1 and [s[1] for s in seen] == ["/v1/chat", "/v1/audio", "/v1/chat"]
    assert all(s[2]["Authorization"] == "Bearer x" for s in seen) and seen[1][2]["X-One"] == "1"
    kind, body = seen[1][2]["Content-Type"], seen[1][3]
    edge = kind.split("boundary=")[1].encode()
    assert body.count(b"--" + edge) == 4 and b'filename="a.wav"\r\nContent-Type: audio/wav\r\n\r\n\x00\x01' in body and b'name="more"; filename="more"' in body
    assert form.resendable and not Request(files={"f": io.StringIO("x")}).resendable


@pytest.mark.parametrize(
    "written, value, plain",
    [
        ("[1, inf) whole", 1, 1),
        ("[1, inf) whole", np.int32(7), 7),
        ("[1, inf) whole", True, None),
        ("[1, inf) whole", 1.0, None),
        ("(0, 1]", 0, None),
        ("(0, 1]", Decimal("0.5"), 0.5),
        ("(0, 1]", Fraction(1, 4), 0.25),
        ("(0, 1]", np.float32(1), 1.0),
        ("(0, 1]", float("nan"), None),
        ("[0, 1]", Decimal("1e-400"), None),
        ("[0, 1]", Decimal(0), 0.0),
        ("[0, 1]", Decimal("sNaN"), None),
        ("[0, inf)", float("inf"), None),
        ("[0, inf]", float("inf"), float("inf")),
        ("[0, 9]", "1", None),
        ("[0, 9]", np.array([1]), None),
        ("[0, 9]", None, None),
    ],
)
def test_intervals(written, value, plain):
    if plain is None:
        with pytest.raises((TypeError, ValueError)):
            Interval(written).native(value)
    else:
        got = Interval(written).native(value)
        assert got == plain and type(got) is type(plain)


def test_an_interval_may_allow_none_and_must_be_written_as_one():
    assert Interval("[0, 9] or none").native(None) is None
    for bad in ("0..9", "[0; 9]", "[0, 9", "[a, b]"):
        with pytest.raises(ValueError):
            Interval(bad)


def test_settings_are_checked_before_a_run(rows):
    with pytest.raises(ValueError, match=r"Policy: window must be in \[1, inf\) whole; 0 is not in"):
        Policy(window=0)
    with pytest.raises(ValueError, match="pump: partitions must be in"):
        pump(rows, REQUEST, echo, PARSE, "/tmp/never", OUT, partitions=0)
    assert type(Policy(first_delay=Decimal("0.5")).first_delay) is float


# ---- sinks


def test_a_file_per_success(spark, rows, tmp_path):
    sink = sinks.FilesSink(str(tmp_path / "f"), ".txt", "said")
    odd = lambda row, reply: {"said": None if row["n"] == 7 else reply["said"]}
    stats = pump(rows, REQUEST, echo, odd, sink, OUT, policy=QUICK, partitions=3)
    assert (stats.rows_processed, stats.rows_failed) == (53, 7)
    made = {p.name: p.read_text() for p in (tmp_path / "f").iterdir()}
    assert made == {f"{i}.txt": f"ROW {i}" for i in range(60) if i % 10 != 3 and i != 7}
    again = pump(rows, REQUEST, lambda body: {"said": "new"}, PARSE, sink, OUT, policy=QUICK, fail_fast=0)
    assert (again.rows_done_prior, again.rows_processed) == (53, 7)
    assert (tmp_path / "f/3.txt").read_text() == "new"


def test_files_that_cannot_be_named(spark, tmp_path):
    unsafe = spark.createDataFrame([(f"a/{i}", i, "t") for i in range(40)], "id string, n int, text string")
    with pytest.raises(Exception, match="the first 32 records were not written"):
        pump(unsafe, REQUEST, lambda body: {"said": "x"}, PARSE, sinks.FilesSink(str(tmp_path / "g"), ".txt", "said"), OUT, policy=QUICK, fail_fast=0, partitions=1)
    for bad in ({"folder": "s3://x/y"}, {"folder": "x", "ending": "txt"}, {"folder": "x", "ending": "./a"}):
        with pytest.raises(ValueError):
            sinks.FilesSink(**bad)


def test_a_sink_of_ones_own(spark, rows, tmp_path):
    folder = str(tmp_path / "lines")

    class Lines(sinks.Rows):
        def add(self, records):
            with open(folder, "a") as f:
                f.writelines(f"{r['id']} {r['error'] or 'ok'}\n" for r in records)
            return [(r["id"], r["error"]) for r in records]

    class Own(sinks.Sink):
        def known(self, spark):
            return spark.createDataFrame([("0", None)], "id string, error string")

        def rows(self, schema):
            return Lines()

    stats = pump(rows, REQUEST, echo, PARSE, Own(), OUT, policy=QUICK, partitions=1)
    assert (stats.rows_done_prior, stats.rows_processed, stats.rows_failed) == (1, 53, 6)
    assert len(open(folder).read().splitlines()) == 59
    with pytest.raises(ValueError):
        sinks.as_sink(Own(), 10)
    with pytest.raises(TypeError):
        sinks.as_sink(7)


def test_call_rows_gives_every_row(spark, rows):
    got = {r.id: (r.error, r.said) for r in call_rows(rows, REQUEST, echo, PARSE, OUT, QUICK, together=7).collect()}
    assert got == {str(i): ("http 400: poison", None) if i % 10 == 3 else (None, f"ROW {i}") for i in range(60)}


def test_ticks_are_written_and_read(spark, rows, tmp_path):
    from millrace.sources import telemetry

    slow = lambda body: time.sleep(0.15) or echo(body)
    pump(rows, REQUEST, slow, PARSE, str(tmp_path / "o"), OUT, policy=Policy(window=2, attempts=1), fail_fast=0, partitions=1)
    got = telemetry.read_ticks(spark, str(tmp_path / "o"))
    assert got.schema.fieldNames()[:-1] == telemetry.TICK.fieldNames()
    assert got.count() >= 1 and got.where("limit <> 2 or reason <> 'hold'").count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old/telemetry-shard0-1.jsonl").write_text('{"t": 2.0, "ok": 3}\n')
    assert telemetry.read_ticks(spark, str(tmp_path / "old")).first().ok == 3
    assert telemetry.read_ticks(spark, str(tmp_path / "none")).count() == 0


def test_tick_files_are_rewritten_at_growing_intervals(tmp_path, monkeypatch):
    from millrace.sources import telemetry

    log, sizes = telemetry.TickLog(str(tmp_path)), []
    monkeypatch.setattr(log, "write", lambda: sizes.append(len(log.ticks)))
    for i in range(400):
        log.note({"t": i})
    assert sizes[:5] == [30, 60, 90, 120, 150] and sizes[-1] - sizes[-2] > 60
