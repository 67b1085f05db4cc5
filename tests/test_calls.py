"""The call stage's edges: values of every type, faults of every kind, budgets, and who lands when a run ends early."""

import datetime
import decimal
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import types as T

from millrace.functions import ids
from millrace.operators import resume
from millrace.plans import pump as pumping
from millrace.plans.calls import Breaker, Failed, InputFailed, Meter, Policy, Request, ServerLost, attempt, call_rows, ended_calls, two_argument_parse
from millrace.plans.pump import SinkFailed, pump
from millrace.plans.requests import HttpSender, Upload, proxy_of, retry_after
from millrace.sources import output, sinks

OUT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "error", "said")])
ONE = Policy(window=3, attempts=1)


def test_rows_reach_a_sender_as_plain_values(spark):
    kind = "id string, n long, xs array<string>, s struct<a:int,b:array<double>>, m map<string,int>, d decimal(5,2), t timestamp, day date, raw binary, f float"
    full = ("a", 2**60 + 1, ["x", None], {"a": 1, "b": [0.5]}, {"k": 7}, decimal.Decimal("1.50"), datetime.datetime(2020, 1, 2, 3), datetime.date(2020, 1, 2), b"zz", 0.5)
    rows = spark.createDataFrame([full, ("b", *[None] * 9)], kind)
    plain = lambda row: {"row": repr({k: row[k] for k in ("n", "xs", "s", "m", "d", "day", "raw", "f")}), "json": json.dumps([row["n"], row["xs"], row["s"]])}
    got = {r.id: json.loads(r.said) for r in call_rows(rows, plain, lambda body: body, lambda reply: {"said": json.dumps(reply)}, OUT, ONE).collect()}
    assert got["a"]["row"] == "{'n': 1152921504606846977, 'xs': ['x', None], 's': {'a': 1, 'b': [0.5]}, 'm': {'k': 7}, 'd': Decimal('1.50'), 'day': datetime.date(2020, 1, 2), 'raw': b'zz', 'f': 0.5}"
    assert json.loads(got["a"]["json"]) == [2**60 + 1, ["x", None], {"a": 1, "b": [0.5]}]
    assert json.loads(got["b"]["json"]) == [None, None, None]


def test_every_fault_of_a_row_is_its_error(spark):
    rows = ids.with_id(spark.createDataFrame([(i,) for i in range(9)], "n int"), id_key="n")

    def send(body):
        json.dumps(body)
        return {0: lambda: 1 / 0, 1: lambda: {"said": "ok"}, 2: lambda: (_ for _ in ()).throw(Failed("http 400: no"))}.get(body["n"], lambda: {"said": body["n"]})()

    def to_request(row):
        return [1] if row["n"] == 3 else {"n": row["n"], "x": {1} if row["n"] == 4 else 0}

    def parse(row, reply):
        return [] if row["n"] == 5 else {"said": reply["none"]} if row["n"] == 6 else {"said": str(reply["said"]), **({"more": 1} if row["n"] == 7 else {})}

    got = {r.id: r.error for r in call_rows(rows, to_request, send, parse, OUT, ONE).collect()}
    assert got == {
        "0": "client: ZeroDivisionError: division by zero", "1": None, "2": "http 400: no", "3": "client: TypeError: to_request returned list, neither a dict nor a Request",
        "4": "client: TypeError: Object of type set is not JSON serializable", "5": "client: TypeError: parse must return a dict, got list", "6": "client: KeyError: 'none'",
        "7": "parse output not storable: undeclared keys: more", "8": None,
    }


def test_parse_with_one_argument_or_two():
    assert two_argument_parse(lambda reply: reply)(1, 2) == 2
    assert two_argument_parse(lambda reply, model="m": (reply, model))(1, 2) == (2, "m")
    assert two_argument_parse(lambda row, reply, x=3: (row, reply, x))(1, 2) == (1, 2, 3)
    assert two_argument_parse(max)(1, 2) == 2


class Dice:
    def uniform(self, a, b):
        return b


def tried(*outcomes, **policy):
    """(calls and their timeouts, meter, result or error) of a sender that fails as told."""
    left, calls, meter = list(outcomes), [], Meter()

    def send(body, timeout=None):
        calls.append(timeout)
        this = left.pop(0)
        if isinstance(this, Exception):
            raise this
        return this

    try:
        out = attempt(send, {"n": 1}, Policy(**({"first_delay": 0, "attempts": 5} | policy)), Breaker(99), Dice(), meter)
    except Failed as e:
        out = str(e)
    return calls, meter, out


def test_what_is_pressure_and_what_counts_once():
    down, paced, junk = Failed("http 500 after retries: ", True, True, pressure=True), Failed("http 429 after retries: ", True, wait=0, pressure=False), Failed("no JSON", True, True, pressure=False)
    assert tried(down, down, {})[1].pressure == 1
    assert tried(paced, junk, {})[1].pressure == 0
    assert tried(ConnectionResetError("x"), {})[1].pressure == 1
    assert tried(OSError("a"), TimeoutError("b"), attempts=2)[2] == "transport: TimeoutError: b (first attempt: transport: OSError: a)"


def test_a_retry_ends_with_the_budget():
    calls, meter, _ = tried(Failed("x", True), Failed("x", True), {}, budget_s=5)
    assert calls[0] is None and 4 < calls[1] <= 5 and calls[2] <= calls[1] and meter.retries == 2
    began = time.monotonic()
    calls, _, said = tried(*[Failed("x", True, wait=10)] * 5, budget_s=0.2)
    assert time.monotonic() - began < 2 and len(calls) == 1 and said == "x"
    assert tried(Failed("x", True), {}, budget_s=float("inf"))[0] == [None, None]


def test_odd_headers_cost_a_backoff_and_proxies_spare_this_machine(monkeypatch):
    assert [retry_after(x, 0) for x in ("²", "١", "1e3", "-1", " ", ".5", "3.")] == [None, None, None, None, None, 0.5, 3.0]
    monkeypatch.setenv("http_proxy", "http://proxy:3128")
    monkeypatch.setenv("no_proxy", "inside.example")
    found = {x: proxy_of(f"http://{x}/v1") for x in ("far.example", "inside.example:80", "localhost:8000", "127.0.0.9", "[::1]:80", "a.localhost")}
    assert found == {"far.example": "http://proxy:3128", **dict.fromkeys(["inside.example:80", "localhost:8000", "127.0.0.9", "[::1]:80", "a.localhost"])}


def test_a_request_through_a_proxy_names_the_whole_address():
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["Host"]))
            self.send_response(200)
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert HttpSender("http://far.example:81/v1", "/chat", 5, proxy=f"127.0.0.1:{server.server_port}")({"a": 1}) == {}
    server.shutdown()
    assert seen == [("http://far.example:81/v1/chat", "far.example:81")]


def test_uploads_say_what_they_are(tmp_path):
    (tmp_path / "a.wav").write_bytes(b"abc")
    with open(tmp_path / "a.wav", "rb") as f:
        f.read(2)
        request = Request(files={"x": f, "y": ("n.txt", bytearray(b"q"), "text/plain"), "z": Upload(b"1", "own")})
        assert not request.resendable
        body, kind = request.encoded()
    assert b'name="x"; filename="a.wav"' in body and b"\r\n\r\nabc\r\n" in body and b'filename="n.txt"\r\nContent-Type: text/plain' in body and kind.startswith("multipart/form-data; boundary=")
    with pytest.raises(TypeError):
        Request(files={"x": ("only a name",)})


def test_finished_records_leave_while_the_input_is_slow():
    def rows():
        for i in range(3):
            yield {"id": str(i)}
        time.sleep(1.5)
        yield {"id": "3"}

    began, at = time.monotonic(), {}
    for records in ended_calls(rows(), lambda row: {}, lambda body: {"said": "x"}, lambda reply: reply, OUT, ONE):
        at.update(dict.fromkeys(records["id"].to_pylist(), time.monotonic() - began))
    assert len(at) == 4 and max(at[i] for i in "012") < 1 < at["3"]


# ---- who lands when a run ends early, and what the next run does


def all_rows(spark, n=60):
    return ids.with_id(spark.createDataFrame([(i,) for i in range(n)], "n int").coalesce(1), id_key="n")


def landed(spark, path):
    return {r.id for r in output.id_errors(spark, path).where("error is null").collect()}


def test_the_input_fails(tmp_path):
    def rows():
        for i in range(7):
            yield {"id": str(i)}
        raise OSError("the line broke")

    got = []
    with pytest.raises(InputFailed, match="OSError: the line broke"):
        for records in ended_calls(rows(), lambda row: {}, lambda body: time.sleep(0.1) or {"said": "x"}, lambda reply: reply, OUT, ONE):
            got += records["id"].to_pylist()
    assert sorted(got) == [str(i) for i in range(7)]


def test_the_server_is_lost(spark, tmp_path):
    path = str(tmp_path / "o")

    def send(body):
        if body["n"] >= 20:
            raise Failed("http 503 after retries: ", True, True)
        return {"said": "x"}

    policy = Policy(window=2, attempts=4, first_delay=0, breaker=3, probe_s=0.05, open_s=0.2)
    probes = lambda body: send(body) if "n" in body else (_ for _ in ()).throw(Failed("down", True, True))
    with pytest.raises(ServerLost, match="circuit breaker open"):
        pump(all_rows(spark), lambda row: {"n": row["n"]}, probes, lambda reply: reply, path, OUT, policy=policy, fail_fast=0)
    assert landed(spark, path) == {str(i) for i in range(20)} and not list((tmp_path / "o/__millrace/runs").glob("*"))
    again = pump(all_rows(spark), lambda row: {}, lambda body: {"said": "y"}, lambda reply: reply, path, OUT, policy=policy)
    assert (again.rows_done_prior, again.rows_processed) == (20, 40)


class Breaking(sinks.PartsSink):
    """A sink that meets a full disk after some records."""

    def rows(self, schema):
        rows, held = super().rows(schema), []
        add = rows.add_batch

        def failing(records):
            if sum(held) >= 10:
                raise OSError("disk full")
            held.append(records.num_rows)
            return add(records)

        rows.add_batch = failing
        return rows


def test_the_sink_fails(spark, tmp_path):
    path = str(tmp_path / "o")
    with pytest.raises(SinkFailed, match="OSError: disk full"):
        pump(all_rows(spark), lambda row: {}, lambda body: time.sleep(0.02) or {"said": "x"}, lambda reply: reply, Breaking(path, flush_rows=1), OUT, policy=Policy(window=2, attempts=1), fail_fast=0)
    before = landed(spark, path)
    done = pump(all_rows(spark), lambda row: {}, lambda body: {"said": "x"}, lambda reply: reply, path, OUT)
    assert 0 < len(before) < 60 and done.rows_done_prior == len(before) and len(landed(spark, path)) == 60


def test_the_first_of_several_failures_is_raised(spark):
    ended = spark.createDataFrame([(1, 0, None, 9.0, None), (1, 0, "sink", 3.0, "later"), (2, 1, "server", 2.0, "earlier")], pumping.ENDED)
    with pytest.raises(ServerLost, match="earlier"):
        pumping._stored_rows(ended, sinks.PartsSink("/nowhere"), "x", 1)
    assert pumping._stored_rows(ended.where("ended is null"), sinks.PartsSink("/nowhere"), "x", 1) == (1, 0)


def test_an_interruption_stops_the_tasks_and_keeps_what_has_ended(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "o"), pumping.InheritableThread.join
    state = {"joined": 0}

    def join(thread, timeout=None):
        state["joined"] += 1
        if state["joined"] == 1:
            real(thread, 6)
            raise KeyboardInterrupt
        return real(thread, timeout)

    monkeypatch.setattr(pumping.InheritableThread, "join", join)
    with pytest.raises(KeyboardInterrupt):
        pump(all_rows(spark, 400), lambda row: {}, lambda body: time.sleep(0.1) or {"said": "x"}, lambda reply: reply, path, OUT, policy=Policy(window=2, attempts=1), fail_fast=0)
    monkeypatch.undo()
    kept = landed(spark, path)
    assert 10 < len(kept) < 400 and state["joined"] == 2 and not list((tmp_path / "o/__millrace/runs").glob("*.done"))
    stats = pump(all_rows(spark, 400), lambda row: {}, lambda body: {"said": "y"}, lambda reply: reply, path, OUT)
    assert stats.rows_done_prior == len(kept)


# ---- the plan of a run, and ids as file names


def test_one_resume_join_and_the_counts_it_makes(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 50), i, "t" * 10) for i in range(80)], "id string, n int, wide string")
    prior = spark.createDataFrame([(str(i), "e" if i % 3 else None) for i in range(20)], "id string, error string")

    seen = []
    for retry in (False, True):
        output.append(prior.selectExpr("*", "'old' as said"), str(tmp_path / f"o{retry}"))
        stats = pump(rows, lambda row: {"n": row["n"]}, lambda body: {"said": str(body["n"])}, lambda reply: reply, str(tmp_path / f"o{retry}"), OUT, order="n", retry_errors=retry, fail_fast=0)
        want = resume.resume_counts(rows, prior, retry).first()
        assert (stats.rows_total, stats.rows_done_prior, stats.rows_errored_prior, stats.rows_deduped, stats.rows_processed) == tuple(want)
        seen.append({r.id: r.said for r in output.read_output(spark, str(tmp_path / f"o{retry}")).collect()})
    old = {str(i): "old" for i in range(0, 20, 3)}
    assert seen[0] == old | {str(i): str(i) for i in range(20, 50)} and seen[1] == old | {str(i): str(i) for i in range(50) if i >= 20 or i % 3}
    states = resume.resume_states(rows, prior)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and not [line for line in plan.split("\n") if "wide" in line and "LogicalRDD" not in line]


def test_files_are_known_by_their_ids(spark, tmp_path):
    names = ["a+b", "c%20d", "e f", "é", "100%", "x.txt", "#1"]
    rows = spark.createDataFrame([(n,) for n in names], "id string")
    sink = sinks.FilesSink(str(tmp_path / "f"), ".txt", "said")
    run = lambda said: pump(rows, lambda row: {}, lambda body: {"said": said}, lambda reply: reply, sink, OUT, fail_fast=0)
    assert sink.known(spark).count() == 0 and not (tmp_path / "f").exists()
    assert run("first").rows_processed == len(names)
    again = run("second")
    assert (again.rows_done_prior, again.rows_processed) == (len(names), 0)
    assert {p.name: p.read_text() for p in (tmp_path / "f").iterdir()} == {f"{n}.txt": "first" for n in names}
