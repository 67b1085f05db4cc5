"""The call stage: every row of a partition is sent to a function, several at a time, with retries and a breaker.

These are small helpers of a task; Spark deals out the rows and a partition has its own window of calls.  Records
leave a task as their calls end, in no order, so a slow call holds nobody up.
"""

from __future__ import annotations

import http.client
import inspect
import queue
import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import schema as lattice
from ..settings import checked
from .ahead import plain_rows
from .requests import Failed, Request, as_request, http_json, probe_body, transport

__all__ = ["Breaker", "Failed", "InputFailed", "Policy", "Request", "ServerLost", "attempt", "call_rows", "ended_calls", "http_json", "two_argument_parse"]

#: Rows that a task has read before their calls may begin.
READ_AHEAD = 64


class InputFailed(RuntimeError):
    """The rows of a task broke off; those before have been called."""


class ServerLost(RuntimeError):
    """The breaker has given up: the run ends, and no row is told that it failed."""


#: What a policy's numbers must be.
POLICY = {
    "window": "[1, inf) whole",
    "attempts": "[1, inf) whole",
    "first_delay": "[0, inf)",
    "longest_delay": "[0, inf)",
    "budget_s": "(0, inf]",
    "breaker": "[1, inf) whole",
    "probe_s": "(0, inf)",
    "open_s": "(0, inf]",
    "ramp_s": "[0, inf)",
}


@dataclass
class Policy:
    """window: calls at a time in a task.  breaker: failures in a row that open it; it ends the run after open_s.

    ramp_s: a window that opens over that time, so that many tasks do not begin all at once.
    """

    window: int = 16
    attempts: int = 5
    first_delay: float = 1.0
    longest_delay: float = 60.0
    budget_s: float = 300.0
    breaker: int = 8
    probe_s: float = 1.0
    open_s: float = 600.0
    ramp_s: float = 0.0

    def __post_init__(self) -> None:
        self.__dict__.update(checked("Policy", POLICY, asdict(self)))


@dataclass
class Meter:
    """What a task's calls have come to since the last tick; pressure counts once a row."""

    ok: int = 0
    pressure: int = 0
    retries: int = 0
    latency: float | None = None

    def taken(self) -> Meter:
        now = Meter(self.ok, self.pressure, self.retries, self.latency)
        self.ok = self.pressure = self.retries = 0
        return now


class Breaker:
    """Holds calls back after a run of failures.  One caller then tries whether the server is back, the rest wait."""

    def __init__(self, limit: int, probe_s: float = 1.0, open_s: float = 600.0):
        self.limit, self.probe_s, self.open_s, self.run, self.lost = limit, probe_s, open_s, 0, False
        self.lock, self.probing = threading.Lock(), threading.Lock()

    def note(self, failed: bool) -> None:
        with self.lock:
            self.run = self.run + 1 if failed else 0

    def gate(self, alive: Callable[[], bool]) -> float:
        """Wait while the breaker is open; the seconds that took."""
        if self.run < self.limit and not self.lost:
            return 0.0
        began = time.monotonic()
        with self.probing:
            while self.run >= self.limit and not self.lost:
                if alive():
                    self.note(False)
                elif time.monotonic() - began >= self.open_s:
                    self.lost = True
                else:
                    time.sleep(self.probe_s)
        if self.lost:
            raise ServerLost(f"circuit breaker open for {self.open_s:g}s — server is not coming back")
        return time.monotonic() - began


def _alive(send: Callable, request: Request) -> bool:
    """Whether a least request gets an answer that speaks for the server: any refusal of its own will do."""
    model = (request.body or {}).get("model")
    probe = probe_body(model if isinstance(model, str) else None)
    try:
        send(Request(probe, route=request.route, headers=request.headers) if request.route or request.headers else probe)
    except Failed as e:
        return not e.breaker
    except Exception:  # a sender of the user's own that knows no such request
        return True
    return True


def _timed(send: Callable) -> Callable[[Request | dict, float | None], dict]:
    """send with a timeout where it takes one; a sender without one can't be stopped."""
    if getattr(send, "timed", False):
        return send
    try:
        taken = inspect.signature(send).parameters
    except (TypeError, ValueError):
        taken = {}
    takes = "timeout" in taken

    def timed(body: Request | dict, left: float | None = None) -> dict:
        return send(body, timeout=left) if takes and left is not None else send(body)

    timed.timed = True
    return timed


def _what_failed(e: Exception) -> Failed:
    """A sender's exception as a failed attempt: a broken line is tried again, anything else is the row's own fault."""
    if isinstance(e, Failed):
        return e
    if isinstance(e, OSError | http.client.HTTPException):
        return transport(e)
    return Failed(f"client: {type(e).__name__}: {e}")


def attempt(send: Callable[[Request | dict], dict], asked: Request | dict, policy: Policy, breaker: Breaker, dice: random.Random, meter: Meter | None = None) -> dict:
    """Send until it works or the attempts or the budget are used up; the error names the first failure too.

    Time at an open breaker is not taken from the budget.  The first attempt may last as long as the sender allows; a
    later one begins only within the budget and ends with it.  A request with an open file is sent once.
    """
    request, errors, meter, pressed = as_request(asked), [], meter or Meter(), False
    body, timed = request if isinstance(asked, Request) else asked, _timed(send)
    delay, end = policy.first_delay, time.monotonic() + policy.budget_s
    for turn in range(policy.attempts):
        if turn and time.monotonic() >= end:
            break
        meter.retries += turn > 0
        end += breaker.gate(lambda: _alive(send, request))
        began = time.monotonic()
        try:
            reply = timed(body, end - began if turn and end - began < float("inf") else None)
        except ServerLost:
            raise
        except Exception as e:
            failed = _what_failed(e)
        else:
            breaker.note(False)
            meter.ok, meter.latency = meter.ok + 1, time.monotonic() - began
            return reply
        breaker.note(failed.breaker)
        errors.append(str(failed))
        meter.pressure += failed.pressure and not pressed
        pressed = pressed or failed.pressure
        if not failed.retry or not request.resendable or turn == policy.attempts - 1:
            break
        pause = failed.wait * dice.uniform(1, 1.2) if failed.wait is not None else dice.uniform(0, delay)
        delay = min(2 * delay, policy.longest_delay)
        time.sleep(min(pause, max(0.0, end - time.monotonic())))
    last = errors[-1]
    raise Failed(last if last == errors[0] else f"{last} (first attempt: {errors[0]})")


def two_argument_parse(parse: Callable) -> Callable[[dict, dict], dict]:
    """parse(row, reply), from that or from a function that is satisfied with the reply alone."""
    try:
        inspect.signature(parse).bind(None)
    except (TypeError, ValueError):  # it needs more, or nothing is known of it
        return parse
    return lambda row, reply: parse(reply)


class _Calls:
    """A task's threads: one reads rows ahead, so that a slow input keeps no finished record back; the others call.

    Records and the ends of callers come through `out`.  An input that breaks off is told after all its rows have ended.
    """

    END = object()

    def __init__(self, rows: Iterable[dict], one: Callable[[dict], dict], policy: Policy):
        self.rows, self.one, self.policy = rows, one, policy
        self.held: queue.SimpleQueue = queue.SimpleQueue()
        self.ahead = max(READ_AHEAD, 2 * policy.window)
        self.out: queue.SimpleQueue = queue.SimpleQueue()
        self.closed, self.broken = threading.Event(), None
        for work in (self._read, *(partial(self._call, i) for i in range(policy.window))):
            threading.Thread(target=work, daemon=True).start()

    def _read(self) -> None:
        try:
            for row in self.rows:
                if not self._hold(row):
                    return
        except Exception as e:
            self.broken = InputFailed(f"{type(e).__name__}: {e}")
        self._hold(self.END)

    def _hold(self, item: object) -> bool:
        while self.held.qsize() >= self.ahead and not self.closed.is_set():
            time.sleep(0.002)
        self.held.put(item)
        return not self.closed.is_set()

    def _call(self, number: int) -> None:
        # a window that opens over ramp_s
        self.closed.wait(self.policy.ramp_s * number / self.policy.window)
        while not self.closed.is_set():
            try:
                row = self.held.get(timeout=0.2)
            except queue.Empty:
                continue
            if row is self.END:
                self.held.put(row)  # for the next caller
                break
            try:
                self.out.put(self.one(row))
            except BaseException as e:
                self.out.put(e)
        self.out.put(self.END)

    def ended(self, tick_s: float) -> list:
        """What has come out, after tick_s at most; records, errors and ends."""
        try:
            found = [self.out.get(timeout=tick_s)]
        except queue.Empty:
            return []
        while len(found) < 1000:
            try:
                found.append(self.out.get_nowait())
            except queue.Empty:
                break
        return found


def ended_calls(rows: Iterable[dict], to_request: Callable[[dict], dict | Request], send: Callable[[dict], dict], parse: Callable, schema: T.StructType, policy: Policy, tick_s: float = 0.2, meter: Meter | None = None) -> Iterator[pa.RecordBatch]:
    """Records of the calls that have ended, at least every tick_s seconds (then maybe none).

    Whatever goes wrong with a row alone is its error: building or encoding the request, the sender, the reply, parse,
    a value that the schema does not hold.
    """
    breaker, dice, store = Breaker(policy.breaker, policy.probe_s, policy.open_s), random.Random(), lattice.Storing(schema)
    send, parse = _timed(send), two_argument_parse(parse)

    def one(row: dict) -> dict:
        try:
            out = parse(row, attempt(send, to_request(row), policy, breaker, dice, meter))
            if not isinstance(out, dict):
                raise TypeError(f"parse must return a dict, got {type(out).__name__}")
            return {**out, "id": row["id"], "error": None}
        except Failed as e:
            return {"id": row["id"], "error": str(e)}
        except ServerLost:
            raise
        except Exception as e:
            return {"id": row["id"], "error": f"client: {type(e).__name__}: {e}"}

    calls, callers = _Calls(rows, one, policy), policy.window
    try:
        while callers:
            found = calls.ended(tick_s)
            callers -= sum(x is calls.END for x in found)
            lost = next((x for x in found if isinstance(x, BaseException)), None)
            yield store.batch([x for x in found if isinstance(x, dict)])
            if lost is not None:
                raise lost
        if calls.broken is not None:
            raise calls.broken
    finally:
        calls.closed.set()


def call_rows(rows: DataFrame, to_request: Callable[[dict], dict | Request], send: Callable[[dict], dict], parse: Callable, schema: T.StructType, policy: Policy | None = None, together: int = 500) -> DataFrame:
    """A record (of schema, with id and error) for every row: what parse made of the reply, or the error.

    to_request and parse get a row as a dict of plain Python values, whatever its Spark types; parse is called with
    (row, reply), or with the reply alone if it takes one argument.  Records go on in batches of about `together`, or
    each second.
    """
    lattice.check_declared(schema)
    policy = policy or Policy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, since = [], 0, time.monotonic()
        for records in ended_calls(plain_rows(batches), to_request, send, parse, schema, policy):
            if records.num_rows:
                held.append(records)
                size += records.num_rows
            if size >= together or held and time.monotonic() - since >= 1:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, since = [], 0, time.monotonic()
        yield from held

    return rows.mapInArrow(run, schema)
