"""A resumable run: rows in, a call for each that is not done yet, durable records out, counts that add up."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as lattice
from ..functions import ids
from ..operators import resume
from ..settings import checked
from ..sources.sinks import Sink, as_sink
from .ahead import plain_rows
from .calls import InputFailed, Meter, Policy, ServerLost, call_rows, ended_calls


class RowsLost(RuntimeError):
    """The counts of a run do not add up; nothing is marked finished."""


class AllFailed(RuntimeError):
    """The first rows of a run all failed; none of them is stored."""


@dataclass
class Stats:
    rows_total: int = 0
    rows_done_prior: int = 0
    rows_errored_prior: int = 0
    rows_deduped: int = 0
    rows_processed: int = 0
    rows_failed: int = 0
    seconds: float = 0.0

    @property
    def rows_unaccounted(self) -> int:
        return self.rows_total - self.rows_done_prior - self.rows_deduped - self.rows_processed - self.rows_failed


PUMP = {"fail_fast": "[0, inf) whole", "partitions": "[1, inf) whole or none", "flush_rows": "[1, inf) whole or none"}


class SinkFailed(RuntimeError):
    """The output could not be written."""


class Stopped(RuntimeError):
    """The run was asked to stop; what had ended is stored."""


#: What ends a task before its rows do, and the error that the run then raises.  Finished rows are stored in every case
#: (but for those that a broken sink holds); rows under way and after them are left for the next run.
ENDS = {"input": InputFailed, "server": ServerLost, "sink": SinkFailed, "stop": Stopped}
ENDED = "ok long, failed long, ended string, at double, said string"


def call_and_store(todo: DataFrame, to_request: Callable, send: Callable, parse: Callable, sink: Sink, schema: T.StructType, policy: Policy, shard: int = 0, tick_s: float = 2.0, run_name: str = "") -> DataFrame:
    """(ok, failed, ended, at, said) of each task that called its rows and stored their records, each soon after its call has ended.

    A task that cannot go on says why in `ended` and does not fail: Spark would try it again, and call rows twice that
    are stored.
    """
    lattice.check_declared(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok, failed, meter, began, seen = 0, 0, Meter(), time.monotonic(), 0.0
        ended: tuple[str | None, str | None] = (None, None)
        log, calls, out = sink.ticks(shard), ended_calls(plain_rows(batches), to_request, send, parse, schema, policy, meter=meter), None
        try:
            out = sink.rows(schema)
            while True:
                try:
                    records = next(calls, None)
                except (InputFailed, ServerLost) as e:
                    ended = ("input" if isinstance(e, InputFailed) else "server", str(e))
                    break
                if records is None:
                    break
                if records.num_rows:
                    good, bad = out.add_batch(records)
                    ok, failed = ok + good, failed + bad
                out.due()
                now = time.monotonic() - began
                if now - seen >= tick_s:
                    m, seen = meter.taken(), now
                    if log:
                        log.note({"t": round(now, 1), "limit": policy.window, "ok": m.ok, "bp": m.pressure, "retries": m.retries, "latency_s": m.latency, "reason": "hold"})
                    if sink.stop_asked(run_name):
                        ended = ("stop", "the run was asked to stop")
                        break
            calls.close()
            out.close()  # what has ended is kept
        except Exception as e:
            ended = ("sink", f"{type(e).__name__}: {e}")
        finally:
            calls.close()
            if log:
                log.write()
        yield pa.RecordBatch.from_pydict({"ok": [ok], "failed": [failed], "ended": pa.array([ended[0]], pa.string()), "at": [time.time()], "said": pa.array([ended[1]], pa.string())})

    return todo.mapInArrow(run, ENDED)


def _stored_rows(tasks: DataFrame, sink: Sink, name: str, grace_s: float) -> tuple[int, int]:
    """Run the tasks and add up what they stored; raises what ended the first of those that ended early.

    The job runs beside the caller under a tag of its own.  Whoever interrupts the caller asks the tasks to stop, which
    store what has ended; the job is cancelled when that takes longer than grace_s, and the interruption goes on.
    """
    spark, tag, box = tasks.sparkSession, f"millrace-{name}", {}
    first = F.min_by(F.struct("ended", "said"), F.when(F.col("ended").isNotNull(), F.col("at")))
    summed = tasks.agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), first.alias("first"), F.count("ended").alias("ended"))

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            box["got"] = summed.first()
        except BaseException as e:
            box["error"] = e
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=work, session=spark)
    thread.start()
    try:
        thread.join()
    except BaseException:
        if sink.ask_to_stop(name):
            thread.join(grace_s)
        if thread.is_alive():
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(grace_s)
        raise
    if "error" in box:
        raise box["error"]
    got = box["got"]
    if got["ended"]:
        if got["ended"] > 1:
            print(f"{got['ended']} tasks ended early; the first: {got['first']['said']}", file=sys.stderr)
        raise ENDS[got["first"]["ended"]](got["first"]["said"])
    return got["ok"] or 0, got["failed"] or 0


def pump(rows: DataFrame, to_request: Callable[[dict], dict], send: Callable[[dict], dict], parse: Callable[[dict, dict], dict], target: str | Sink, schema: T.StructType, *, id_key: str | None = None, order: str | None = None, shard: tuple[int, int] = (0, 1), retry_errors: bool = False, fail_fast: int = 32, partitions: int | None = None, flush_rows: int | None = None, policy: Policy | None = None, grace_s: float = 30.0) -> Stats:
    """Run every row of a shard that the output (a path or a Sink) does not have yet.

    order: the column that says which of several rows with one id comes first (default: id, for content ids).
    fail_fast: if that many rows of a first batch all fail, AllFailed is raised and none is stored; 0 turns it off,
    and so does retry_errors.  Calls run in `partitions` tasks with a window of calls each.

    Where the input, the server or the output fails, the first failure is raised (InputFailed, ServerLost, SinkFailed)
    once the tasks have ended.  An interruption (KeyboardInterrupt) stops them, gives them grace_s, and goes on.
    """
    plain = checked("pump", PUMP, {"fail_fast": fail_fast, "partitions": partitions, "flush_rows": flush_rows})
    fail_fast, partitions, flush_rows = plain["fail_fast"], plain["partitions"], plain["flush_rows"]
    began, name, policy, sink = time.time(), uuid.uuid4().hex[:12], policy or Policy(), as_sink(target, flush_rows)
    keyed = ids.shard_select(rows if "id" in rows.columns else ids.with_id(rows, id_key=id_key), *shard)
    # the one resume join: it moves ids only, is counted as it runs, and is kept for the rows' own join with it
    seen = Observation()
    states = resume.resume_states(keyed, sink.known(rows.sparkSession), retry_errors).observe(seen, *resume.state_counts(retry_errors)).persist(StorageLevel.DISK_ONLY)
    ok = failed = 0
    try:
        states.count()
        counts = seen.get
        left = states.where("not skip").select("id")
        todo = (keyed.repartition(partitions, "id") if partitions else keyed).join(left, "id", "left_semi")
        if counts["rows_deduped"]:
            todo = resume.first_wins(todo, order or "id")
        if fail_fast > 0 and not retry_errors and (counts["rows_to_do"] or 0) >= fail_fast:
            first = [r["id"] for r in left.limit(fail_fast).collect()]  # fail_fast ids
            tried = call_rows(todo.where(F.col("id").isin(first)), to_request, send, parse, schema, policy).toArrow()
            if not tried["error"].null_count:
                raise AllFailed(f"the first {fail_fast} rows failed: {tried['error'][0]}")
            out = sink.rows(schema)
            for batch in tried.to_batches():
                good, bad = out.add_batch(batch)
                ok, failed = ok + good, failed + bad
            out.close()
            todo = todo.where(~F.col("id").isin(first))
        good, bad = _stored_rows(call_and_store(todo, to_request, send, parse, sink, schema, policy, shard[0], run_name=name), sink, name, grace_s)
        ok, failed = ok + good, failed + bad
    finally:
        states.unpersist()
    stats = Stats(counts["rows_total"] or 0, counts["rows_done_prior"] or 0, counts["rows_errored_prior"] or 0, counts["rows_deduped"] or 0, ok, failed, time.time() - began)
    if stats.rows_unaccounted:
        raise RowsLost(f"{stats.rows_unaccounted} of {stats.rows_total} rows are neither done, deduplicated, processed nor failed")
    sink.finish(f"shard-{shard[0]}-{name}", asdict(stats) | {"rank": shard[0], "world": shard[1]})
    return stats
