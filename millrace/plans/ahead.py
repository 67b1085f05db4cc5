"""An ordered map with several items under way: results come in the order of the items, as far ahead as is asked."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from contextlib import nullcontext
from itertools import islice
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..settings import checked

A, B = TypeVar("A"), TypeVar("B")


def in_order(items: Iterable[A], fn: Callable[[A], B], ahead: int, pool: Executor | None = None) -> Iterator[B]:
    """fn of each item, in order, with at most `ahead` calls begun whose results are not taken yet.

    An item is drawn only when a call may begin.  An exception, of fn or of the items, is raised in its place: all that
    comes before is given first, and calls behind it that have not begun are dropped.
    """
    source = iter(items)
    with ThreadPoolExecutor(ahead) if pool is None else nullcontext(pool) as threads:
        begun: deque = deque()
        broken: BaseException | None = None
        try:
            while True:
                while broken is None and len(begun) < ahead:
                    try:
                        item = next(source)
                    except StopIteration:
                        break
                    except Exception as e:  # given where the items end
                        broken = e
                        break
                    begun.append(threads.submit(fn, item))
                if not begun:
                    break
                yield begun.popleft().result()
            if broken is not None:
                raise broken
        finally:
            for call in begun:
                call.cancel()


def plain_rows(batches: Iterable[pa.RecordBatch], together: int = 256) -> Iterator[dict]:
    """The rows of Arrow batches as plain Python values, a slice of a batch at a time; maps are dicts."""
    for batch in batches:
        for at in range(0, batch.num_rows, together):
            yield from batch.slice(at, together).to_pylist(maps_as_pydicts="lossy")


def prepare_ahead(rows: DataFrame, fn: Callable[[dict], dict | None], schema: T.StructType | str, ahead: int = 8) -> DataFrame:
    """fn of every row, several at a time in a task and in the order of its rows; None is a row of nulls.

    For work that waits: files, services.  The rows are plain dicts; the first exception ends the job.
    """
    ahead = checked("prepare_ahead", {"ahead": "[1, inf) whole"}, {"ahead": ahead})["ahead"]
    kind = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    none: dict[str, Any] = dict.fromkeys(kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = in_order(plain_rows(batches), fn, ahead)
        while part := list(islice(made, ahead)):
            yield pa.RecordBatch.from_pylist([none if r is None else r for r in part], kind)

    return rows.mapInArrow(run, schema)
