"""A reader of stored parts that tries again where trying helps and says what it could not read.

Spark's own `ignoreCorruptFiles` is silent and does not tell a line that broke from bytes that are broken.  Here a
partition is a file (some files, where there are thousands): an I/O error is tried again, twice, broken bytes are not, and either way a file that stays
unreadable gives one row that names it.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

FORMAT = "millrace_records"
#: Attempts at a file, and the seconds before the second and third.
ATTEMPTS, PAUSES = 3, (0.5, 1.0)
#: Partitions at most.
PARTITIONS = 4096
RECORDS = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "error", "name", "fault")])


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def part_names(path: str) -> list[str]:
    """The names of the parts in a folder, in the order in which they were written; none if there is no folder."""
    fs, root = filesystem(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))


def read_file(path: str, columns: list[str], pause=time.sleep) -> pa.Table:
    """Some columns of a Parquet file.  OSError after three attempts; ArrowInvalid at once for broken bytes."""
    for turn in range(ATTEMPTS):
        try:
            fs, place = filesystem(path)
            with fs.open_input_file(place) as f:
                return pq.read_table(f, columns=columns, partitioning=None)
        except FileNotFoundError:
            raise
        except OSError as e:
            if turn == ATTEMPTS - 1 or isinstance(e, pa.ArrowInvalid):
                raise
            pause(PAUSES[turn])
    raise AssertionError


@dataclass
class _Files(InputPartition):
    names: list[str]


class _Records(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Files]:
        names = part_names(self.folder)
        each = -(-len(names) // PARTITIONS)
        return [_Files(names[at : at + each]) for at in range(0, len(names), max(1, each))]

    def read(self, partition: _Files | None) -> Iterator[pa.RecordBatch]:
        for name in partition.names if partition else ():  # None where there is no file
            yield from self._file(name)

    def _file(self, name: str) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(f.name, pa.string()) for f in RECORDS])
        try:
            held = read_file(f"{self.folder}/{name}", ["id", "error"])
            held = held.select(["id", "error"]).cast(pa.schema(list(kind)[:2]))
        except (OSError, pa.ArrowException, KeyError) as e:
            print(f"{self.folder}/{name} could not be read and is left out: {type(e).__name__}: {e}", file=sys.stderr)
            yield pa.RecordBatch.from_pylist([{"name": name, "fault": f"{type(e).__name__}: {e}"}], kind)
            return
        for batch in held.to_batches():
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([name] * batch.num_rows), pa.nulls(batch.num_rows, pa.string())], schema=kind)


class StoredRecords(DataSource):
    """spark.read.format("millrace_records").load(folder): (id, error, name, fault)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return RECORDS

    def reader(self, schema: T.StructType) -> _Records:
        return _Records(self.options["path"])


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, error, name, fault) of the files in a folder; fault is null but for files that could not be read."""
    spark.dataSource.register(StoredRecords)
    return spark.read.format(FORMAT).load(folder)


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(name, fault) of the files in a folder that can't be read."""
    return stored_records(spark, folder).where(F.col("fault").isNotNull()).select("name", "fault")


def newest_schema(path: str) -> T.StructType | None:
    """The columns of the newest part whose footer can be read: names say the order, older ones are tried in turn.

    Only footers are read.  None where no part has a readable one.
    """
    fs, root = filesystem(path)
    for name in reversed(part_names(path)):
        try:
            with fs.open_input_file(f"{root}/{name}") as f:
                return from_arrow_schema(pq.ParquetFile(f).schema_arrow)
        except (OSError, pa.ArrowException) as e:
            print(f"could not read the schema of {path}/{name}, an older part is tried: {e}", file=sys.stderr)
    return None
