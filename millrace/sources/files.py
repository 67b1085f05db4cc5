"""Folders of files as inputs: listed, narrowed by limit, shard and known ids, and only then read.

A listing holds paths and lengths, never content, so nothing that is left out is opened and no content passes a shuffle.
What is left is fetched inside the tasks, some files ahead of the one that is asked for and in the order of the rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..plans.ahead import in_order, prepare_ahead
from ..settings import checked

#: What Spark calls a scheme, and what Arrow calls it.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs"}


def opened(path: str) -> pa.NativeFile:
    """A file by its path or address, to be read from its start."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    fs, place = pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return fs.open_input_file(place)


def fetch(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def file_list(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of the files that a pattern names, folders left out; no file is opened."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def fetched(files: DataFrame, ahead: int = 8, reader: Callable[[str], bytes] = fetch) -> DataFrame:
    """files with content: each task has at most `ahead` files read or being read that are not taken yet.

    Rows keep their order; a file that can't be read ends the job at its place, after the rows before it.
    """
    ahead = checked("fetched", {"ahead": "[1, inf) whole"}, {"ahead": ahead})["ahead"]
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = in_order(batch.column(names.index("path")).to_pylist(), reader, ahead)
            for i, content in enumerate(contents):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*names, "content"])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.mapInArrow(run, schema)


def file_rows(spark: SparkSession, pattern: str, *, root: str | None = None, read: bool = True, known: DataFrame | None = None, limit: int | None = None, shard: tuple[int, int] = (0, 1), ahead: int = 8) -> DataFrame:
    """Files of a pattern as rows (id, path, length[, content]).

    The first `limit` files by path, of those the shard's, of those the ones that `known` has no id of, are read.
    """
    listed = file_list(spark, pattern)
    if limit is not None:
        listed = listed.join(listed.select("path").orderBy("path").limit(max(0, limit)), "path", "left_semi")
    plain = F.regexp_replace("path", "^file:/*", "/")
    rows = ids.shard_select(ids.with_id(listed, id_column=ids.path_id(plain, root)), *shard)
    if known is not None:
        rows = rows.join(known.select("id"), "id", "left_anti")
    rows = rows.select("id", "path", "length")
    return fetched(rows, ahead) if read else rows


# ---- late decoding


def decoded_late(rows: DataFrame, decode: Callable[[dict], dict | None], schema: T.StructType | str, shard: tuple[int, int] = (0, 1), ahead: int = 4) -> DataFrame:
    """decode of the rows of a shard, and of no others: ids are known before anything is decoded.

    The map over batches that decodes is a barrier: Spark moves no filter, no id and no shard behind it.
    """
    return prepare_ahead(ids.shard_select(rows, *shard), decode, schema, ahead)


def gray_image(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels) of a binary gray image of the plain netpbm kind (P5, one byte a pixel)."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.find(b"\n", at) % (len(content) + 1)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the image ends in its header")
        fields.append(content[at:end])
        at = end
    kind, (width, height, top) = fields[0], map(int, fields[1:])
    pixels = content[at + 1 : at + 1 + width * height]
    if kind != b"P5" or top > 255 or len(pixels) != width * height:
        raise ValueError("not a whole P5 image of one byte a pixel")
    return width, height, pixels


def image_request(row: dict, most: int) -> dict:
    """(id, width, height, uri): the image of a row, halved until no side is over `most`, as a data address."""
    width, height, pixels = gray_image(bytes(row["content"]))
    while max(width, height) > most and min(width, height) > 1:
        pixels = b"".join(pixels[y * width : y * width + width // 2 * 2 : 2] for y in range(0, height // 2 * 2, 2))
        width, height = width // 2, height // 2
    body = b"P5\n%d %d\n255\n" % (width, height) + pixels
    return {"id": row["id"], "width": width, "height": height, "uri": "data:image/x-portable-graymap;base64," + base64.b64encode(body).decode()}


def image_rows(images: DataFrame, most: int = 1024, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """(id, width, height, uri) of a shard's images (id, content)."""
    return decoded_late(images, partial(image_request, most=most), "id string, width int, height int, uri string", shard)

