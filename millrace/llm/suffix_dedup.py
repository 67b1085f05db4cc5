"""Removal of repeated byte strings with a sparse suffix array, sorted by common-prefix-aware distributed merging.

Every string of `length` bytes has one anchor, the place of its least byte k-gram, so equal strings meet in suffixes
that begin at equal k-grams, and only suffixes at anchors are sorted.  Anchors that stand once are dropped; of equal
surroundings (blocks) the first stands for all.  Tasks sort the suffixes that are left into runs and exchange them
front-coded: each suffix as the length of its common prefix with the one before and the bytes after it.  A loser
tree merges the runs of a bucket: contestants carry their common prefix with the last winner, the longer prefix wins
unseen, and equal ones are compared from there on, so no known prefix is compared again.  In the merged array the
strings that begin l bytes before their anchor are equal where the common prefixes are length - l or more and the l
bytes before the anchors agree; all but the first by (doc_id, start) are repeats.

Anchors with more than `group_limit` different blocks are compared by the hashes of their strings as plain rows
instead, so that no anchor is one task's work.

Edge cases: a null text has no bytes; documents shorter than `length` keep all; doc_id is a whole number (other kinds are ranked in their order), nulls come last;
rows equal in doc_id and text are one document; very long texts are read in overlapping pieces; columns beside
doc_id and text are ignored; an empty table gives an empty result.  What is left of a text is binary, since a cut
may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, BYTE_VALUE, mix64, powers, release, stored, string_bytes, table

LENGTH = 100
SEED_BYTES = 24
PIECE = 1 << 19
#: Suffixes in a bucket of the merge, on average, at most.
BUCKET_SUFFIXES = 100_000
GROUP_LIMIT = 50_000
#: Bits of a span's counts.
_BITS = 12
_BACK = np.uint64(pow(int(BASE), -1, 2**64))
_UP, _DOWN = powers(BASE, PIECE + 4096), powers(_BACK, PIECE + 4096)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row names the pair of doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


class Piece:
    """Bytes of one or several texts, with the hash of any run of them."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data] * _UP[: len(data)], out=self.sums[1:])

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * _DOWN[begin] + (end - begin).astype(np.uint64))


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last): whole texts, or overlapping parts of one."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1
        if to > at:
            yield at, to, offsets[at], offsets[to]
            at = to
        else:
            for s in range(offsets[at], max(offsets[at] + 1, offsets[at + 1] - length + 1), PIECE - length):
                yield at, at + 1, s, min(s + PIECE - 1, offsets[at + 1])
            at += 1


def _owners(piece: Piece, starts: np.ndarray, n: int, length: int, k: int) -> np.ndarray:
    """The place of the least k-gram in the string at each start (ties: the first)."""
    grams = piece.runs(np.arange(n - k + 1), np.arange(n - k + 1) + k)
    # high bits of the hash, then the place: the least carries where it stands
    keys = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    least, width, size = keys, length - k + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least[starts] & np.uint64((1 << 20) - 1)).astype(np.int64), grams


def anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, block, row, doc_id, span) of each block.

    span is one long, to keep the shuffled rows small: first start, number of starts, place of the anchor from first.
    """
    if length >= 1 << _BITS:
        raise ValueError(f"strings of {length} bytes are too long; the most is {(1 << _BITS) - 1}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            row, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b, begin, end in _pieces(offsets, length):
                n = int(end - begin)
                if n < length:
                    continue
                own = np.clip(offsets[a : b + 1] - begin, 0, n)
                doc = np.repeat(np.arange(b - a), np.diff(own))
                starts = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
                if not len(starts):
                    continue
                piece = Piece(data[begin:end])
                owner, grams = _owners(piece, starts, n, length, k)
                turn = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
                seed = pa.array(grams[owner[turn]].view(np.int64))
                count = np.diff(np.concatenate([turn, [len(starts)]]))
                first, place = starts[turn], owner[turn] - starts[turn]
                with np.errstate(over="ignore"):
                    block = mix64(piece.runs(first, first + count - 1 + length) ^ mix64((count * 256 + place).astype(np.uint64)))
                of = a + doc[first]
                where = first + begin - offsets[of]
                span = (where << 2 * _BITS) | (count << _BITS) | place
                columns = [seed, pa.array(block.view(np.int64)), pa.array(row[of], pa.int64()), ids.take(pa.array(of)), pa.array(span, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "block", "row", "doc_id", "span"])

    return rows.mapInArrow(run, "anchor long, block long, row long, doc_id long, span long")


def _parts(span: Column) -> list[Column]:
    """first, n and place of a span."""
    low = F.lit((1 << _BITS) - 1)
    return [F.shiftright(span, 2 * _BITS).alias("first"), F.shiftright(span, _BITS).bitwiseAND(low).cast("int").alias("n"), span.bitwiseAND(low).cast("int").alias("place")]


def _common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(sorted_suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the one before, length, bytes after the prefix) of each suffix of a run."""
    prefixes, tails, last = [], [], b""
    for s in sorted_suffixes:
        c = _common(last, s, 0)
        prefixes.append(c)
        tails.append(s[c:])
        last = s
    return bytes(prefixes), bytes(map(len, sorted_suffixes)), b"".join(tails)


class _Run:
    """A front-coded run, read one suffix at a time."""

    def __init__(self, number: int, prefixes: bytes, lengths: bytes, tails: bytes):
        self.number, self.prefixes, self.lengths, self.tails = number, prefixes, lengths, tails
        self.at, self.read, self.suffix, self.common = -1, 0, b"", 0

    def advance(self) -> bool:
        """To the next suffix; common is then its common prefix with the one before, the last winner."""
        self.at += 1
        if self.at >= len(self.prefixes):
            return False
        self.common = self.prefixes[self.at]
        more = self.lengths[self.at] - self.common
        self.suffix = self.suffix[: self.common] + self.tails[self.read : self.read + more]
        self.read += more
        return True


def merged(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, common prefix with the suffix before) in the order of the suffixes."""
    players: list[_Run | None] = []
    for i, r in enumerate(runs):
        p = _Run(i, *r)
        players.append(p if p.advance() else None)
    size = 1
    while size < max(1, len(players)):
        size *= 2
    players += [None] * (size - len(players))

    def duel(a: _Run | None, b: _Run | None) -> tuple[_Run | None, _Run | None]:
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a.common != b.common:
            return (a, b) if a.common > b.common else (b, a)
        c = _common(a.suffix, b.suffix, a.common)
        if c == len(a.suffix) or c < len(b.suffix) and a.suffix[c] < b.suffix[c]:
            b.common = c
            return a, b
        a.common = c
        return b, a

    losers: list[_Run | None] = [None] * size
    for p in players:  # nothing has won yet: all common prefixes are empty
        if p:
            p.common = 0

    def build(node: int) -> _Run | None:
        if node >= size:
            return players[node - size]
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while winner is not None:
        yield winner.number, winner.at, winner.common
        node = (winner.number + size) // 2
        rising = winner if winner.advance() else None
        while node >= 1:
            rising, losers[node] = duel(rising, losers[node])
            node //= 2
        winner = rising


def sorted_runs(chosen: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    """Texts with their chosen anchors -> a row per run and bucket: front-coded suffixes, bytes before, places."""
    before = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            whole, lists = data.tobytes(), batch.column(3)
            flat = lists.flatten()
            anchor, first, n, place = (np.asarray(flat.field(i)).astype(np.int64) for i in range(4))
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            spot = offsets[owner] + first + place
            row, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            bucket = mix64(anchor.view(np.uint64)) % np.uint64(buckets)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                suffix = [whole[p : min(p + length, e)] for p, e in zip(spot[mine].tolist(), offsets[owner[mine] + 1].tolist(), strict=True)]
                order = sorted(range(len(mine)), key=suffix.__getitem__)
                mine = mine[order]
                prefixes, lengths, tails = front_coded([suffix[i] for i in order])
                left = np.zeros((len(mine), before), np.uint8)
                for l in range(1, before + 1):  # noqa: E741
                    at = spot[mine] - l
                    left[:, l - 1] = np.where(at >= offsets[owner[mine]], data[np.maximum(at, 0)], 0)
                blobs = [prefixes, lengths, tails, left.tobytes(), row[owner[mine]].tobytes(), ids[owner[mine]].tobytes(), (first + place)[mine].tobytes(), n[mine].astype(np.int32).tobytes(), place[mine].astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], _RUN)

    return chosen.mapInArrow(run, "bucket int, " + ", ".join(f"{x} binary" for x in _RUN[1:]))


_RUN = ["bucket", "prefixes", "lengths", "tails", "left", "row", "doc_id", "spot", "n", "place"]


def repeats_in(part: pa.Table, length: int, k: int) -> pa.Table:
    """Merge the runs of a bucket; (row, first, n) of the strings that also start earlier, as runs of starts."""
    columns = {c: part[c].to_pylist() for c in _RUN[1:]}
    begin = np.cumsum([0, *map(len, columns["prefixes"])])
    order, common = [], []
    for run, at, c in merged(list(zip(columns["prefixes"], columns["lengths"], columns["tails"], strict=True))):
        order.append(begin[run] + at)
        common.append(c)
    order, common = np.array(order, np.int64), np.array(common, np.int64)
    get = lambda c, kind: np.frombuffer(b"".join(columns[c]), kind)[order]
    before = length - k
    left = np.frombuffer(b"".join(columns["left"]), np.uint8).reshape(-1, before)[order]
    row, doc, spot, n, place = get("row", np.int64), get("doc_id", np.int64), get("spot", np.int64), get("n", np.int32), get("place", np.int32)
    ranked = np.lexsort((spot, row, doc))  # earliest first
    again = np.zeros((len(order), before + 1), bool)
    side = np.zeros(len(order), np.uint64)
    for l in range(before + 1):  # noqa: E741
        if l:
            with np.errstate(over="ignore"):
                side = side * BASE + BYTE_VALUE[left[:, l - 1]]
        has = ranked[(place[ranked] >= l) & (place[ranked] - n[ranked] < l)]
        same = np.cumsum(common < length - l).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = mix64(mix64(side[has]) + same[has])
        by = np.argsort(keys, kind="stable")
        later = np.flatnonzero(keys[by][1:] == keys[by][:-1]) + 1
        again[has[by[later]], l] = True
    padded = np.zeros((len(order), before + 3), np.int8)
    padded[:, 1:-1] = again
    who, turn = np.nonzero(np.diff(padded, axis=1))
    lo, hi, who = turn[0::2], turn[1::2], who[0::2]  # offsets lo..hi-1 before the anchor
    return pa.table({"row": pa.array(row[who], pa.int64()), "first": pa.array(spot[who] - (hi - 1), pa.int64()), "n": pa.array(hi - lo, pa.int32())})


def _string_rows(chosen: DataFrame, length: int) -> DataFrame:
    """(string, doc_id, row, first) of every string of the chosen blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            for i, blocks in enumerate(batch.column(3).to_pylist()):
                row, doc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for b in blocks:
                    s = offsets[i] + b["first"]
                    piece, at = Piece(data[s : s + b["n"] - 1 + length]), np.arange(b["n"])
                    yield pa.RecordBatch.from_arrays([pa.array(piece.runs(at, at + length).view(np.int64)), pa.array([doc] * b["n"], pa.int64()), pa.array([row] * b["n"], pa.int64()), pa.array(b["first"] + at, pa.int64())], ["string", "doc_id", "row", "first"])

    return chosen.mapInArrow(run, "string long, doc_id long, row long, first long")


def later_strings(rows: DataFrame, length: int = LENGTH, k: int = SEED_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(row, first, n), stored: runs of starts of strings that also start earlier in the corpus."""
    # stored, so that texts are hashed once, and a join has plain shuffles on both sides and a hot anchor's rows can be split
    every = stored(anchors(rows, length, k), "byte-anchors")
    twice = stored(every.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    met = stored(every.join(twice, "anchor", "left_semi"), "met-anchors")
    release(every, twice)
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "span")).alias("one")
    blocks = stored(met.groupBy("anchor", "block").agg(F.count("*").alias("copies"), earliest), "byte-blocks")
    copied = blocks.where("copies > 1").select("anchor", "block", F.col("one.row").alias("r"), F.col("one.span").alias("s"))
    later = met.join(copied, ["anchor", "block"]).where("NOT (row = r AND span = s)").select("row", *_parts(F.col("span"))[:2])
    whole = stored(later, "copied-blocks")
    release(met)
    groups = stored(blocks.groupBy("anchor").count().where("count > 1"), "groups")
    edges = stored(blocks.join(groups, "anchor").select("anchor", "one.row", *_parts(F.col("one.span")), "count"), "byte-edges")
    release(blocks, groups)
    size = edges.agg(F.count("*").alias("all"), F.count_if(F.col("count") > group_limit).alias("large")).first()

    def with_text(of: DataFrame) -> DataFrame:
        lists = of.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "n", "place")).alias("blocks"))
        # rows that stand twice are one document: a second copy would be the first's repeat
        return rows.join(lists, "row").select("row", "doc_id", "text", "blocks").dropDuplicates(["row"])

    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size["all"] // BUCKET_SUFFIXES))
    runs = sorted_runs(with_text(edges.where(F.col("count") <= group_limit)), buckets, length, k)
    found = whole.union(runs.groupBy("bucket").applyInArrow(lambda part: repeats_in(part, length, k), "row long, first long, n int"))
    if size["large"]:
        strings = stored(_string_rows(with_text(edges.where(F.col("count") > group_limit)), length), "strings")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "first")
        least = stored(strings.groupBy("string").agg(F.min(order).alias("one"), F.count("*").alias("c")).where("c > 1"), "least")
        found = found.union(strings.join(least, "string").where(order > F.col("one")).select("row", "first", F.lit(1).alias("n")))
    out = stored(found, "later")
    release(whole, edges)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of bytes, and the bytes that are left.

    Ids that are no whole numbers are ranked in their own order, and given back as they were.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        # numbers that grow with the order of a sorted table, whatever its partitions
        ranks = stored(docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().sort("id").select("id", F.monotonically_increasing_id().alias("rank")), "id-ranks")
        ranked = docs.select(F.col("doc_id").alias("id"), "text").join(ranks, "id", "left").select(F.col("rank").alias("doc_id"), "text")
        found = without_repeats(ranked, length, k, group_limit)
        return found.join(ranks, F.col("doc_id") == F.col("rank"), "left").select(F.col("id").alias("doc_id"), "n_bytes", "spans", "kept")
    rows = keyed(docs)
    found = later_strings(rows, length, k, group_limit)
    ranges = found.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [_cut(t.as_py(), r, length) for t, r in zip(part.column(1).cast(pa.binary()), part.column(2), strict=True)]
                sizes, spans, kept = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(ranges, "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def _cut(text: bytes, ranges: pa.ListScalar, length: int) -> tuple[int, list[dict], bytes]:
    if not ranges.is_valid:
        return len(text), [], text
    cover = np.zeros(len(text) + 1, np.int64)
    first, n = (np.asarray(ranges.values.field(i)) for i in range(2))
    np.add.at(cover, first, 1)
    np.add.at(cover, first + n - 1 + length, -1)
    gone = np.cumsum(cover) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
    spans = [{"start": int(s), "stop": int(e)} for s, e in zip(turns[0::2], turns[1::2], strict=True)]
    kept = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()
    return len(text), spans, kept


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT rid, doc_id, i, md5(t[i + 1:i + 100]) AS g FROM (SELECT rid, doc_id, t, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
later AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
turns AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM later),
runs AS (SELECT rid, min(i) AS a, max(i) + 100 AS b FROM (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS r FROM turns) GROUP BY rid, r),
gone AS (SELECT rid, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid),
pieces AS (SELECT rid, doc_id, n, n_removed, n_spans, list_transform(range(1, len(coalesce(a, [])) + 2), lambda k: hex(t[coalesce(b[k - 1], 0) + 1:coalesce(a[k], n)])) AS p FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(array_to_string(p, ''))) AS kept_sha256 FROM pieces
"""
