"""Exact search for the k largest inner products, with queries and data in cover trees that are walked together.

The top of the index is one farthest-first order of points, taken from a bounded sample: its first centres cover the
data coarsely, more of them finely, so a prefix of the same order serves the queries, which are fewer.  Every row goes
to its nearest centre; a cell is cut by a hash into tiles of some thousand rows, however many a cell has, and each tile
gets a cover tree of its own (a node's children lie within half its radius and more than that apart).  A query tile is
first searched in a data tile of its own cell, which gives every query a kth score.  Then each pair of tiles whose cells
could still better a query's kth score meets in one task, where pairs of nodes are pruned the same way: two points
within r and s of the centres p and q have an inner product of at most p.q + r|q| + s|p| + rs.  Leaves are compared by
one matrix product.  All scores are whole numbers, and a floating type is used only where it holds them exactly.

Where a node's points are nearly all as far from each other as from its centre (random directions in many dimensions),
it stays a leaf: nothing could be pruned there, and the product is the plain way to compare them.

Edge cases: a null vector, and one with a null or non-finite component, is neither a query nor a candidate; a shorter
vector counts as filled up with zeros; a component beyond half a million counts as half a million; each repeated row is
a query and a candidate of its own, and only the row itself is left out of its answer; ties go to the smaller id, then
to any of the equal rows; a null id is no query and comes last among ties (so does 2^63 - 1, which then reads as null);
fewer than k candidates give as many ranks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, table
from .vector_codes import whole_vectors

#: Rows of a data tile and of a query tile, about: a pair of tiles moves some MB for 67 million products.  Cells at most, and
#: sampled rows for each of them.
TILE, QUERY_TILE, CELLS, SAMPLED = 16384, 4096, 1024, 16
#: Points of a node that is not split, and the most children that a node may need for half its points.
LEAF, CHILDREN = 16, 32
NO_ID = np.iinfo(np.int64).max
NOTHING = np.iinfo(np.int64).min

TILE_COLUMNS = "ids binary, rows binary, data binary, nodes binary, radii binary"


@dataclass
class Tree:
    """Points in the order of a cover tree; node i has the points start..end, children first..first+count, and its centre's place."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    def __post_init__(self) -> None:
        self.at = self.points[self.centre].astype(np.float64)
        self.norm = np.sqrt((self.at**2).sum(axis=1))


def _apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _children(x: np.ndarray, apart: np.ndarray, radius: float) -> list[np.ndarray] | None:
    """Groups of places within half the radius of their first, the firsts further apart than that; None if they are too many."""
    within = apart <= radius / 2
    groups, rest = [np.flatnonzero(within)], np.flatnonzero(~within)
    while len(rest):
        if len(groups) >= CHILDREN and 2 * len(rest) > len(x):
            return None
        near = _apart(x[rest], x[rest[0]]) <= radius / 2
        groups.append(rest[near])
        rest = rest[~near]
    return groups if 2 * len(groups) <= len(x) else None


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radii) over rows of whole numbers: nodes holds start, end, centre, first child and number of children."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    nodes, radii, at = [[0, len(x), 0, 0, 0]], [0.0], 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        held = order[start:end]
        apart = _apart(x[held], x[held[0]])
        radii[at] = float(apart.max(initial=0))
        groups = _children(x[held], apart, radii[at]) if len(held) > LEAF and radii[at] > 0 else None
        if groups:
            order[start:end] = held[np.concatenate(groups)]
            nodes[at][3:] = [len(nodes), len(groups)]
            for g in groups:
                nodes.append([start, start + len(g), start, 0, 0])
                radii.append(0.0)
                start += len(g)
        at += 1
    return order, np.array(nodes, np.int32), np.array(radii)


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the points in farthest-first order: every prefix covers the points as a cover tree's level does."""
    if not len(points):
        return points
    chosen, apart = [0], _apart(points, points[0])
    while len(chosen) < most and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _apart(points, points[chosen[-1]]))
    return points[chosen]


class Best:
    """The k best candidates so far of each of some queries."""

    def __init__(self, rows: np.ndarray, k: int):
        self.own, self.k = rows, k
        self.score = np.full((len(rows), k), NOTHING)
        self.id, self.row = np.full((len(rows), k), NO_ID), np.full((len(rows), k), -1)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """More candidates of queries; for ties the smaller id."""
        met = np.unique(query)
        old = self.row[met] >= 0
        query = np.concatenate([np.repeat(met, old.sum(axis=1)), query])
        score, ids, rows = (np.concatenate([kept[met][old], new]) for kept, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        at, order = (query[top], place[top]), order[top]
        self.score[at], self.id[at], self.row[at] = score[order], ids[order], rows[order]


@dataclass
class Tile:
    tree: Tree
    ids: np.ndarray
    rows: np.ndarray

    @classmethod
    def read(cls, part: pa.Table, wide: int) -> Tile:
        held = {c: np.frombuffer(part[c][0].as_py(), kind) for c, kind in (("ids", np.int64), ("rows", np.int64), ("nodes", np.int32), ("radii", np.float64))}
        data = part["data"][0].as_py()
        held["data"] = np.frombuffer(data, np.int16 if len(data) == 2 * wide * len(held["ids"]) else np.int32)
        return cls(Tree(held["data"].reshape(-1, wide), *held["nodes"].reshape(-1, 5).T, held["radii"]), held["ids"], held["rows"])


def _products(q: np.ndarray, d: np.ndarray, most: float) -> np.ndarray:
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind) @ d.T.astype(kind)


def _compare(best: Best, queries: Tile, data: Tile, qs: slice, ds: slice, most: float) -> None:
    """All points of two leaves."""
    step = max(1, (1 << 22) // max(1, ds.stop - ds.start))
    ids, rows = data.ids[ds], data.rows[ds]
    for at in range(qs.start, qs.stop, step):
        q = slice(at, min(at + step, qs.stop))
        found = _products(queries.tree.points[q], data.tree.points[ds], most)
        query, place = np.nonzero(found >= best.kth[q, None])
        own = best.own[q][query] == rows[place]
        query, place = query[~own], place[~own]
        score = found[query, place].astype(np.int64)
        if len(query) > 8 * best.k * (q.stop - q.start):
            # the k best of each query only; a stable order keeps the smaller id among ties
            order = np.lexsort((ids[place], -score, query))
            query, place, score = query[order], place[order], score[order]
            top = np.arange(len(query)) - np.searchsorted(query, query) < best.k
            query, place, score = query[top], place[top], score[top]
        if len(query):
            best.add(query + at, score, ids[place], rows[place])


def search(best: Best, queries: Tile, data: Tile) -> int:
    """Both trees from their roots, pruned by the queries' kth scores; the number of pairs of points compared."""
    q, d = queries.tree, data.tree
    if not len(q.points) or not len(d.points):
        return 0
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
    most, compared = norm(q.points) * norm(d.points) * 1.001, 0

    def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the inner products below pairs of nodes can't exceed, with room for rounding."""
        top = np.einsum("ij,ij->i", q.at[a], d.at[b]) + q.radius[a] * d.norm[b] + d.radius[b] * q.norm[a] + q.radius[a] * d.radius[b]
        return top + 1 + 1e-9 * np.abs(top)

    open_ = [(above(np.array([0]), np.array([0]))[0], 0, 0)]
    while open_:
        top, a, b = open_.pop()
        qs, ds = slice(int(q.start[a]), int(q.end[a])), slice(int(d.start[b]), int(d.end[b]))
        if top < best.kth[qs].min():
            continue
        if not q.count[a] and not d.count[b]:
            compared += (qs.stop - qs.start) * (ds.stop - ds.start)
            _compare(best, queries, data, qs, ds, most)
            continue
        # queries without k candidates yet are split, so that each group finds its own; then the wider node is.
        # What may hold the best comes last, and so is taken next.
        unmet = best.kth[qs].min() == NOTHING
        if d.count[b] and not (q.count[a] and (unmet or q.radius[a] > d.radius[b])):
            right = np.arange(d.first[b], d.first[b] + d.count[b])
            left = np.full(len(right), a)
        else:
            left = np.arange(q.first[a], q.first[a] + q.count[a])
            right = np.full(len(left), b)
        tops = above(left, right)
        open_ += [(tops[i], int(left[i]), int(right[i])) for i in np.argsort(tops)]
    return compared


def _tiles(routed: DataFrame, cell: str, rows_each: int, wide: int) -> DataFrame:
    """(cell, salt, radius, ...): about rows_each rows of a cell a tile, with their cover tree.

    A cell's size (one row a cell, at most CELLS) says into how many tiles a hash deals its rows.
    """
    salts = F.broadcast(routed.groupBy(cell).agg(F.ceil(F.count("*") / rows_each).alias("salts")).withColumnRenamed(cell, "of"))
    salted = routed.join(salts, F.col(cell) == F.col("of")).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(part["data"].to_pylist()), np.int32).reshape(-1, wide)
        order, nodes, radii = cover_tree(x)
        ids, rows = (part[c].to_numpy()[order] for c in ("id", "row"))
        small = np.abs(x).max(initial=0) < 2**15  # two bytes a component then
        held = {"ids": ids, "rows": rows, "data": x[order].astype(np.int16 if small else np.int32), "nodes": nodes, "radii": radii}
        return pa.table({"cell": part["cell"][:1], "salt": part["salt"][:1], "radius": pa.array([part["apart"].to_numpy().max()]), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in held.items()}})

    apart = f"{cell}_apart"
    named = salted.select(F.col(cell).alias("cell"), "salt", F.col(apart).alias("apart"), "row", "id", "data")
    return named.groupBy("cell", "salt").applyInArrow(build, f"cell int, salt int, radius double, {TILE_COLUMNS}")


def _routed(vectors: DataFrame, wide: int, centres: np.ndarray, coarse: int) -> DataFrame:
    """(row, id, data, cell, cell_apart, coarse, coarse_apart): each row's nearest centre, of all and of the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (centres**2).sum(axis=1)
        for batch in batches:
            v, n = batch.column(2), batch.num_rows
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((n, wide), np.int32)
            x[np.arange(wide)[None, :] < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            whole = x.astype(np.float64)
            square = size[None, :] - 2 * (whole @ centres.T)
            cells = [square.argmin(axis=1), square[:, :coarse].argmin(axis=1)]
            aparts = [_apart(whole, centres[c]) for c in cells]
            data = x.tobytes()
            step = 4 * wide
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).fill_null(NO_ID), pa.array([data[i * step : (i + 1) * step] for i in range(n)], pa.binary()), *(pa.array(y, t) for c, d in zip(cells, aparts, strict=True) for y, t in ((c, pa.int32()), (d, pa.float64())))],
                ["row", "id", "data", "cell", "cell_apart", "coarse", "coarse_apart"],
            )

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    return rows.mapInArrow(run, "row long, id long, data binary, cell int, cell_apart double, coarse int, coarse_apart double")


def _seeded(queries: DataFrame, data: DataFrame, k: int, wide: int) -> DataFrame:
    """Query tiles with the k best of each query in one data tile of the same centre, and the least kth score of the tile."""
    kinds = f"cell int, salt int, radius double, {TILE_COLUMNS}, least long, score binary, id binary, found binary"
    made = to_arrow_schema(T._parse_datatype_string(kinds))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return made.empty_table()
        tile = Tile.read(mine, wide)
        best = Best(tile.rows, k)
        if theirs.num_rows:
            search(best, tile, Tile.read(theirs, wide))
        held = {"least": [best.kth.min()], "score": [best.score.tobytes()], "id": [best.id.tobytes()], "found": [best.row.tobytes()]}
        return pa.Table.from_arrays([*(mine[c] for c in made.names[:8]), *(pa.array(v, made.field(c).type) for c, v in held.items())], schema=made)

    first = data.where("salt = 0").select(F.col("cell").alias("of"), "ids", "rows", "data", "nodes", "radii")
    sent = queries.select("cell", "salt").join(first, F.col("cell") == F.col("of")).select(F.col("cell").alias("of_cell"), F.col("salt").alias("of_salt"), "ids", "rows", "data", "nodes", "radii")
    return queries.groupBy("cell", "salt").cogroup(sent.groupBy("of_cell", "of_salt")).applyInArrow(run, kinds)


def _pairs(queries: DataFrame, data: DataFrame, centres: np.ndarray) -> DataFrame:
    """(q_cell, q_salt, d_cell, d_salt) of the tiles whose points could still be among the best: cells first, then their tiles."""
    spark = queries.sparkSession
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "centre int, at array<double>")  # at most CELLS rows
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    cells = lambda tiles, *more: tiles.groupBy("cell").agg(F.max("radius").alias("r"), *more).join(F.broadcast(listed), F.col("cell") == F.col("centre")).select("cell", "r", "at", norm("at").alias("norm"), *(["least"] if more else []))
    q = cells(queries, F.min("least").alias("least")).alias("q")
    d = cells(data).alias("d")
    dot = F.aggregate(F.zip_with("q.at", "d.at", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    above = lambda r, s: F.col("dot") + r * F.col("d_norm") + s * F.col("q_norm") + r * s
    held = lambda top, least: top + 1 + 1e-9 * F.abs(top) >= least
    # one row a cell on both sides
    met = q.join(F.broadcast(d), F.lit(True)).select(F.col("q.cell").alias("q_cell"), F.col("d.cell").alias("d_cell"), dot.alias("dot"), F.col("q.norm").alias("q_norm"), F.col("d.norm").alias("d_norm"), F.col("q.r").alias("q_r"), F.col("d.r").alias("d_r"), F.col("q.least").alias("cell_least"))
    met = met.where(held(above(F.col("q_r"), F.col("d_r")), F.col("cell_least")))
    left = queries.select(F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"), F.col("radius").alias("q_radius"), "least")
    right = data.select(F.col("cell").alias("d_cell"), F.col("salt").alias("d_salt"), F.col("radius").alias("d_radius"))
    pairs = met.join(left, "q_cell").join(right, "d_cell").where(held(above(F.col("q_radius"), F.col("d_radius")), F.col("least")))
    return pairs.where("not (q_cell = d_cell and d_salt = 0)").select("q_cell", "q_salt", "d_cell", "d_salt")


FOUND = "query long, query_id long, id long, found long, score long"


def _found(tile: Tile, best: Best, new: np.ndarray) -> pa.Table:
    at, _ = np.nonzero(new)
    return pa.table({"query": tile.rows[at], "query_id": tile.ids[at], "id": best.id[new], "found": best.row[new], "score": best.score[new]})


def _best_of(part: pa.Table, tile: Tile, k: int) -> Best:
    best = Best(tile.rows, k)
    best.score, best.id, best.row = (np.frombuffer(part[c][0].as_py(), np.int64).reshape(-1, k).copy() for c in ("score", "id", "found"))
    return best


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, id_key: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, score): the k candidates of the largest inner product for each row that is a query.

    vectors has whole components in `v` (vector_codes.whole_vectors); is_query is a condition on `id`.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_key).cast("long").alias("id"), "v")
    sizes = vectors.agg(F.max(F.size("v")).alias("wide"), F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("asked")).first()
    if not sizes["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    wide = max(1, sizes["wide"])
    fine, coarse = (max(1, min(CELLS, n // each)) for n, each in ((sizes["n"], TILE), (sizes["asked"], QUERY_TILE)))
    sample = vectors.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLED * fine).toArrow()["v"].to_pylist()
    points = np.zeros((len(sample), wide))
    for i, v in enumerate(sample):
        points[i, : len(v)] = v
    centres = spread(points, fine)
    coarse = min(coarse, len(centres))
    routed = stored(_routed(vectors, wide, centres, coarse), "routed")
    data = stored(_tiles(routed, "cell", TILE, wide), "tiles")
    asking = stored(_tiles(routed.where(f"({is_query}) and id != {NO_ID}"), "coarse", QUERY_TILE, wide), "asking")
    queries = stored(_seeded(asking, data, k, wide), "seeded")
    pairs = stored(_pairs(queries, data, centres), "pairs")

    def searched(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        tile, other = Tile.read(mine, wide), Tile.read(theirs, wide)
        best = _best_of(mine, tile, k)
        search(best, tile, other)
        return _found(tile, best, np.isin(best.row, other.rows))

    def known(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                one = pa.Table.from_batches([part.slice(i, 1)])
                tile = Tile.read(one, wide)
                best = _best_of(one, tile, k)
                yield from _found(tile, best, best.row >= 0).to_batches()

    key = ["q_cell", "q_salt", "d_cell", "d_salt"]
    payload = ["ids", "rows", "data", "nodes", "radii"]
    named = lambda tiles, p, more: tiles.select(F.col("cell").alias(f"{p}_cell"), F.col("salt").alias(f"{p}_salt"), *payload, *more)
    left = pairs.join(named(queries, "q", ["score", "id", "found"]), key[:2]).groupBy(*key)
    right = pairs.join(named(data, "d", []), key[2:]).withColumnsRenamed({c: f"of_{c}" for c in key}).groupBy(*(f"of_{c}" for c in key))
    found = left.cogroup(right).applyInArrow(searched, FOUND).union(queries.select(*payload, "score", "id", "found").mapInArrow(known, FOUND))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "found"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias("id"), "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "v")
    return exact_top_k(vectors, "id % 50 = 0").withColumnRenamed("id", "vec_id")


OP13_SQL = """WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (SELECT q.vec_id AS query_id, q.rid, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM kept q JOIN kept c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5"""
