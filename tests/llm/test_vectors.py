"""Vector codes, exact search and aligned tokens against plain versions, on odd tables too."""

import hashlib
import math
import random

import numpy as np
import pytest
from corpora import words
from pyspark.sql import functions as F

from millrace.llm import alignment, top_k, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, cell int"


def floors(x):
    return [max(-(2**27), min(2**27, math.floor(256.0 * float(np.float32(c))))) for c in x]


def usable(rows):
    return [(i, floors(x), label) for i, x, label, *_ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]


def table(spark, folder, rows):
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def odd_vectors(seed, n, wide, clumps=3):
    """Clumps of copies and near copies, with nulls, odd numbers and repeated ids among them."""
    dice = random.Random(seed)
    centres = [[dice.uniform(-1, 1) for _ in range(wide)] for _ in range(clumps)]
    rows = []
    for i in range(n):
        c = dice.choice(centres)
        spread = dice.choice((0, 0.01, 0.5))
        rows.append((dice.choice((i, i, i, i // 2)), [x + dice.uniform(-spread, spread) for x in c], dice.choice((0, 0, 1, None)), "clash", 7))
    odd = [(None, centres[0]), (3, None), (50, [None] * wide), (100, [math.nan] + [0.0] * (wide - 1)), (150, [math.inf] + [0.0] * (wide - 1)), (200, [3e38] + [0.0] * (wide - 1)), (2**40, [-0.001] * wide)]
    return rows + [(i, x, None, "clash", 7) for i, x in odd]


# ---- codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == wide]
    size = -(-wide // parts) if wide else 0
    cut = lambda v: [(v + [0] * (size * parts - wide))[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((apart(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        books = [
            [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if (mine := [x for x in xs if near(p, x)[1] == k]) else e for k, e in enumerate(books[p])]
            for p, xs in enumerate(zip(*(cut(r[1]) for r in kept), strict=True))
        ]
    found = [(r, [near(p, x) for p, x in enumerate(cut(r[1]))]) for r in kept]
    total = {}
    for r, f in found:
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[r[2]], digest) for r, f in found)


@pytest.mark.parametrize(("n", "wide"), [(150, 16), (30, 20), (90, 3), (70, 32)])
def test_codes_against_a_plain_version(spark, tmp_path, n, wide):
    rows = [*odd_vectors(n, n, wide), (7, [0.5] * (wide + 1), 1, "longer", 7), (8, [], 1, "none", 7)]
    got = vector_codes.op11_vector_codes(spark, table(spark, tmp_path, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_of_no_vectors(spark, tmp_path):
    empty = vector_codes.op11_vector_codes(spark, table(spark, tmp_path, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    none = vector_codes.op11_vector_codes(spark, table(spark, tmp_path / "none", [(1, None, 1, "", 1), (2, [None], 1, "", 1)]))
    assert none.count() == 0 and none.dtypes == empty.dtypes


def test_codes_do_not_depend_on_how_rows_are_dealt_and_read_back(spark, tmp_path):
    rows = [(i, [math.sin(i * (j + 1)) for j in range(32)], 0, "", 0) for i in range(300)]
    vectors = vector_codes.whole_vectors(spark.createDataFrame(rows, VECTORS)).select("vec_id", "v")
    start = vector_codes.first_books(vectors, "vec_id")
    books = [vector_codes.learned(vector_codes.column_blocks(vectors.repartition(n)), start) for n in (1, 7)]
    assert (books[0] == books[1]).all() and books[0].shape == (16, 64, 2)
    read = vector_codes.encoded(vectors, books[0], 32).withColumn("x", vector_codes.decoded(F.col("code"), books[0])).join(vectors, "vec_id")
    for r in read.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.x, r.v, strict=True)) == r.error


# ---- exact search


def plain_top(rows, step=50, k=5):
    kept = list(enumerate(usable(rows)))
    wide = max((len(r[1]) for _, r in kept), default=0)
    pad = lambda v: v + [0] * (wide - len(v))
    out = []
    for q, (i, v, _) in kept:
        if i is not None and i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(pad(v), pad(w), strict=True)), j is None, j or 0) for c, (j, w, _) in kept if c != q)
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "wide", "clumps"), [(400, 8, 5), (60, 3, 1), (300, 40, 2), (4, 4, 4)])
def test_search_against_brute_force(spark, tmp_path, n, wide, clumps, monkeypatch):
    monkeypatch.setattr(top_k, "TILE", 60)
    monkeypatch.setattr(top_k, "QUERY_TILE", 3)
    rows = [*odd_vectors(n, n, wide, clumps), (0, [0.25], 1, "shorter", 7), (50, [], 1, "none", 7)]
    got = top_k.op13_exact_top_k(spark, table(spark, tmp_path, rows))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == plain_top(rows)


def test_search_without_queries_or_candidates(spark, tmp_path):
    columns = ["query_id", "rank", "vec_id", "score"]
    for name, rows in (("empty", []), ("none", [(50, None, 1, "", 1)]), ("asked", [(7, [1.0], 1, "", 1)]), ("alone", [(50, [1.0], 1, "", 1), (None, None, 1, "", 1)])):
        got = top_k.op13_exact_top_k(spark, table(spark, tmp_path / name, rows))
        assert got.count() == 0 and got.columns == columns


def test_trees_cover_their_points_and_prune():
    dice = np.random.default_rng(4)
    centres = dice.integers(-2000, 2000, (20, 6))
    points = (centres[dice.integers(0, 20, 3000)] + dice.integers(-15, 16, (3000, 6))).astype(np.int32)
    order, nodes, radii = top_k.cover_tree(points)
    held = points[order].astype(float)
    assert sorted(order) == list(range(3000)) and len(nodes) > 20
    for (start, end, centre, first, count), radius in zip(nodes, radii, strict=True):
        assert np.sqrt(((held[start:end] - held[centre]) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if count:
            children = nodes[first : first + count]
            assert children[0][0] == start and children[-1][1] == end and (children[1:, 0] == children[:-1, 1]).all()
            at = held[children[:, 2]]
            far = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))[~np.eye(count, dtype=bool)]
            assert count < 2 or far.min() > radius / 2
            assert max(radii[first : first + count]) <= radius / 2 + 1e-9
    tile = lambda x, rows: top_k.Tile(top_k.Tree(x[(t := top_k.cover_tree(x))[0]], *t[1].T, t[2]), rows[t[0]], rows[t[0]])
    queries = tile(points[:200], np.arange(200))
    best, data = top_k.Best(queries.rows, 5), tile(points, np.arange(3000))
    compared = top_k.search(best, queries, data)
    scores = points[:200].astype(np.int64) @ points.T.astype(np.int64)
    scores[np.arange(200), np.arange(200)] = np.iinfo(np.int64).min
    want = [sorted((-s, i) for i, s in enumerate(row))[:5] for row in scores.tolist()]
    assert [[(-s, i) for s, i in zip(best.score[q], best.id[q], strict=True)] for q in np.argsort(queries.rows)] == want
    assert compared < 0.3 * 200 * 3000


def test_scores_are_exact_where_floats_are_not():
    big = np.array([[2**27, 2**27 - 1, 1], [2**27 - 1, 2**27, -1]], np.int64)
    assert (top_k._products(big, big, 2.0**55) == big.astype(object) @ big.T.astype(object)).all()


# ---- aligned tokens

TEXTS = ["", None, "Hello wörld  \n x", "a▁b", "naïve 😀 test", " leading", "trailing ", "   ", "\n\n x\ty", "a\x00b", "<s> <|endoftext|> </s>", "x" * 3000, " " * 4000 + "z", "12 345,678.9 don't I'LL", "日本語のテキスト" * 20, "a  b  c", "\x1c d"]


def plain_alignment(text):
    """(ids, ids, groups) by the two libraries on the whole text, with sets of ends."""
    if not text:
        return [], [], []
    pair = alignment.pair_of()
    a, b = pair.whole.encode(" " + text, add_special_tokens=False).ids, pair.pieces.encode([text])[0]
    if any(b"".join(side.names[i] for i in x) != (" " + text).encode() for side, x in ((pair.a, a), (pair.b, b))):
        return [], [], []
    groups, ends = [], [np.cumsum([len(side.names[i]) for i in x]).tolist() for side, x in ((pair.a, a), (pair.b, b))]
    i = j = 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        to = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((a[i : to[0]], b[j : to[1]]))
        i, j = to
    return a, b, groups


def test_alignment_against_a_plain_version(spark, tmp_path):
    texts = [*TEXTS, *(words(i, 60) for i in range(20)), "Hello wörld  \n x"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, links string, n_a int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plain = [plain_alignment(t) for t in texts]
    linked = [[(a[-1], b[-1]) for a, b in groups] for *_, groups in plain]
    count, most = {}, {}
    for pair in (x for doc in linked for x in doc):
        count[pair] = count.get(pair, 0) + 1
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    said = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups) for *_, groups in plain]
    want = [
        (i, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(t.encode()).hexdigest() if a else "")
        for i, ((a, b, g), x, t) in enumerate(zip(plain, linked, said, strict=True))
    ]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.op12_cross_tokenizer(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == want
    assert [r.n_a for r in sorted(got)][:4] == [0, 0, 8, 0]
    groups = {r.doc_id: r for r in alignment.token_groups(docs).collect()}
    for i, (a, b, g) in enumerate(plain):
        r = groups[i]
        assert (r.a, r.b) == (a, b) and r.a_to == np.cumsum([len(x) for x, _ in g]).tolist() and r.b_to == np.cumsum([len(y) for _, y in g]).tolist()


def test_alignment_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op12_cross_tokenizer(spark, str(tmp_path)).count() == 0


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    pair = alignment.Pair(alignment.BYTES, alignment.PIECES)
    for turn in range(3):
        for i in range(6):
            t = words(10 * turn + i, 30)
            x = alignment.align(pair, [t])
            a, b, _ = plain_alignment(t)
            assert (x.a.tolist(), x.b.tolist()) == (a, b)


def test_bitsets():
    dice = np.random.default_rng(1)
    flags = dice.random(1000) < 0.3
    bits = alignment.Bitset.of(np.flatnonzero(flags), 1000)
    assert bits.select().tolist() == np.flatnonzero(flags).tolist()
    assert bits.rank(np.arange(1000)).tolist() == np.cumsum(flags).tolist()
    other = alignment.Bitset.of(np.arange(0, 1000, 2), 1000)
    assert (bits & other).select().tolist() == [i for i in np.flatnonzero(flags) if i % 2 == 0]


def test_every_link_is_among_the_possible_pairs():
    pair = alignment.pair_of()
    assert len(pair.keys) < 500_000 and (np.diff(pair.keys) > 0).all()
    for t in TEXTS:
        x = alignment.align(pair, [t or ""])
        at = alignment.links(pair, x)
        assert (pair.keys[at] == x.a[x.a_to - 1].astype(np.int64) * len(pair.b.names) + x.b[x.b_to - 1]).all()
