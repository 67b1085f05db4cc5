"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

from pathlib import Path

import corpora
import pytest
from plain_pii import private_spans
from test_operators import brute_groups, lower_words, measures

import corpus_pipeline
from millrace.llm import common, mixing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(name, spark, sf, same):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_a_row_for_each_input_row(name, spark, sf):
    source = "pages" if name.startswith("op5") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_pipeline_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = []
    for r in rows:
        n, chars, symbols, dup, rep = measures(r[1])
        lines = [x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        if not (n < 10 or 100 * rep > 20 * n or 10 * symbols > 3 * n or 2 * r[1].count("!") > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n):
            kept.append(r)
    _, names = brute_groups(kept)
    kept = [r for r, n in zip(kept, names, strict=True) if r[0] == n]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = lower_words(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1) if n}
    clean = []
    for r in kept:
        w, hit = lower_words(r[1]), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {r[0] for r in clean}
    for (i, text, *_), spans in zip(clean, private_spans([r[1] for r in clean]), strict=True):
        out, upto = [], 0
        for kind, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
            if a >= upto:
                out.append(text[upto:a] + f"[{kind.upper()}]")
            upto = max(upto, b)
        assert got[i] == "".join(out) + text[upto:]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in mixed.collect()} <= set(got)
    assert {"size", "taken", "position"} <= set(mixed.columns)


# ---- the pipeline on odd and empty tables


def tables(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("clashing", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, clashing):
    docs = corpora.odd(spark, clashing)
    extra = [(500 + i, f"{corpora.words(900 + i, 50)} mail user{i}@mail.example.org now", "en", "s1", 1) for i in range(3)]
    more = spark.createDataFrame(extra * 2, corpora.SCHEMA)
    docs = docs.unionByName(more, allowMissingColumns=True)
    sf = tables(spark, tmp_path, docs, [(1, corpora.odd_rows()[11][1]), (2, None), (None, "")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows.count(), stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns and rows.count() <= before, name
    got = rows.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 500) == [500, 501, 502]
    assert all("[EMAIL]" in r.text for r in got if r.doc_id is not None and r.doc_id >= 500)
    assert 10 not in {r.doc_id for r in got} and all(r.text for r in got)
    mixed = corpus_pipeline.run(spark, sf)
    assert [c for c in mixed.columns if c not in ("size", "taken", "position")] == [c for c in docs.columns if c not in ("size", "taken", "position")]
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in got}


def test_pipeline_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, corpora.empty(spark), [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    full = tables(spark, tmp_path / "full", corpora.odd(spark), [])
    docs = spark.read.parquet(f"{full}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, full).count() == docs.count()


def test_scratch_deletes_what_was_stored(spark):
    with common.scratch() as held:
        a, b = (common.stored(spark.range(n), "x") for n in (3, 4))
        held.pop()
    assert b.count() == 4 and not Path(a.stored_at.removeprefix("file://")).exists()
    common.release(b)


def test_ties_without_an_id_are_mixed(spark):
    rows = [(None, f"w {i}", "en", "s", 0) for i in range(50)] + [(None, "w w", "en", "t", 0)] * 7
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(4)
    runs = [sorted((r.source, r.size, r.taken, r.position) for r in mixing.mixed(docs).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and sum(r[2] for r in runs[0]) >= 100
