import re

from pyspark.sql import functions as F

from millrace.operators import records, resume, telemetry

RECORDS = [("x", None, "p1", 0, "boom-free"), ("x", "transport: boom", "p1", 1, None), ("x", None, "p1", 2, "good"), ("y", "http 500", "p1", 3, None), ("z", None, "p1", 4, "fine"), ("x", "later", "p2", 0, None), ("z", None, "p2", 1, "latest"), ("e", "", "p2", 2, None)]


def frame(spark):
    return spark.createDataFrame(RECORDS, "id string, error string, part string, pos int, out string")


def test_last_success_wins(spark):
    assert {r.id: r.out for r in resume.healed(frame(spark)).collect()} == {"x": "good", "z": "latest"}


def test_empty_error_is_done_but_no_success(spark):
    assert "e" in {r.id for r in resume.existing_ids(frame(spark), retry_errors=True).collect()}
    assert "e" not in {r.id for r in resume.healed(frame(spark)).collect()}


def test_retry_errors_leaves_only_done(spark):
    assert {r.id for r in resume.existing_ids(frame(spark)).collect()} == set("xyze")
    assert {r.id for r in resume.existing_ids(frame(spark), True).collect()} == set("xze")
    assert [r.id for r in resume.error_only_ids(frame(spark)).collect()] == ["y"]


def test_counts_add_up(spark):
    rows = spark.createDataFrame([(i, n) for n, i in enumerate("xxyabbb")], "id string, n int")
    c = resume.resume_counts(rows, frame(spark)).first().asDict()
    assert c == {"rows_total": 7, "rows_done_prior": 3, "rows_errored_prior": 1, "rows_deduped": 2, "rows_to_do": 2}
    left = resume.skip_done(rows, frame(spark), "n").collect()
    assert {(r.id, r.n) for r in left} == {("a", 3), ("b", 4)}


def test_positions_without_gaps(spark):
    df = spark.createDataFrame([(7 * i * i,) for i in range(500)], "k long").orderBy(F.rand(3))
    for buckets in (None, 1, 40):
        got = {r.k: r.pos for r in resume.by_position(df, "k", buckets=buckets).collect()}
        assert got == {7 * i * i: i for i in range(500)}
    assert resume.by_position(df.where("false"), "k").count() == 0


def test_fail_fast_needs_all_of_the_first(spark):
    df = spark.createDataFrame([(i, "bad" if i < 3 else None) for i in range(6)], "n int, error string")
    assert records.first_rows_failed(df, "n", 3)
    assert not records.first_rows_failed(df, "n", 4)
    assert not records.first_rows_failed(df.where("n < 2"), "n", 3)


def test_breaker_runs(spark):
    df = spark.createDataFrame([(0, i, c == "x") for i, c in enumerate("xx.xxx..x")], "lane int, n int, bad boolean")
    assert {(r.start, r.stop, r.n) for r in telemetry.breaker_runs(df, "n", F.col("bad"), 2).collect()} == {(0, 1, 2), (3, 5, 3)}


def test_hit_rates_by_series(spark):
    from millrace.functions import engine

    readings = [(1000, 600), (2000, 1500), (2000, 1500), (100, 10), (300, 50)]
    df = spark.createDataFrame([(i, "a", float(q), float(h)) for i, (q, h) in enumerate(readings)], "scrape int, labels string, queries double, hits double")
    assert [r.rate for r in engine.hit_rates(df).orderBy("scrape").collect()] == [None, 0.9, None, None, 0.2]


def test_templates_are_seeded_by_their_name(spark):
    import zlib

    got = records.template_rows(spark.range(5), "id", "a-b", ("x", "y", "z"), 4).collect()
    assert [r.seed for r in got] == [zlib.crc32(f"a-b-{i}".encode()) for i in range(5)]
    assert got[1].text == "[a-b] Summarise in one sentence (item 1): y y y y"


def test_input_hints(spark):
    """Half the ticks wait for requests to be built, a third for the input, the rest for parsing; then each alone."""
    kinds = "t double, bound_by string, ok long, bp long, prep_s double, prep_n long, source_s double, loop_lag_s double"
    slow = {"prep": {"prep_s": 0.75, "prep_n": 30}, "source": {"source_s": 1.5, "ok": 11, "bp": 1}, "loop": {"loop_lag_s": 1.25}}

    def hints(*bounds, workers=0):
        rest = dict.fromkeys(("ok", "bp", "prep_n"), 0) | dict.fromkeys(("prep_s", "source_s", "loop_lag_s"), 0.0)
        rows = [{"t": 5.0 * (i + 1), "bound_by": b, **rest, **slow.get(b, {})} for i, b in enumerate(bounds)]
        return [r.hint.split(":")[0] + " " + "/".join(re.findall("[0-9]+(?= ms|%)", r.hint)) for r in telemetry.input_hints(telemetry.advise_input(spark.createDataFrame(rows, kinds)), workers).collect()]

    assert hints(*["prep"] * 5, *["source"] * 4, *["loop"]) == ["PREP-BOUND 25", "SOURCE-BOUND 125"]
    assert hints(*["prep", "source", "loop"] * 2) == ["PREP-BOUND 25", "SOURCE-BOUND 125", "LOOP-BOUND 8"]
    assert hints("loop", None, "engine") == ["LOOP-BOUND 8"] and hints("source", "source", *["engine"] * 6) == []
    assert hints("prep", "prep") == [] and hints() == []
    said = lambda workers: telemetry.input_hints(spark.createDataFrame([(25, None, None)], "prep_ms long, source_ms long, loop_pct long"), workers).first().hint
    assert "prepare_workers=4" in said(3) and "at 4 workers (25 ms/row)" in said(4)
