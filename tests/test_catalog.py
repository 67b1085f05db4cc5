import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(name, spark, sf, same):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_data_uris_of_long_addresses_are_one_line(spark, tmp_path):
    urls = [None, "", *("https://a.example/é?" + "x" * n for n in (34, 35, 36, 37, 38, 200, 5000))]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.data_uris(spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.execute(catalog.ORACLES["data_uris"]).fetchall())
    assert not any(set("\r\n") & set(uri or "") for _, uri in got)
