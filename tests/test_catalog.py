import pytest

import __spark_entry__ as entry
from docquery import catalog
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, duck, sf):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["keyword_topk", "sections_web", "chunk_json", "config_blocks", "doc_freq", "hybrid_rrf"])
def test_partitions_change_nothing(name, spark, sf):
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(plain(catalog.QUERIES[name](spark, sf).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_store_page_writes_small_and_large_numbers_as_sql_does(spark, tmp_path):
    import duckdb

    values = [0.0001, -0.0001, -0.00001, -0.0, 0.0, 0.00034, -3e-4, 1.0, -12.5, 0.03125, 12345678.5, 1e7, 1e15, 2.0**54, -1e17, float("nan"), float("inf"), float("-inf"), None, 0.5, 100.0, 0.1003]
    rows = [(i, (values * 2)[i % len(values) :][:8]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["store_page"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLES["store_page"]).fetchall())
