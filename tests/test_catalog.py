"""Every query of the catalogue against DuckDB on the smallest tables."""

import duckdb
import pytest
from paths import SMALL

from fitspark.plans import candidates, catalog, parts, workflows  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_lookup_is_pushed_down(spark):
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in plan(catalog.point_lookup(spark, SMALL))


def test_top_k_is_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.vector_topk(spark, SMALL))
    assert "WindowGroupLimit" in plan(catalog.vector_topk_per_label(spark, SMALL))


def test_row_wise_queries_do_not_shuffle(spark):
    for name in ("notice_ladder", "recency_ladder", "gaussian_band", "token_sets", "html_to_text", "ordered_dedup_lines"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, SMALL)), name


def test_metrics_join_no_table_with_itself(spark):
    assert "Join" not in plan(catalog.pairwise_accuracy(spark, SMALL))


def test_only_the_columns_needed_are_read(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan(catalog.topk_mean_shrunk(spark, SMALL))
