"""Driver contract: entry() and every registered query run at sf0.001."""

import pytest

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"run_id", "stage", "calls", "total_tokens", "cache_hit_rate"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    df.limit(5).collect()
    assert len(df.columns) == len(set(df.columns))
