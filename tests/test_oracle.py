"""Every registered query against its DuckDB oracle on the driver's sf0.001
tables (the driver repeats this at sf0.01)."""

import pytest

from tools.compare import compare

def test_every_key_has_an_oracle():
    from promoscope.plans.catalog import registry
    from promoscope.plans.oracle import oracle_queries
    assert set(registry()) == set(oracle_queries())
    assert len(registry()) >= 39


def test_all_queries_match_oracle(spark, sf_small):
    from promoscope.plans.catalog import registry
    res = compare(spark, sf_small, list(registry()), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["campaign_name", "total_revenue_before_promotion", "total_revenue_after_promotion"]
    assert len(rows) > 0
    assert all(r[1].endswith("M") for r in rows)
