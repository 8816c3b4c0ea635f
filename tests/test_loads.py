"""S6 by loads: merged profiles equal a full run."""

import os

from pyspark.sql import functions as F

from promoscope.operators.quality import add_load, checks_of_loads, compact_loads, quality_checks
from promoscope.sources.star import RetailStar
from promoscope.sources.testdata_star import testdata_star as build_star


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_three_loads_equal_a_full_run(spark, sf_small, tmp_path):
    whole = build_star(spark, sf_small)
    # faults that only show across loads: a store key in two loads, events whose product comes in a later load or never
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    fact = whole.fact_events.withColumn("store_id", F.when(F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(50)) == 0, None).otherwise(F.col("store_id")))
    products = whole.dim_products.filter(F.pmod(F.xxhash64("product_code"), F.lit(10)) > 0)
    once, again = whole.dim_stores, whole.dim_stores.filter(F.pmod(F.xxhash64("store_id"), F.lit(4)) == 0)
    whole = RetailStar(fact, whole.dim_campaigns, products, once.union(again))
    root = str(tmp_path / "profiles")
    for k in range(3):
        of = lambda df, key: df.filter(F.pmod(F.xxhash64(key, F.lit(9)), F.lit(3)) == k)
        shops = {0: whole.dim_stores.filter("1 = 0"), 1: once, 2: again}[k]
        load = RetailStar(fact.filter(part == k), of(whole.dim_campaigns, "campaign_id"), of(products, "product_code"), shops)
        add_load(load, root, f"2031-04-0{k + 1}")
        if k == 1:
            add_load(load, root, f"2031-04-0{k + 1}")           # again: replaces itself
    want = _rows(quality_checks(whole))
    assert _rows(checks_of_loads(spark, root)) == want and any(v for _, v in want)
    compact_loads(spark, root)
    assert os.listdir(f"{root}/fact_events") and _rows(checks_of_loads(spark, root)) == want
    assert [d for d in os.listdir(f"{root}/dim_stores") if d.startswith("load=")] == ["load=compacted"]


def test_a_load_reads_nothing_but_itself(spark, sf_small, tmp_path):
    star = build_star(spark, sf_small)
    root = str(tmp_path / "profiles")
    empty = RetailStar(*(df.filter("1 = 0") for df in (star.fact_events, star.dim_campaigns, star.dim_products, star.dim_stores)))
    add_load(star, root, "1")
    add_load(empty, root, "2")
    plan = checks_of_loads(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and _rows(checks_of_loads(spark, root)) == _rows(quality_checks(star))
