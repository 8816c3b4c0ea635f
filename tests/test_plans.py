"""Plan shape: pushdown, no fact shuffle before partial aggregation, no
cartesian product other than the one-row scalar broadcast."""

import pytest

from promoscope.plans import reports as R
from promoscope.sources.testdata_star import testdata_star as build_star


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark, sf_small, tmp_path):
    """On a physical star (Parquet, as loaded by ``read_parquet_star``) Q1's
    promo and price predicates are pushed into the fact scan."""
    from promoscope.sources.retail import read_parquet_star
    star = build_star(spark, sf_small)
    root = str(tmp_path / "star")
    for name in ("fact_events", "dim_campaigns", "dim_products", "dim_stores"):
        getattr(star, name).write.parquet(f"{root}/{name}")
    p = _plan(R.q1_high_value_bogof(read_parquet_star(spark, root)))
    assert "EqualTo(promo_type,BOGOF)" in p and "GreaterThan(base_price," in p, p


def test_no_cartesian_products(spark, sf_small):
    star = build_star(spark, sf_small)
    q4 = lambda star: R.q4_campaign_isu_rank(star, "FY1998")
    for fn in (R.q3_campaign_revenue, q4, R.city_performance, R.category_lift,
               R.top_stores_summary, R.product_axis_order):
        p = _plan(fn(star))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, fn
    p = _plan(R.enrich_with_overall_ir(star))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Subquery" in p          # the global IR% is a scalar subquery, computed once


def _ancestors_until_exchange(plan: str, leaf_marker: str):
    """Operators on the path from each leaf containing ``leaf_marker`` up to
    the first Exchange above it."""
    lines = plan.split("\n")
    depth = lambda ln: len(ln) - len(ln.lstrip(" :|+-"))
    paths = []
    for i, ln in enumerate(lines):
        if leaf_marker not in ln:
            continue
        path, d = [], depth(ln)
        for up in reversed(lines[:i]):
            if depth(up) < d:
                path.append(up.strip(" :|+-"))
                d = depth(up)
                if path[-1].startswith("Exchange"):
                    break
        paths.append(path)
    return paths


@pytest.mark.parametrize("threshold", ["10m", "1000"])
def test_partial_aggregate_before_every_fact_shuffle(spark, sf_small, threshold):
    """Also where Spark's own estimate would broadcast nothing: the measured guard decides."""
    from promoscope.plans import sql_reports as SQL
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        star = build_star(spark, sf_small)
        for fn in (R.category_lift, R.city_performance, R.campaign_promo_analysis, R.promo_isu,
                   R.top10_stores_ir, R.q5_top5_products_ir, SQL.q3_sql, SQL.q5_sql, lambda s: SQL.q4_sql(s, "FY1998")):
            paths = _ancestors_until_exchange(_plan(fn(star)), "lineitem.parquet")
            assert paths, fn
            for path in paths:
                assert path[-1].startswith("Exchange"), (fn, path)
                assert any("partial_" in op for op in path[:-1]), (fn, path)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_reads_only_needed_columns(spark, sf_small):
    star = build_star(spark, sf_small)
    p = _plan(R.promo_isu(star))
    assert ("ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double,"
            "l_returnflag:string,l_linestatus:string>") in p
    # reports that read no price look none up
    for fn in (R.promo_isu, R.overall_isu_pct, R.top10_stores_isu, R.bottom10_stores_isu):
        assert "part.parquet" not in _plan(fn(star)), fn
    for fn in (R.category_before_after, R.product_before_after):
        assert "p_retailprice" not in _plan(fn(star)), fn


def test_broadcast_only_under_the_measured_bound(spark):
    from pyspark.sql import functions as F
    from promoscope.operators.star import sized_broadcast
    dim = spark.range(50).withColumnRenamed("id", "k")
    fact = spark.range(1000).select((F.col("id") % 50).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        small = fact.join(sized_broadcast(dim, max_bytes=10_000), "k")
        big = fact.join(sized_broadcast(dim, max_bytes=100), "k")
        assert "BroadcastHashJoin" in _plan(small)
        assert "BroadcastHashJoin" not in _plan(big) and "SortMergeJoin" in _plan(big)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
