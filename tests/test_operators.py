"""Distributed operators against brute force (numpy/pandas) on skewed data."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from promoscope.operators import ranking, stats
from promoscope.plans import reports as R
from tests.conftest import make_star


def _skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", None], n))
    v = rng.integers(-50, 50, n).astype("int64")
    v[rng.random(n) < 0.05] = 0
    return pd.DataFrame({"g": g, "v": v})


def test_exact_percentiles_match_numpy_on_skewed_groups(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf, "g string, v bigint")
    got = {r.g: r for r in stats.exact_percentiles(df, ["g"], "v", {"q1": .25, "med": .5, "q9": .9},
                                                   num_ranges=7).collect()}
    for key, sub in pdf.groupby(pdf.g.fillna("<null>")):
        k = None if key == "<null>" else key
        vals = np.sort(sub.v.values.astype(float))
        for name, p in (("q1", .25), ("med", .5), ("q9", .9)):
            assert abs(getattr(got[k], name) - np.quantile(vals, p)) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-5, 5)), min_size=1, max_size=40),
       st.integers(1, 5))
def test_exact_percentiles_property(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: r.m for r in stats.exact_percentiles(df, ["g"], "v", {"m": 0.5}, num_ranges=parts).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for k, sub in pdf.groupby("g"):
        assert abs(got[k] - float(np.median(sub.v))) < 1e-9


def test_rank_and_percentiles_without_exchange_reuse(spark):
    """The branches share a written range split, so nothing depends on the optimiser reusing a shuffle."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from promoscope.operators.ranking import global_rank
    df = spark.range(6000).select((F.col("id") * 7919 % 500).alias("v"), F.col("id").alias("u"), (F.col("id") % 3).cast("string").alias("g"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = global_rank(df, ["v", "u"], "rn", method="row_number", num_ranges=8)
        want = df.withColumn("w", F.row_number().over(Window.orderBy("v", "u"))).select("u", "w")
        assert got.join(want, "u").filter("rn <> w").count() == 0 and got.count() == 6000
        rank = global_rank(df, ["v"], "r", num_ranges=8)
        want = df.withColumn("w", F.rank().over(Window.orderBy("v"))).select("u", "w")
        assert rank.join(want, "u").filter("r <> w").count() == 0
        med = stats.exact_percentiles(df, ["g"], "v", {"m": 0.5}, num_ranges=8)
        true = df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("t"))
        assert med.join(true, "g").filter("m <> t").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_grown_dimension_is_measured_again(spark):
    from promoscope.operators.star import dim_is_small, measured_bytes
    from promoscope.sources.star import RetailStar
    small, large = spark.range(10).selectExpr("cast(id as string) store_id"), spark.range(5000).selectExpr("cast(id as string) store_id")
    star = RetailStar(small, small, small, small)
    grown = RetailStar(small, small, small, large, memo=star.memo)
    assert dim_is_small(star, "dim_stores", 10_000) and not dim_is_small(grown, "dim_stores", 10_000)
    plan = large.agg({"*": "count"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and measured_bytes(large) > measured_bytes(small) > 0



def test_global_rank_and_row_number(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(500), "v": rng.integers(0, 20, 500)})
    df = spark.createDataFrame(pdf, "k bigint, v bigint")
    expect = pdf.v.rank(method="min", ascending=False).astype(int)
    for n in (6, None):                    # explicit ranges, and AQE-sized (coalesced) ranges
        rk = ranking.global_rank(df, ["v"], "r", "rank", descending=True, num_ranges=n)
        rk = rk.toPandas().set_index("k").r
        assert (rk.sort_index().values == expect.values).all()
    rn = ranking.global_rank(df, ["v", "k"], "r", "row_number", num_ranges=6)
    rn = rn.toPandas().sort_values("r")
    assert list(rn.r) == list(range(1, 501))
    assert list(rn.k) == list(pdf.sort_values(["v", "k"]).k)


def test_boxplot_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([("p", v) for v in vals], "g string, v bigint")
    r = stats.boxplot_stats(df, ["g"], "v").first()
    q1, q3 = np.quantile(vals, .25), np.quantile(vals, .75)
    assert (r.q1, r.q3) == (q1, q3)
    assert r.upper_whisker == 9 and r.lower_whisker == 1 and r.outliers == 1 and r.n == 10


def test_rank_with_a_hot_tie_and_nulls(spark):
    # a third of the rows share one value: ties must get one rank and still be spread
    vals = [7] * 300 + list(range(600)) + [None] * 5
    pdf = pd.DataFrame({"k": range(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k bigint, v bigint")
    got = ranking.global_rank(df, ["v"], "r", "rank", descending=True, num_ranges=5).toPandas()
    exp = pdf.v.rank(method="min", ascending=False, na_option="bottom").astype(int)
    assert (got.set_index("k").r.sort_index().values == exp.values).all()


@pytest.mark.parametrize("method", ["rank", "row_number"])
def test_both_forms_of_the_global_rank_agree(spark, method):
    """One task up to the bound, ranges beyond; the bound may be given or counted."""
    from promoscope.operators.ranking import global_rank
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1.5, 2.5, float(rng.randint(0, 30))])) for i in range(400)] + [(1000 + i, 9.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    cols = ["v"] if method == "rank" else ["v", "id"]
    rank = lambda **how: sorted(map(tuple, global_rank(df, cols, "r", method, descending=True, **how).collect()), key=str)
    forms = [rank(), rank(at_most=600), rank(at_most=600, one_task_rows=599), rank(one_task_rows=10), rank(one_task_rows=0)]
    assert all(f == forms[0] for f in forms) and len(forms[0]) == 600
    plans = [global_rank(df, cols, "r", method, at_most=600, one_task_rows=n)._jdf.queryExecution().executedPlan().toString() for n in (600, 599)]
    assert "rangepartitioning" not in plans[0] and "SinglePartition" in plans[0]
    assert "Window [row_number() windowspecdefinition(v" not in plans[1]


def test_sql_rank_beyond_its_bound(spark):
    """The SQL form of Q4 gives its ranks to the range scheme when the categories may be many."""
    from promoscope.plans.sql_reports import q4_sql
    star = make_star(spark, [(f"e{i}", "S1", "C1", f"P{i % 3 + 1}", 10, "BOGOF", 5 + i, 7) for i in range(9)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(q4_sql(star, "Tulip Week")) == rows(q4_sql(star, "Tulip Week", one_task_rows=2)) == rows(R.q4_campaign_isu_rank(star, "Tulip Week"))


def _ordered(rows, *keys):
    """Rows stand in the order of the keys; ``-`` before a name: descending, NULL last either way."""
    def place(r):
        out = []
        for k in keys:
            v = r[k.lstrip("-")]
            out += [v is None, 0 if v is None else -v if k.startswith("-") else v]
        return out
    return [place(r) for r in rows] == sorted(place(r) for r in rows)


@pytest.mark.parametrize("report,keys", [
    ("q2_stores_by_city", ("-no_of_stores", "city")), ("q5_top5_products_ir", ("-IR_Percent", "product_name")),
    ("top10_stores_ir", ("-total_incremental_revenue", "store_id")), ("bottom10_stores_ir", ("total_incremental_revenue", "store_id")),
    ("bottom10_stores_isu", ("total_incremental_sold_units", "store_id")), ("top10_stores_isu", ("-total_incremental_sold_units", "store_id")),
    ("campaign_promo_analysis", ("campaign_name", "-Quantity_before_promo"))])
def test_reports_come_in_their_order(spark, sf_small, report, keys):
    from promoscope.plans.catalog import star_for
    rows = getattr(R, report)(star_for(spark, sf_small)).collect()
    assert len(rows) > 1 and _ordered(rows, *keys)
