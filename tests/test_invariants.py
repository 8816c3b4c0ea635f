"""SURVEY §5.2 invariants on the adapted sf0.001 star."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promoscope.functions import kpi
from promoscope.plans import reports as R
from promoscope.plans.catalog import star_for


@pytest.fixture(scope="module")
def star(spark, sf_small):
    return star_for(spark, sf_small)


def test_group_totals_add_up_to_global(star):
    f = R.fact_kpis(star, "r")
    g = f.agg(F.sum("incremental_revenue_e4").alias("ir"), F.sum("incremental_sold_units").alias("isu")).first()
    for rep, col in ((R.promo_ir, "total_incremental_revenue"), (R.category_lift, "total_incremental_revenue"),
                     (R.city_performance, "total_incremental_revenue")):
        s = rep(star).agg(F.sum(col)).first()[0]
        assert s == Decimal(g.ir) / 10000, rep.__name__
    for rep in (R.promo_isu, R.category_lift):
        assert rep(star).agg(F.sum("total_incremental_sold_units")).first()[0] == g.isu


def test_conventions_agree_without_null_promos(star):
    f = star.fact_events.where(F.col("promo_type").isNotNull())
    a = kpi.with_kpi_units(f, "sql").agg(F.sum("revenue_after_e4"), F.sum("incremental_sold_units")).first()
    b = kpi.with_kpi_units(f, "r").agg(F.sum("revenue_after_e4"), F.sum("incremental_sold_units")).first()
    assert tuple(a) == tuple(b)


def test_long_form_keeps_unit_totals(star):
    raw = star.fact_events.agg(F.sum("quantity_sold_before_promo") + F.sum("quantity_sold_after_promo")).first()[0]
    assert R.category_before_after(star).agg(F.sum("total_units")).first()[0] == raw
    assert R.product_before_after(star).agg(F.sum("total_units")).first()[0] == raw


def test_top_and_bottom_cover_small_group_sets(star):
    k = R.category_lift(star).count()          # few categories: top-k u bottom-k covers all
    top = {r.product_code for r in R.top10_products(star, k=k).collect()}
    assert len(top) == k
    cats = {r.category for r in R.category_lift(star).collect()}
    assert len(cats) == k


def test_boxplot_order(star):
    for r in R.ir_boxplot_by_promo(star).collect():
        assert r.lower_whisker <= r.q1 <= r.median <= r.q3 <= r.upper_whisker
        assert r.n > 0 and 0 <= r.outliers <= r.n
