"""The report library (Q1-Q5, R1-R27, C1-C3) as DataFrame plans over a RetailStar.

Conventions (SURVEY §1.3):

* Q reports follow the SQL text: inner joins, revenue of a NULL/unknown promo is
  NULL (skipped by SUM), units keep the raw quantity.
* R reports follow the R script: null-safe left joins, revenue of a NULL/unknown
  promo is 0, units of a NULL promo are NULL, grouped sums skip NULL and give 0
  for an all-NULL group, means skip NULL.

Plan shape. Reports that group by a dimension attribute first aggregate the
fact by the dimension key (partial + final hash aggregate, all algebraic), join
that small result to the dimension, and aggregate again by the attribute. The
join then sees one row per key instead of one per event, and a dimension key
present twice still multiplies the totals exactly as a row-level join would.
Reports that need no dimension attribute never join one.

Money stays DECIMAL through every sum; ratios and means are one double
division of exact totals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.functions import kpi
from promoscope.functions.labels import millions_label, thousands_label
from promoscope.operators import ranking, reshape, stats
from promoscope.operators.star import (
    attach_scalar, dim_is_small, dim_size, enrich, inner_join, left_join_null_safe, star_dim,
)
from promoscope.sources.star import RetailStar

QB, QA = kpi.QTY_BEFORE, kpi.QTY_AFTER

# ---------------------------------------------------------------------------
# row-level KPI columns on the bare fact


def fact_kpis(star: RetailStar, convention: str = "r", fact: DataFrame | None = None) -> DataFrame:
    """The bare fact with the aggregation form of the KPIs (money in 1/10000
    units, see ``functions.kpi``)."""
    if fact is not None:
        return kpi.with_kpi_units(fact, convention=convention)
    key = ("fact_kpis", convention)
    if key not in star.memo:
        star.memo[key] = kpi.with_kpi_units(star.fact_events, convention=convention)
    return star.memo[key]


def unit_kpis(star: RetailStar, convention: str = "r") -> DataFrame:
    """The unit columns of ``fact_kpis`` alone, over the fact without its price lookup."""
    return kpi.with_unit_kpis(star.unit_events, convention=convention)


def _sum_e4(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(38,0)"))


# partial aggregates: every report below is a combination of these
_PARTIALS = {
    "_n": lambda: F.count(F.lit(1)),
    "_ir_sum": lambda: _sum_e4("incremental_revenue_e4"),
    "_ir_cnt": lambda: F.count("incremental_revenue_e4"),
    "_isu_sum": lambda: F.sum("incremental_sold_units"),
    "_isu_cnt": lambda: F.count("incremental_sold_units"),
    "_qb": lambda: F.sum(QB),
    "_qa": lambda: F.sum(QA),
    "_rb": lambda: _sum_e4("revenue_before_e4"),
    "_ra": lambda: _sum_e4("revenue_after_e4"),
}


def _partials(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[_PARTIALS[n]().alias(n) for n in names])


def _reroll(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _by_attribute(star: RetailStar, fact: DataFrame, dim: str, key: str, fact_keys: list[str],
                  attrs: list[str], names: list[str], how: str) -> DataFrame:
    """Aggregate the fact by (key, fact_keys), join the dimension, aggregate by
    (attrs, fact_keys)."""
    part = _partials(fact, [key] + fact_keys, names)
    d = star_dim(star, dim).select(key, *[a for a in attrs if a != key])
    j = left_join_null_safe(part, d, key) if how == "left" else inner_join(part, d, key)
    return _reroll(j, attrs + fact_keys, names)


def _money(c) -> Column:
    """Summed 1/10000 units as an exact DECIMAL(38,4) amount."""
    return kpi.e4_to_money(F.col(c) if isinstance(c, str) else c)


def _money0(c: str) -> Column:
    """R ``sum(x, na.rm=TRUE)`` of money: 0 for an all-NULL group."""
    return _money(F.coalesce(F.col(c), F.lit(0)))


def pct2(num: Column, den: Column) -> Column:
    """``num * 100 / den`` rounded to two decimals, half away from zero, from exact integers (NULL for a zero or
    NULL ``den``): ties do not depend on how a double or a decimal quotient was rounded before."""
    n, d = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    twice = F.abs(d) * F.lit(Decimal(2))
    cents = F.call_function("div", F.abs(n) * F.lit(Decimal(20000)) + F.abs(d), F.nullif(twice, F.lit(Decimal(0))))
    return cents.cast("double") * F.signum(n.cast("double")) * F.signum(d.cast("double")) / F.lit(100.0)


def _pct_of(num: Column, den: Column) -> Column:
    """``(num * 100) / den`` in double (R5, which is not rounded)."""
    return F.try_divide((num * 100).cast("double"), den.cast("double"))


# ---------------------------------------------------------------------------
# Q1-Q5: the SQL reports


def q1_high_value_bogof(star: RetailStar, min_price: int = 500, promo: str = "BOGOF") -> DataFrame:
    f = star.fact_events.where(star.text_is("promo_type", promo) & (F.col("base_price") > F.lit(min_price)))
    pairs = f.select("product_code", "base_price").distinct()
    j = inner_join(pairs, star.dim_products.select("product_code", "product_name"), "product_code")
    return j.select("product_name", "base_price").distinct()


def q2_stores_by_city(star: RetailStar) -> DataFrame:
    return (star.dim_stores.groupBy("city").agg(F.count("store_id").alias("no_of_stores"))
            .orderBy(F.desc("no_of_stores"), F.asc("city")))


def q3_campaign_revenue(star: RetailStar) -> DataFrame:
    f = fact_kpis(star, "sql")
    t = _by_attribute(star, f, "dim_campaigns", "campaign_id", [], ["campaign_name"],
                      ["_rb", "_ra"], "inner")
    return t.select("campaign_name",
                    millions_label(_money("_rb")).alias("total_revenue_before_promotion"),
                    millions_label(_money("_ra")).alias("total_revenue_after_promotion"))


def q4_campaign_isu_rank(star: RetailStar, campaign_name: str) -> DataFrame:
    camp = star.dim_campaigns.where(star.text_is("campaign_name", campaign_name)).select("campaign_id")
    if dim_is_small(star, "dim_campaigns"):
        camp = F.broadcast(camp)
    f = inner_join(unit_kpis(star, "sql"), camp, "campaign_id")
    t = _by_attribute(star, f, "dim_products", "product_code", [], ["category"],
                      ["_isu_sum", "_qb"], "inner")
    t = t.select("category", pct2(F.col("_isu_sum"), F.col("_qb")).alias("ISU_Percent"))
    return ranking.global_rank(t, ["ISU_Percent"], "rank_order", method="rank", descending=True,
                               at_most=dim_size(star, "dim_products")[0])       # no more categories than products


def q5_top5_products_ir(star: RetailStar, k: int = 5) -> DataFrame:
    f = fact_kpis(star, "sql")
    t = _by_attribute(star, f, "dim_products", "product_code", [], ["product_name", "category"],
                      ["_rb", "_ra"], "inner")
    ir = pct2(F.col("_ra") - F.col("_rb"), F.col("_rb"))
    t = t.select("product_name", "category", ir.alias("IR_Percent"))
    return ranking.top_k(t, k, F.desc_nulls_last("IR_Percent"), F.asc_nulls_last("product_name"),
                         F.asc_nulls_last("category"))


# ---------------------------------------------------------------------------
# The KPI pipeline


def enriched_fact(star: RetailStar) -> DataFrame:
    return enrich(star)


def kpi_fact(star: RetailStar) -> DataFrame:
    return kpi.with_kpis(enriched_fact(star), convention="r")


def overall_ir_pct(star: RetailStar) -> DataFrame:
    f = fact_kpis(star, "r")
    t = f.agg(_sum_e4("revenue_after_e4").alias("a"), _sum_e4("revenue_before_e4").alias("b"))
    return t.select(pct2(F.col("a") - F.col("b"), F.col("b")).alias("IR_Percentage"))


def enrich_with_overall_ir(star: RetailStar) -> DataFrame:
    return attach_scalar(kpi_fact(star), overall_ir_pct(star))


def overall_isu_pct(star: RetailStar) -> DataFrame:
    """Unrounded; NULL as soon as one unit value is NULL (R ``sum`` without na.rm)."""
    f = unit_kpis(star, "r")
    t = f.agg(F.sum("sold_units_after_promo").alias("a"), F.sum(QB).alias("b"),
              F.count("sold_units_after_promo").alias("na"), F.count(F.lit(1)).alias("n"))
    a = F.when(F.col("na") == F.col("n"), F.col("a"))
    return t.select(_pct_of(a - F.col("b"), F.col("b")).alias("ISU_Percentage"))


# ---------------------------------------------------------------------------
# Store and city reports


def _store_totals(star: RetailStar, names: list[str]) -> DataFrame:
    fact = fact_kpis(star, "r") if "_ir_sum" in names else unit_kpis(star, "r")
    part = _partials(fact, ["store_id"], names)
    j = left_join_null_safe(part, star_dim(star, "dim_stores"), "store_id")
    return j.groupBy("store_id").agg(F.min("city").alias("city"), *[F.sum(n).alias(n) for n in names])


def _stores_ir(star: RetailStar, k: int, desc: bool) -> DataFrame:
    t = _store_totals(star, ["_ir_sum"]).select(
        "store_id", "city", _money0("_ir_sum").alias("total_incremental_revenue"))
    o = F.desc_nulls_last if desc else F.asc_nulls_last
    return ranking.top_k(t, k, o("total_incremental_revenue"), F.asc_nulls_last("store_id"))


def _stores_isu(star: RetailStar, k: int, desc: bool) -> DataFrame:
    t = _store_totals(star, ["_isu_sum"]).select(
        "store_id", "city", F.coalesce(F.col("_isu_sum"), F.lit(0)).alias("total_incremental_sold_units"))
    o = F.desc_nulls_last if desc else F.asc_nulls_last
    return ranking.top_k(t, k, o("total_incremental_sold_units"), F.asc_nulls_last("store_id"))


def top10_stores_ir(star: RetailStar, k: int = 10) -> DataFrame:
    return _stores_ir(star, k, True)


def bottom10_stores_ir(star: RetailStar, k: int = 10) -> DataFrame:
    return _stores_ir(star, k, False)


def bottom10_stores_isu(star: RetailStar, k: int = 10) -> DataFrame:
    return _stores_isu(star, k, False)


def top10_stores_isu(star: RetailStar, k: int = 10) -> DataFrame:
    return _stores_isu(star, k, True)


def city_performance(star: RetailStar) -> DataFrame:
    part = _partials(fact_kpis(star, "r"), ["store_id"], ["_ir_sum", "_ir_cnt"])
    j = left_join_null_safe(part, star_dim(star, "dim_stores"), "store_id")
    t = j.groupBy("city").agg(F.sum("_ir_sum").alias("s"), F.sum("_ir_cnt").alias("c"),
                              stats.n_distinct_with_null("store_id").alias("store_count"))
    return t.select("city", _money0("s").alias("total_incremental_revenue"),
                    stats.mean_of(_money("s"), F.col("c")).alias("avg_incremental_revenue"),
                    "store_count").orderBy(F.desc_nulls_last("total_incremental_revenue"),
                                           F.asc_nulls_last("city"))


# ---------------------------------------------------------------------------
# Store x promo, promo reports and statistics


def top_stores_by_promo(star: RetailStar, n: int = 10) -> DataFrame:
    """Per (store, city) the first ``n`` promos by IR (the R tibble is still
    grouped by store and city when it is sliced)."""
    part = _partials(fact_kpis(star, "r"), ["store_id", "promo_type"], ["_ir_sum"])
    j = left_join_null_safe(part, star_dim(star, "dim_stores"), "store_id")
    t = j.groupBy("store_id", "city", "promo_type").agg(F.sum("_ir_sum").alias("s")).select(
        "store_id", "city", "promo_type", _money0("s").alias("total_incremental_revenue"))
    return ranking.top_n_per_group(
        t, ["store_id", "city"],
        [F.desc_nulls_last("total_incremental_revenue"), F.asc_nulls_last("promo_type")], n)


def top_stores_summary(star: RetailStar, n: int = 10) -> DataFrame:
    t = top_stores_by_promo(star, n)
    return (t.groupBy("city", "promo_type").agg(
        stats.mean_of(F.sum("total_incremental_revenue"), F.count("total_incremental_revenue"))
        .alias("avg_incremental_revenue"),
        F.count(F.lit(1)).alias("count_of_top_stores"))
        .orderBy(F.desc_nulls_last("avg_incremental_revenue"), "city", "promo_type"))


def promo_ir(star: RetailStar) -> DataFrame:
    t = _partials(fact_kpis(star, "r"), ["promo_type"], ["_ir_sum"])
    return t.select("promo_type", _money0("_ir_sum").alias("total_incremental_revenue")).orderBy(
        F.desc_nulls_last("total_incremental_revenue"))


def promo_isu(star: RetailStar) -> DataFrame:
    t = _partials(unit_kpis(star, "r"), ["promo_type"], ["_isu_sum"])
    return t.select("promo_type", F.coalesce(F.col("_isu_sum"), F.lit(0)).alias(
        "total_incremental_sold_units")).orderBy(F.desc_nulls_last("total_incremental_sold_units"))


def _promo_stats(star: RetailStar, value: str, suffix: str, exact: bool = True,
                 money: bool = False) -> DataFrame:
    """Mean, sample sd and row count by promo in one partially aggregated pass
    (``stddev_samp`` merges partial moments without cancellation), and the
    median from the value counts (a table written while the plan is built). The
    join between them has a row per promo on either side."""
    f = fact_kpis(star, "r") if money else unit_kpis(star, "r")
    to_double = kpi.e4_to_double if money else (lambda c: c.cast("double"))
    total = _sum_e4(value) if money else F.sum(value)
    mom = f.groupBy("promo_type").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_cnt"), total.alias("_sum"),
        F.stddev_samp(to_double(F.col(value))).alias("_sd"))
    if exact:
        med = stats.exact_percentiles(f, ["promo_type"], value, {f"median_{suffix}": 0.5}, to_double=to_double)
    else:
        med = stats.approx_percentiles(f.withColumn(value, to_double(F.col(value))), ["promo_type"],
                                       value, {f"median_{suffix}": 0.5})
    med = med.withColumnRenamed("promo_type", "_p")
    j = mom.join(med, F.col("promo_type").eqNullSafe(F.col("_p")), "left")
    s_amount = _money("_sum") if money else F.col("_sum")
    return j.select("promo_type", stats.mean_of(s_amount, F.col("_cnt")).alias(f"avg_{suffix}"),
                    f"median_{suffix}", F.col("_sd").alias(f"sd_{suffix}"),
                    F.col("_rows").alias("store_count")).orderBy(F.desc_nulls_last(f"avg_{suffix}"))


def promo_ir_stats(star: RetailStar, exact: bool = True) -> DataFrame:
    return _promo_stats(star, "incremental_revenue_e4", "incremental_revenue", exact, money=True)


def promo_isu_stats(star: RetailStar, exact: bool = True) -> DataFrame:
    return _promo_stats(star, "incremental_sold_units", "incremental_sold_units", exact)


# ---------------------------------------------------------------------------
# Metric evaluation, efficiency, category and product lift


def metric_evaluation(star: RetailStar) -> DataFrame:
    return kpi.with_metric_evaluation(kpi_fact(star))


def promo_efficiency(star: RetailStar) -> DataFrame:
    f = fact_kpis(star, "r")
    t = f.groupBy("promo_type").agg(
        F.sum("incremental_sold_units").alias("su"), F.count("incremental_sold_units").alias("cu"),
        _sum_e4("incremental_revenue_e4").alias("sr"), F.count("incremental_revenue_e4").alias("cr"),
        F.avg("margin_per_unit").alias("avg_margin_per_unit"))
    return t.select("promo_type", stats.mean_of(F.col("su"), F.col("cu")).alias("avg_incremental_sold_units"),
                    stats.mean_of(_money("sr"), F.col("cr")).alias("avg_incremental_revenue"),
                    "avg_margin_per_unit").orderBy(F.desc_nulls_last("avg_incremental_sold_units"))


_LIFT = ["_isu_sum", "_isu_cnt", "_ir_sum"]


def _lift_columns() -> list[Column]:
    return [F.coalesce(F.col("_isu_sum"), F.lit(0)).alias("total_incremental_sold_units"),
            _money0("_ir_sum").alias("total_incremental_revenue"),
            stats.mean_of(F.col("_isu_sum"), F.col("_isu_cnt")).alias("avg_lift_per_store")]


def category_lift(star: RetailStar) -> DataFrame:
    t = _by_attribute(star, fact_kpis(star, "r"), "dim_products", "product_code", [], ["category"],
                      _LIFT, "left")
    return t.select("category", *_lift_columns()).orderBy(F.desc_nulls_last("total_incremental_sold_units"))


def product_lift(star: RetailStar) -> DataFrame:
    t = _by_attribute(star, fact_kpis(star, "r"), "dim_products", "product_code", [],
                      ["product_code", "product_name"], _LIFT, "left")
    return t.select("product_code", "product_name", *_lift_columns()).orderBy(
        F.desc_nulls_last("total_incremental_sold_units"), "product_code")


def _products_k(star: RetailStar, k: int, desc: bool) -> DataFrame:
    t = product_lift(star).withColumn(
        "total_incremental_sold_units", F.col("total_incremental_sold_units").cast("double"))
    o = F.desc_nulls_last if desc else F.asc_nulls_last
    return ranking.top_k(t, k, o("total_incremental_sold_units"), F.asc_nulls_last("product_code"))


def top10_products(star: RetailStar, k: int = 10) -> DataFrame:
    return _products_k(star, k, True)


def bottom10_products(star: RetailStar, k: int = 10) -> DataFrame:
    return _products_k(star, k, False)


def category_promo_effectiveness(star: RetailStar) -> DataFrame:
    t = _by_attribute(star, fact_kpis(star, "r"), "dim_products", "product_code", ["promo_type"],
                      ["category"], ["_isu_sum", "_isu_cnt", "_ir_sum", "_ir_cnt"], "left")
    return t.select("category", "promo_type",
                    stats.mean_of(F.col("_isu_sum"), F.col("_isu_cnt")).alias("avg_incremental_units"),
                    stats.mean_of(_money("_ir_sum"), F.col("_ir_cnt")).alias("avg_incremental_revenue")
                    ).orderBy(F.desc_nulls_last("avg_incremental_units"))


# ---------------------------------------------------------------------------
# before/after reshapes and formatted summaries


def _before_after(star: RetailStar, attr: str) -> DataFrame:
    t = _by_attribute(star, star.unit_events, "dim_products", "product_code", [], [attr],
                      ["_qb", "_qa"], "left")
    t = t.select(attr, F.coalesce(F.col("_qb"), F.lit(0)).alias("total_before"),
                 F.coalesce(F.col("_qa"), F.lit(0)).alias("total_after"))
    return reshape.longer(t, [attr], ["total_before", "total_after"], "sale_type", "total_units")


def category_before_after(star: RetailStar) -> DataFrame:
    return _before_after(star, "category")


def product_before_after(star: RetailStar) -> DataFrame:
    return _before_after(star, "product_name")


def category_product_summary(star: RetailStar) -> DataFrame:
    t = _by_attribute(star, fact_kpis(star, "r"), "dim_products", "product_code", [],
                      ["category", "product_name"], ["_qb", "_qa", "_rb", "_ra", "_ir_sum", "_isu_sum"],
                      "left")
    return t.select(
        "category", "product_name",
        F.coalesce(F.col("_qb"), F.lit(0)).alias("Quantity_before_Promo"),
        thousands_label(_money0("_rb")).alias("Revenue_before_Promo"),
        F.coalesce(F.col("_qa"), F.lit(0)).alias("Quantity_after_promo"),
        thousands_label(_money0("_ra")).alias("Revenue_after_promo"),
        thousands_label(_money0("_ir_sum")).alias("Incremental_revenue"),
        F.coalesce(F.col("_isu_sum"), F.lit(0)).alias("Incremental_sold_units"))


def campaign_promo_analysis(star: RetailStar) -> DataFrame:
    t = _by_attribute(star, fact_kpis(star, "r"), "dim_campaigns", "campaign_id", ["promo_type"],
                      ["campaign_name"], ["_qb", "_qa", "_ir_sum", "_isu_sum"], "left")
    return t.select(
        "campaign_name", "promo_type",
        F.coalesce(F.col("_qb"), F.lit(0)).alias("Quantity_before_promo"),
        F.coalesce(F.col("_qa"), F.lit(0)).alias("Quantity_after_promo"),
        _money0("_ir_sum").alias("Incremental_Revenue"),
        F.coalesce(F.col("_isu_sum"), F.lit(0)).alias("Incremental_Sold_Units")).orderBy(
        F.asc_nulls_last("campaign_name"), F.desc_nulls_last("Quantity_before_promo"))


# ---------------------------------------------------------------------------
# Chart data


def product_axis_order(star: RetailStar) -> DataFrame:
    """C1 on R25: each product's axis slot by the mean of its two unit totals."""
    return ranking.axis_order(product_before_after(star), "product_name", "total_units")


#: The other plots' axes: report, label, value.
AXES = {
    "top_stores_axis_order": (top10_stores_ir, "store_id", "total_incremental_revenue"),
    "bottom_stores_axis_order": (bottom10_stores_isu, "store_id", "total_incremental_sold_units"),
    "city_axis_order": (city_performance, "city", "total_incremental_revenue"),
    "promo_ir_axis_order": (promo_ir, "promo_type", "total_incremental_revenue"),
    "promo_isu_axis_order": (promo_isu, "promo_type", "total_incremental_sold_units"),
    "category_axis_order": (category_lift, "category", "total_incremental_sold_units"),
    "top_products_axis_order": (top10_products, "product_name", "total_incremental_sold_units"),
    "bottom_products_axis_order": (bottom10_products, "product_name", "total_incremental_sold_units"),
}


def axis_order(star: RetailStar, name: str) -> DataFrame:
    """C1 on one of ``AXES``: the report's rows with each label's slot."""
    report, label, value = AXES[name]
    return ranking.axis_order(report(star), label, value)


def ir_boxplot_by_promo(star: RetailStar) -> DataFrame:
    return stats.boxplot_stats(fact_kpis(star, "r"), ["promo_type"], "incremental_revenue_e4",
                               to_double=kpi.e4_to_double)


def promo_tradeoff_points(star: RetailStar) -> DataFrame:
    return promo_efficiency(star).select(
        F.col("promo_type").alias("label"), F.col("avg_incremental_sold_units").alias("x"),
        F.col("avg_margin_per_unit").alias("y"))
