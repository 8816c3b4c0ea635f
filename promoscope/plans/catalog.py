"""Registry of every report/operator key: ``(spark, sf_dir) -> DataFrame``.

Each entry builds the retail star from the driver's tables (``testdata_star``)
and runs one report. ``present`` fixes the output types shared with the oracle:
DECIMAL -> DOUBLE (after exact sums), DATE -> ISO text, and the listed
floating statistics rounded to 4 decimals (engines differ in their last bits).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope import schemas
from promoscope.operators import quality
from promoscope.operators.collation import normalised
from promoscope.operators.star import left_join_null_safe, star_dim
from promoscope.plans import reports as R
from promoscope.plans import sql_reports as SQL
from promoscope.session import checkpoint_dir, session_key
from promoscope.sources.retail import (
    read_csv_typed, read_insert_tuples, write_csv_star, write_insert_tuples,
)
from promoscope.sources.star import RetailStar
from promoscope.sources.testdata_star import testdata_star


_STARS: dict[tuple[str, str], RetailStar] = {}
PERSIST_CONF = "promoscope.persistFact"


def star_for(spark: SparkSession, sf_dir: str) -> RetailStar:
    """The adapted star for ``sf_dir``, built once per Spark application.

    Only lazy plans are kept (the resolved Parquet relations and the adapter's
    projections), the way a long-lived application holds its table
    DataFrames; no data is cached unless ``promoscope.persistFact`` is true."""
    persist = spark.conf.get(PERSIST_CONF, "false").lower() == "true"
    key = (session_key(spark), sf_dir.rstrip("/"), persist)
    star = _STARS.get(key)
    if star is None:
        star = testdata_star(spark, sf_dir)
        if persist:
            star = star.persisted()
        _STARS[key] = star
    return star


def present(df: DataFrame, round4: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.StringType)):
            c = c.cast("string")            # text leaves without its collation
        if f.name in round4:
            c = F.round(c, 4)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/promoscope-{what}-{uuid.uuid4().hex}"


# --- S5: tuple text round trip over ``part`` --------------------------------

def ingest_insert_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    path = scratch_path(spark, "tuples")
    write_insert_tuples(part, path, "part")
    return read_insert_tuples(spark, path, part.schema, table="part")


def hard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with every text that loaders stumble over: quotes, separators, escapes, line breaks, NULL and NA."""
    odd = F.element_at(F.array(*[F.lit(x) for x in HARD_TEXTS]), (F.col("p_partkey") % len(HARD_TEXTS) + 1).cast("int"))
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    return part.select("p_partkey", F.concat(F.col("p_name"), odd).alias("p_name"),
                       F.when(F.col("p_partkey") % 5 > 0, F.concat(odd, F.col("p_brand"))).alias("p_brand"),
                       F.when(F.col("p_partkey") % 7 > 0, F.col("p_size")).alias("p_size"))


HARD_TEXTS = ("'", "\\", "),(", ";\n", "\t'\\'", "''", ", NULL", "\n", ");", '"', "NA", " é")


def ingest_hard_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 over ``hard_text``: written as INSERT statements and read back."""
    df, path = hard_text(spark, sf_dir), scratch_path(spark, "hard-tuples")
    write_insert_tuples(df, path, "part")
    return read_insert_tuples(spark, path, df.schema, table="part")


def csv_scan_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over ``hard_text``: quotes doubled, line breaks kept; the readers' rules trim texts."""
    df, path = hard_text(spark, sf_dir), scratch_path(spark, "hard-csv")
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "NA").csv(path)
    return read_csv_typed(spark, path, df.schema)


# --- S1/S2/S7: CSV round trip of the star (raw headers, day-first dates) ------

def csv_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = star_for(spark, sf_dir)
    root = scratch_path(spark, "csv")
    write_csv_star(star, root, tables=("fact_events", "dim_campaigns"))
    fact = read_csv_typed(spark, f"{root}/fact_events", schemas.FACT_EVENTS)
    camps = read_csv_typed(spark, f"{root}/dim_campaigns", schemas.DIM_CAMPAIGNS)
    return left_join_null_safe(fact, camps, "campaign_id")


def null_safe_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = star_for(spark, sf_dir)
    return left_join_null_safe(star.fact_events.select("event_id", "store_id"),
                               star_dim(star, "dim_stores"), "store_id")


# What the two parametrised reports are asked on the test data: its prices run from 900 to 999.90.
MIN_PRICE, CAMPAIGN = 950, "FY1998"

# name -> (report over a star, columns rounded to 4)
_STAR_REPORTS: dict[str, tuple[Callable[[RetailStar], DataFrame], tuple[str, ...]]] = {
    "q1_high_value_bogof": (lambda star: R.q1_high_value_bogof(star, min_price=MIN_PRICE), ()),
    "q2_stores_by_city": (R.q2_stores_by_city, ()),
    "q3_campaign_revenue": (R.q3_campaign_revenue, ()),
    "q4_campaign_isu_rank": (lambda star: R.q4_campaign_isu_rank(star, CAMPAIGN), ()),
    "q5_top5_products_ir": (R.q5_top5_products_ir, ()),
    "enriched_fact": (R.enriched_fact, ()),
    "kpi_fact": (R.kpi_fact, ()),
    "overall_ir_pct": (R.overall_ir_pct, ()),
    "enrich_with_overall_ir": (R.enrich_with_overall_ir, ()),
    "overall_isu_pct": (R.overall_isu_pct, ()),
    "top10_stores_ir": (R.top10_stores_ir, ()),
    "bottom10_stores_ir": (R.bottom10_stores_ir, ()),
    "bottom10_stores_isu": (R.bottom10_stores_isu, ()),
    "top10_stores_isu": (R.top10_stores_isu, ()),
    "city_performance": (R.city_performance, ()),
    "top_stores_by_promo": (R.top_stores_by_promo, ()),
    "top_stores_summary": (R.top_stores_summary, ()),
    "promo_ir": (R.promo_ir, ()),
    "promo_isu": (R.promo_isu, ()),
    "promo_ir_stats": (R.promo_ir_stats, ("median_incremental_revenue", "sd_incremental_revenue")),
    "promo_isu_stats": (R.promo_isu_stats, ("median_incremental_sold_units", "sd_incremental_sold_units")),
    "metric_evaluation": (R.metric_evaluation, ()),
    "promo_efficiency": (R.promo_efficiency, ("avg_margin_per_unit",)),
    "category_lift": (R.category_lift, ()),
    "product_lift": (R.product_lift, ()),
    "top10_products": (R.top10_products, ()),
    "bottom10_products": (R.bottom10_products, ()),
    "category_promo_effectiveness": (R.category_promo_effectiveness, ()),
    "category_before_after": (R.category_before_after, ()),
    "product_before_after": (R.product_before_after, ()),
    "category_product_summary": (R.category_product_summary, ()),
    "campaign_promo_analysis": (R.campaign_promo_analysis, ()),
    "product_axis_order": (R.product_axis_order, ()),
    "ir_boxplot_by_promo": (R.ir_boxplot_by_promo, ("q1", "median", "q3", "lower_whisker", "upper_whisker")),
    "promo_tradeoff_points": (R.promo_tradeoff_points, ("y",)),
    "quality_checks": (quality.quality_checks, ()),
    # entry point A: the same five reports as Spark SQL text
    "q1_high_value_bogof_sql": (lambda star: SQL.q1_sql(star, min_price=MIN_PRICE), ()),
    "q2_stores_by_city_sql": (SQL.q2_sql, ()),
    "q3_campaign_revenue_sql": (SQL.q3_sql, ()),
    "q4_campaign_isu_rank_sql": (lambda star: SQL.q4_sql(star, CAMPAIGN), ()),
    "q5_top5_products_ir_sql": (SQL.q5_sql, ()),
}


# the five SQL reports over promos in mixed case, under the source database's collation
_COLLATED = {
    "q1_high_value_bogof_collated": lambda star: R.q1_high_value_bogof(star, min_price=MIN_PRICE),
    "q2_stores_by_city_collated": R.q2_stores_by_city,
    "q3_campaign_revenue_collated": R.q3_campaign_revenue,
    "q4_campaign_isu_rank_collated": lambda star: R.q4_campaign_isu_rank(star, CAMPAIGN.lower()),
    "q5_top5_products_ir_collated": R.q5_top5_products_ir,
}


def _mixed_case(star: RetailStar) -> RetailStar:
    """Every other event's promo in lower case: other texts under binary comparison, the same under the collation."""
    def mix(df: DataFrame) -> DataFrame:
        odd = F.col("quantity_sold_before_promo") % 2 == 1
        return df.withColumn("promo_type", F.when(odd, F.lower("promo_type")).otherwise(F.col("promo_type")))
    return RetailStar(mix(star.fact_events), star.dim_campaigns, star.dim_products, star.dim_stores, unpriced=mix(star.unit_events))


def _collated_star(spark: SparkSession, sf_dir: str) -> RetailStar:
    """The mixed-case star normalised by the collation, kept like the star itself: its exceptions are found once."""
    star = star_for(spark, sf_dir)
    if "collated" not in star.memo:
        star.memo["collated"] = normalised(_mixed_case(star))
    return star.memo["collated"]


def _collated_query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(_collated_star(spark, sf_dir)))
    return run


def _star_query(fn, round4):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(star_for(spark, sf_dir)), round4)
    run.__name__ = getattr(fn, "__name__", "report")
    return run


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _star_query(fn, r4) for name, (fn, r4) in _STAR_REPORTS.items()}
    out["ingest_insert_tuples"] = lambda spark, d: present(ingest_insert_tuples(spark, d))
    out |= {name: _collated_query(fn) for name, fn in _COLLATED.items()}
    out |= {name: _star_query(lambda star, n=name: R.axis_order(star, n), ()) for name in R.AXES}
    out["ingest_hard_tuples"] = ingest_hard_tuples
    out["csv_scan_hard"] = csv_scan_hard
    out["csv_scan_typed"] = lambda spark, d: present(csv_scan_typed(spark, d))
    out["null_safe_left_join"] = lambda spark, d: present(null_safe_left_join(spark, d))
    return out
