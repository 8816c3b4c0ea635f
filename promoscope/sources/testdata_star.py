"""Adapter: the driver's TPC-H-like tables presented as the retail star.

The mapping is fixed (the oracle SQL in ``plans.oracle`` states the same one):

* store      = supplier (``store_id`` = ``l_suppkey`` as text, ``city`` = nation name)
* product    = part (``product_code`` = ``l_partkey`` as text, ``p_name``, ``p_type``)
* campaign   = calendar year of the ship date (``campaign_id`` = year as text);
  the campaign dimension is the set of order years, ``FY<year>``, 1 Jan - 31 Dec
* base price = part retail price as DECIMAL(12,2)
* promotion  = (return flag, line status): AF BOGOF, AO 500 Cashback, NF 50% OFF,
  NO 33% OFF, RF 25% OFF, RO none (NULL), so the NULL-promo rules always run
* units before = quantity; units after = quantity + 3*discount% - 5*tax%, at least 0
  (percentages as floor(x*100 + 0.5): exact for two-decimal rates, and a
  cheap long operation where round() of a double goes through BigDecimal)

Every fact column but the price is a projection of ``lineitem`` (no shuffle),
and reports that read no price use that projection alone. The price is a lookup
of the product key, broadcast only when the price list measures small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.operators import star as joins
from promoscope.schemas import PRICE
from promoscope.sources.star import RetailStar

# ---------------------------------------------------------------------------
# Fixed values of the adapter: (return flag, line status) -> promotion label.
# ("R", "O") deliberately maps to no promotion (NULL).
FLAG_TO_PROMO = (
    ("A", "F", "BOGOF"),
    ("A", "O", "500 Cashback"),
    ("N", "F", "50% OFF"),
    ("N", "O", "33% OFF"),
    ("R", "F", "25% OFF"),
)
CAMPAIGN_PREFIX = "FY"
# ---------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _promo_from_flags() -> F.Column:
    expr = None
    for flag, status, label in FLAG_TO_PROMO:
        cond = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def unit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact without its price: a projection of ``lineitem``."""
    qty = F.col("l_quantity").cast("bigint")
    after = F.greatest(
        qty + F.lit(3) * F.floor(F.col("l_discount") * 100 + 0.5)
        - F.lit(5) * F.floor(F.col("l_tax") * 100 + 0.5),
        F.lit(0).cast("bigint"))
    return _read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.year("l_shipdate").cast("string").alias("campaign_id"),
        F.col("l_partkey").cast("string").alias("product_code"),
        _promo_from_flags().alias("promo_type"),
        qty.alias("quantity_sold_before_promo"),
        after.alias("quantity_sold_after_promo"))


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with its price, looked up by product behind the broadcast guard; an event of an unknown product
    keeps a NULL price."""
    price = joins.sized_broadcast(_read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("_code"), F.col("p_retailprice").cast(PRICE).alias("base_price")))
    events = unit_events(spark, sf_dir)
    return events.join(price, F.col("product_code") == F.col("_code"), "left").select(
        "event_id", "store_id", "campaign_id", "product_code", "base_price", "promo_type",
        "quantity_sold_before_promo", "quantity_sold_after_promo")


def dim_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = (_read(spark, sf_dir, "orders")
             .select(F.year("o_orderdate").alias("y")).where(F.col("y").isNotNull()).distinct())
    return years.select(
        F.col("y").cast("string").alias("campaign_id"),
        F.concat(F.lit(CAMPAIGN_PREFIX), F.col("y").cast("string")).alias("campaign_name"),
        F.make_date(F.col("y"), F.lit(1), F.lit(1)).alias("start_date"),
        F.make_date(F.col("y"), F.lit(12), F.lit(31)).alias("end_date"))


def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"))


def dim_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
             .select(F.col("s_suppkey").cast("string").alias("store_id"),
                     F.col("n_name").alias("city")))


def testdata_star(spark: SparkSession, sf_dir: str) -> RetailStar:
    return RetailStar(
        fact_events=fact_events(spark, sf_dir),
        dim_campaigns=dim_campaigns(spark, sf_dir),
        dim_products=dim_products(spark, sf_dir),
        dim_stores=dim_stores(spark, sf_dir),
        unpriced=unit_events(spark, sf_dir),
    )
