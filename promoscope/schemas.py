"""Declared schemas of the retail star (S4). Spark does not enforce the
primary keys or NOT NULL flags on files; ``operators.quality`` checks them."""

from pyspark.sql import types as T

MONEY = T.DecimalType(24, 4)      # per-row revenue, exact
PRICE = T.DecimalType(12, 2)

# Source spelling of the two quantity columns and the name used everywhere else.
RAW_QTY_RENAMES = {
    "quantity_sold(before_promo)": "quantity_sold_before_promo",
    "quantity_sold(after_promo)": "quantity_sold_after_promo",
}

FACT_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("store_id", T.StringType(), False),
    T.StructField("campaign_id", T.StringType(), False),
    T.StructField("product_code", T.StringType(), False),
    T.StructField("base_price", PRICE, False),
    T.StructField("promo_type", T.StringType(), True),
    T.StructField("quantity_sold_before_promo", T.LongType(), False),
    T.StructField("quantity_sold_after_promo", T.LongType(), False),
])

DIM_CAMPAIGNS = T.StructType([
    T.StructField("campaign_id", T.StringType(), False),
    T.StructField("campaign_name", T.StringType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), False),
])

DIM_PRODUCTS = T.StructType([
    T.StructField("product_code", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
])

DIM_STORES = T.StructType([
    T.StructField("store_id", T.StringType(), False),
    T.StructField("city", T.StringType(), False),
])

PRIMARY_KEYS = {
    "dim_campaigns": ["campaign_id"],
    "dim_products": ["product_code"],
    "dim_stores": ["store_id"],
}

# fact column -> (dimension, dimension key)
FOREIGN_KEYS = {
    "campaign_id": ("dim_campaigns", "campaign_id"),
    "product_code": ("dim_products", "product_code"),
    "store_id": ("dim_stores", "store_id"),
}

