"""Physical layouts: bucketed joins without a shuffle, pruned folders, a sink that survives a lost job."""

import os

import pytest
from pyspark.sql import functions as F

from promoscope.operators.star import measured_bytes
from promoscope.plans import reports as R
from promoscope.sources.layout import (
    read_bucketed_star, read_parquet_star, recover_folder, replace_folder, write_bucketed_star, write_parquet_star)
from promoscope.sources.retail import write_report
from promoscope.sources.star import RetailStar
from promoscope.sources.testdata_star import testdata_star as build_star


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


REPORTS = [R.q3_campaign_revenue, R.q5_top5_products_ir, lambda s: R.q4_campaign_isu_rank(s, "FY1998"), R.city_performance, R.product_lift]


@pytest.fixture(scope="module")
def stored(spark, sf_small, tmp_path_factory):
    star = build_star(spark, sf_small)
    root = str(tmp_path_factory.mktemp("star"))
    write_parquet_star(star, root)
    return star, root, read_parquet_star(spark, root)


def test_reports_over_folders_by_campaign(spark, stored):
    star, root, back = stored
    assert any(d.startswith("campaign_id=") for d in os.listdir(f"{root}/fact_events"))
    assert back.fact_events.dtypes == star.fact_events.dtypes
    for fn in REPORTS:
        assert _rows(fn(back)) == _rows(fn(star))


def test_campaign_filter_prunes_the_facts_folders(spark, stored, tmp_path):
    """The filter is on the dimension; which folders are read is found while the query runs. Folders of other campaigns
    hold no readable file here, so reading one would fail."""
    star, _, _ = stored
    root = str(tmp_path / "star")
    write_parquet_star(star, root)
    want = _rows(R.q4_campaign_isu_rank(star, "FY1998"))
    for d in os.listdir(f"{root}/fact_events"):
        if d.startswith("campaign_id=") and d not in ("campaign_id=1998", "campaign_id=1994"):
            for f in os.listdir(f"{root}/fact_events/{d}"):
                if f.startswith("."):
                    os.remove(f"{root}/fact_events/{d}/{f}")
                else:
                    with open(f"{root}/fact_events/{d}/{f}", "wb") as fh:
                        fh.write(b"not a parquet file")
    spark.conf.set("spark.sql.parquet.mergeSchema", "false")
    fact = spark.read.schema(star.fact_events.schema).parquet(f"{root}/fact_events")
    back = RetailStar(fact.select(*star.fact_events.columns), star.dim_campaigns, star.dim_products, star.dim_stores)
    q4 = R.q4_campaign_isu_rank(back, "FY1998")
    assert "dynamicpruning" in _plan(q4) and _rows(q4) == want
    with pytest.raises(Exception):
        R.q3_campaign_revenue(back).collect()


def test_bucketed_star_joins_without_shuffling_the_fact(spark):
    """Products of over 64 MB, which are not broadcast: no exchange between the fact's scan and the join."""
    products = spark.range(600_000).select(
        F.col("id").cast("string").alias("product_code"), F.concat(F.lit("product with a long name " * 3), F.col("id").cast("string")).alias("product_name"),
        (F.col("id") % 50).cast("string").alias("category"))
    fact = spark.range(20_000).select(
        F.col("id").cast("string").alias("event_id"), (F.col("id") % 9).cast("string").alias("store_id"), F.lit("1998").alias("campaign_id"),
        F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") * 37 % 600_000).cast("string")).alias("product_code"),
        F.lit(100).cast("decimal(12,2)").alias("base_price"), F.lit("BOGOF").alias("promo_type"), (F.col("id") % 5).alias("quantity_sold_before_promo"),
        (F.col("id") % 7).alias("quantity_sold_after_promo"))
    camps = spark.sql("SELECT '1998' AS campaign_id, 'FY1998' AS campaign_name, date'1998-01-01' AS start_date, date'1998-12-31' AS end_date")
    stores = spark.range(9).select(F.col("id").cast("string").alias("store_id"), F.lit("x").alias("city"))
    star = RetailStar(fact, camps, products, stores)
    assert measured_bytes(products) > 64 * 1024 * 1024
    prefix = f"promoscope_{os.getpid()}_"
    # the files here compress to almost nothing: Spark's own estimate would broadcast them
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed_star(star, prefix, 8)
        back = read_bucketed_star(spark, prefix)
        for fn in (R.q5_top5_products_ir, R.product_lift):
            assert _rows(fn(back)) == _rows(fn(star))
        joined = back.fact_events.join(back.dim_products, "product_code")
        assert "SortMergeJoin" in _plan(joined) and "Exchange" not in _plan(joined)
        plan = _plan(R.q5_top5_products_ir(back))
        between = plan.split("SortMergeJoin")[1]
        assert f"{prefix}fact_events" in between and "hashpartitioning(product_code" not in between
        assert "Exchange" in _plan(fact.join(products, "product_code"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for t in ("fact_events", "dim_campaigns", "dim_products", "dim_stores"):
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{t}")


def test_a_job_lost_midway_leaves_the_old_report(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(10), path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_report(bad, path)
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["report"]
    write_report(spark.read.parquet(path).select((F.col("id") + 1).alias("id")), path)      # reads what it replaces
    assert spark.read.parquet(path).agg(F.sum("id")).first()[0] == 55 and os.listdir(tmp_path) == ["report"]


def test_a_writer_lost_between_the_renames(spark, tmp_path):
    path = str(tmp_path / "report")
    replace_folder(spark.range(3), path)
    os.rename(path, str(tmp_path / "_report.old"))
    assert recover_folder(spark, path) and spark.read.parquet(path).count() == 3 and not recover_folder(spark, path)
    os.rename(path, str(tmp_path / "_report.old"))
    replace_folder(spark.range(4).withColumn("half", F.col("id") % 2), path, partition_by=["half"])
    assert spark.read.parquet(path).filter("half = 1").count() == 2 and sorted(os.listdir(tmp_path)) == ["report"]
