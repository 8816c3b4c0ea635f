"""Physical layouts of the retail star that reports profit from without being written differently.

* ``write_parquet_star``: four Parquet folders, the fact laid out by campaign: a filter on the campaign dimension then
  prunes the fact's folders while the query runs (dynamic partition pruning, P6/J3).
* ``write_bucketed_star``: tables of the catalog with the fact and the product dimension in equally many buckets of
  ``product_code``: their join, the price lookup and every aggregate by product read bucket by bucket, without a
  shuffle of the fact, also where the products are too many to be broadcast (J1/P5).
* ``replace_folder``: what is written takes its place only when it is complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope import schemas
from promoscope.sources.star import RetailStar

TABLES = {"fact_events": schemas.FACT_EVENTS, "dim_campaigns": schemas.DIM_CAMPAIGNS,
          "dim_products": schemas.DIM_PRODUCTS, "dim_stores": schemas.DIM_STORES}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), lambda s: spark._jvm.org.apache.hadoop.fs.Path(s)


def _beside(path: str, what: str) -> str:
    """A hidden folder beside ``path``, which readers of the parent pass over."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{name}.{what}"


def recover_folder(spark: SparkSession, path: str) -> bool:
    """Puts back the complete old folder if a writer was lost between the two renames of ``replace_folder``."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(_beside(path, "old"))):
        return fs.rename(at(_beside(path, "old")), at(path.rstrip("/")))
    return False


def replace_folder(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    """Writes ``df`` beside ``path`` and puts it in its place by renaming when it is complete. A job that fails leaves
    the old folder as it was; so ``df`` may also read from ``path``. (Renames are cheap in a file system; an object
    store copies, and the old folder stays readable as ``_<name>.old`` meanwhile.)"""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    recover_folder(spark, path)
    staged, old, path = _beside(path, f"staged-{uuid.uuid4().hex}"), _beside(path, "old"), path.rstrip("/")
    try:
        w = df.write.format(fmt).options(**options)
        (w.partitionBy(*partition_by) if partition_by else w).save(staged)
        fs.delete(at(old), True)
        if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(at(staged), at(path)):
            recover_folder(spark, path)
            raise OSError(f"cannot move {staged} to {path}")
        fs.delete(at(old), True)
    finally:
        fs.delete(at(staged), True)


def write_parquet_star(star: RetailStar, root: str, partition_fact_by: str | None = "campaign_id") -> None:
    """The star as ``read_parquet_star`` reads it; the fact in one folder a campaign, unless that is turned off.

    The rows are dealt by the campaign and a number of files each, so that a campaign of any size is written by many
    tasks and no task holds all folders open."""
    for name in TABLES:
        df = getattr(star, name)
        by = [partition_fact_by] if name == "fact_events" and partition_fact_by else None
        if by:
            df = df.repartition(F.col(by[0]), F.pmod(F.xxhash64("event_id"), F.lit(FILES_A_FOLDER)))
        replace_folder(df, f"{root.rstrip('/')}/{name}", partition_by=by)


#: Files of a campaign's folder, at most.
FILES_A_FOLDER = 64


def read_parquet_star(spark: SparkSession, root: str) -> RetailStar:
    """S3: four Parquet folders under ``root``, named like the tables. A folder column keeps its declared type (Spark
    would guess a number where it can, and a cast would hide the folders from pruning)."""
    def load(name: str, schema: T.StructType) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        found = spark.read.parquet(path).schema
        declared = {f.name: f.dataType for f in schema.fields}
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(declared.get(f.name), T.StringType) else f.dataType) for f in found.fields])
        df = spark.read.schema(plain).parquet(path)
        df = df.withColumnsRenamed({k: v for k, v in schemas.RAW_QTY_RENAMES.items() if k in df.columns})
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return RetailStar(*(load(name, schema) for name, schema in TABLES.items()))


def write_bucketed_star(star: RetailStar, prefix: str, buckets: int, key: str = "product_code") -> None:
    """The star as catalog tables ``<prefix>fact_events`` ..., with those that have ``key`` in ``buckets`` buckets of it.

    Rows are dealt by the key before they are written, so a bucket is one file. A product with a third of all events
    makes one long bucket; the aggregates by product that reports begin with are partial within it."""
    for name in TABLES:
        df = getattr(star, name)
        w = df.repartition(buckets, key).write if key in df.columns else df.write
        if key in df.columns:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.mode("overwrite").format("parquet").saveAsTable(f"{prefix}{name}")


def read_bucketed_star(spark: SparkSession, prefix: str) -> RetailStar:
    return RetailStar(*(spark.table(f"{prefix}{name}") for name in TABLES))
