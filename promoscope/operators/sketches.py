"""Stored sketches: distinct counts (A11) and quantiles (A8, C2) that merge without the rows.

The exact forms in ``stats`` are the default. A sketch table is the opt-in for reports over many loads or days: one row
per fine group, written once, merged at read to any coarser grouping; no row of the fact is read again.

* *Distinct counts*: HyperLogLog sketches. The relative standard error is about ``1.04 / sqrt(2 ** lg_k)`` (1.6 % at
  the default 12); groups of up to some hundred values are told exactly. NULL counts as one more value, as in
  ``stats.n_distinct_with_null``, by a flag beside the sketch.
* *Quantiles*: KLL sketches. A quantile's normalised rank is off by at most ``rank_error(k)`` (1.7 % at the default
  200, 0.7 % at 500) with a probability of 99 %, however often sketches are merged. Values are doubles; NULL is left out.

Defined cases: an empty input gives no groups; a group whose values are all NULL has a distinct count of 1 (the NULL)
and no quantiles (NULL); NULL keys are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K, KLL_K = 12, 200


def rank_error(k: int = KLL_K) -> float:
    """Bound of a quantile's rank error, as a share of the group, that 99 of 100 quantiles keep."""
    return 2.446 / k ** 0.9433


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, ``sketch``, ``has_null``): a group's distinct values, to be stored."""
    of = F.col(value)
    if not isinstance(df.schema[value].dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        of = of.cast("string")          # the sketch hashes whole numbers, texts and bytes
    return df.groupBy(*keys).agg(F.hll_sketch_agg(of, lg_k).alias("sketch"), F.max(F.col(value).isNull()).alias("has_null"))


def merged_distinct(sketches: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """(keys, ``name``): distinct counts of coarser groups (``keys`` are some of the stored ones, or none)."""
    both = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("s"), F.max("has_null").alias("n"))
    count = F.coalesce(F.hll_sketch_estimate("s"), F.lit(0)) + F.coalesce(F.col("n").cast("long"), F.lit(0))
    return both.select(*keys, count.alias(name))


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """(keys, ``sketch``, ``n``): a group's values as a sketch of bounded size, to be stored."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(v, k).alias("sketch"), F.count(v).alias("n"))


def merged_quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, a column a probability): quantiles of coarser groups."""
    some = sketches.filter("n > 0").groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("s"))
    found = some.select(*keys, *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(name) for name, p in probs.items()])
    groups = sketches.select(*keys).distinct() if keys else None
    if groups is None:
        return found
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_f"))
    return (groups.join(found.withColumnsRenamed({c: f"{c}_f" for c in keys}), cond, "left")
            .select(*keys, *probs))
