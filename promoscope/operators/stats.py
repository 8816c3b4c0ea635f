"""Statistics (A7-A12, C2) that stay distributed.

The exact percentile is computed without gathering any group into one task:
values are first counted per (group, value), the counts are range-partitioned
on (group, value), running counts are taken inside each range partition, and
the per-partition totals (at most partitions + groups rows) give each partition
its offset. A value's global rank interval inside its group then follows from
a join, and only the two order statistics around each requested quantile are
kept. A group holding a third of all rows is spread over many range
partitions like any other.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.session import materialize


def null_safe_join_cond(keys: list[str], lsuffix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(k + lsuffix))
    return cond


def range_partition(df: DataFrame, cols: list, num_ranges: int | None = None) -> DataFrame:
    """Range-partition on ``cols`` and tag rows with their range id ``_part``.

    Without ``num_ranges`` the partition count is left to AQE, which may merge
    adjacent ranges (never split them), so ``_part`` stays ordered and equal
    keys stay in one range, while a small input does not fan out to
    ``spark.sql.shuffle.partitions`` empty tasks."""
    out = df.repartitionByRange(num_ranges, *cols) if num_ranges else df.repartitionByRange(*cols)
    return out.withColumn("_part", F.spark_partition_id())


def _with_ranges(freq: DataFrame, keys: list[str], value: str, num_ranges: int | None) -> DataFrame:
    """Range-partition the counts on (keys, value) and tag each row with its
    range (``_part``). Equal (keys, value) pairs land in one range; a huge
    group spans many ranges."""
    return range_partition(freq, [*keys, value], num_ranges)


def value_counts(df: DataFrame, keys: list[str], value: str, num_ranges: int | None = None) -> DataFrame:
    """``(keys, value, _c, _part)``: copies of each value per group, NULL
    values included (as their own row). This is the one pass over the input
    that the percentiles need; it is partially aggregated before its shuffle.

    The counts are range-partitioned (``_part``, see ``rank_intervals``) and
    written once as Parquet into the shared folder named by
    ``spark.checkpoint.dir``, by a job that runs while the plan is built. The
    percentiles read the table in several branches, which must all see the same
    ranges whatever the optimiser reuses; the written table also cuts the
    lineage for executor loss."""
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return materialize(_with_ranges(freq, keys, value, num_ranges), "value-counts")


def rank_intervals(freq: DataFrame, keys: list[str], value: str) -> DataFrame:
    """From ``value_counts``, one row per distinct non-NULL (keys, value) with
    ``_c`` (copies), ``_lo``/``_hi`` (1-based rank interval of those copies
    inside the group) and ``_n`` (non-NULL values in the group).

    Running counts are taken inside each (range, group); each range's offset
    inside its group is the sum of the counts of the earlier ranges, from a
    table of at most ranges + groups rows."""
    ranged = freq.where(F.col(value).isNotNull())
    running = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_cum", F.sum("_c").over(running))
    totals = ranged.groupBy("_part", *keys).agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
                     .withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys)))
                     .select(F.col("_part").alias("_part_o"),
                             *[F.col(k).alias(k + "_o") for k in keys], "_off", "_n"))
    cond = (F.col("_part") == F.col("_part_o")) & null_safe_join_cond(keys, "_o")
    j = local.join(offsets, cond, "inner")
    return j.select(*keys, value, "_c", "_n",
                    (F.col("_off") + F.col("_cum") - F.col("_c") + 1).alias("_lo"),
                    (F.col("_off") + F.col("_cum")).alias("_hi"))


def _as_double(c: Column) -> Column:
    return c.cast("double")


def percentiles_from_counts(freq: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                            to_double=_as_double) -> DataFrame:
    """Exact linear-interpolation percentiles per group (R ``quantile`` type 7,
    R ``median``, Spark ``percentile``, DuckDB ``quantile_cont``) from value
    counts. ``probs`` maps output column name -> probability. ``to_double``
    maps the (ordered) value to the double that is interpolated, e.g. an
    integer money count to currency. Groups without non-NULL values are absent."""
    iv = rank_intervals(freq, keys, value)
    v = to_double(F.col(value))
    picks, wanted = [], F.lit(False)
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo_rank, hi_rank = F.floor(h) + 1, F.ceil(h) + 1
        has_lo = (F.col("_lo") <= lo_rank) & (lo_rank <= F.col("_hi"))
        has_hi = (F.col("_lo") <= hi_rank) & (hi_rank <= F.col("_hi"))
        wanted = wanted | has_lo | has_hi
        picks += [F.max(F.when(has_lo, v)).alias(f"_{name}_lo"),
                  F.max(F.when(has_hi, v)).alias(f"_{name}_hi"),
                  F.max(h - F.floor(h)).alias(f"_{name}_f")]
    agg = iv.where(wanted).groupBy(*keys).agg(*picks)
    out = [F.col(k) for k in keys]
    for name in probs:
        lo, hi, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out.append((lo + (hi - lo) * fr).alias(name))
    return agg.select(*out)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      num_ranges: int | None = None, to_double=_as_double) -> DataFrame:
    """``percentiles_from_counts`` over the value counts of ``df``."""
    return percentiles_from_counts(value_counts(df, keys, value, num_ranges), keys, value, probs, to_double)


def approx_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                       accuracy: int = 10000) -> DataFrame:
    """Opt-in bounded-memory variant (``percentile_approx``); exact is the default."""
    ps = list(probs.items())
    arr = F.percentile_approx(F.col(value).cast("double"), [p for _, p in ps], accuracy)
    agg = df.groupBy(*keys).agg(arr.alias("_q"))
    return agg.select(*keys, *[F.col("_q")[i].alias(n) for i, (n, _) in enumerate(ps)])


def mean_of(sum_col: Column, count_col: Column) -> Column:
    """Mean from an exact sum and a count: one division, NULL for no values."""
    return F.try_divide(sum_col.cast("double"), count_col.cast("double"))


def n_distinct_with_null(c: str) -> Column:
    """A11 with R's ``n_distinct`` rule: NULL counts as one more value."""
    return F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))


def boxplot_stats(df: DataFrame, keys: list[str], value: str, coef: float = 1.5,
                  num_ranges: int | None = None, to_double=_as_double) -> DataFrame:
    """Per-group box summary as a box plot draws it: quartiles (type 7),
    whiskers at the furthest values within ``coef`` x IQR of the box, and the
    number of points beyond them. Both passes run on the value counts: exact
    quartiles, then one aggregate over the counts with the (one row per group)
    quartiles joined back."""
    freq = value_counts(df, keys, value, num_ranges)
    q = percentiles_from_counts(freq, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, to_double)
    q = q.select(*[F.col(k).alias(k + "_q") for k in keys], "q1", "median", "q3")
    v = to_double(F.col(value))
    j = freq.where(F.col(value).isNotNull()).join(q, null_safe_join_cond(keys, "_q"), "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(coef) * iqr
    hi_f = F.col("q3") + F.lit(coef) * iqr
    return (j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= lo_f, v)).alias("lower_whisker"),
        F.max(F.when(v <= hi_f, v)).alias("upper_whisker"),
        F.coalesce(F.sum(F.when((v < lo_f) | (v > hi_f), F.col("_c"))), F.lit(0)).alias("outliers"),
        F.sum("_c").alias("n")))
