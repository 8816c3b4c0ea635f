"""Ordering operators (W1, W2, O1-O5, C1) with deterministic tie-breaks.

* ``top_k``: ``orderBy(..).limit(k)`` plans as TakeOrderedAndProject: each
  partition keeps k rows, one task merges them.
* ``top_n_per_group``: ``row_number`` per group; Spark inserts a
  WindowGroupLimit before the shuffle.
* ``global_rank``: rank/row number over the whole frame, in one of two physical
  forms. Up to ``ONE_TASK_ROWS`` rows, known from a bound that the caller has
  measured or counted on the written input, one task sorts them. Beyond, no
  single-partition window: range-partition on the order keys, number rows
  inside each range, add the row count of all earlier ranges (a table of one
  row per range); ranks with ties take the first row number of their tie group.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.operators.stats import range_partition
from promoscope.session import materialize


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    name: str = "_rn") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).drop(name)


def _orders(cols: list[str], descending) -> list[Column]:
    desc = descending if isinstance(descending, (list, tuple)) else [descending] * len(cols)
    return [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in zip(cols, desc)]


#: Rows that one task may sort and number: narrow rows, some 100 MB.
ONE_TASK_ROWS = 1_000_000


def global_rank(df: DataFrame, cols: list[str], name: str, method: str = "rank",
                descending=False, num_ranges: int | None = None, at_most: int | None = None,
                one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Rank over the whole frame by ``cols`` (NULLs last). ``descending``: one flag or one per column.

    ``at_most``: rows that ``df`` has at most, where the caller has measured that (e.g. groups by a dimension's
    attribute are no more than its rows). Up to ``one_task_rows`` the rank is a plain window and no job runs. Without
    such a bound the input is written and counted, and the form chosen by the count. Both forms give the same ranks;
    row numbers too, if ``cols`` are unique.

    ``row_number``: ties broken by ``cols`` in order (make them unique).
    ``rank`` (gaps after ties): a row number over ``cols`` plus a per-row id,
    so even a huge tie group is spread over many ranges; then the smallest row
    number of each tie group (partially aggregated: a hot tie costs one row per
    task) is joined back as the rank.

    The range scheme reads its input several times (range totals, numbering, tie
    groups), so the range-partitioned input is always written to the shared
    checkpoint folder first (a job that runs while the plan is built): the
    branches must see the same ranges, whatever the optimiser reuses, and the
    plan that produced it runs once."""
    assert method in ("rank", "row_number")
    order = _orders(cols, descending)
    if at_most is None and num_ranges is None and one_task_rows:
        df = materialize(df, "to-rank")
        at_most = df.count()
    if at_most is not None and at_most <= one_task_rows and num_ranges is None:
        number = F.rank() if method == "rank" else F.row_number()
        return df.withColumn(name, number.over(Window.orderBy(*order)).cast("bigint"))
    if method == "rank":
        df = df.withColumn("_rid", F.monotonically_increasing_id())
        order = order + [F.asc("_rid")]
    rn = _row_number(df, order, "_rn" if method == "rank" else name, num_ranges)
    if method == "row_number":
        return rn
    firsts = rn.groupBy(*cols).agg(F.min("_rn").alias(name)).select(
        *[F.col(c).alias(c + "_o") for c in cols], name)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(c + "_o"))
    return rn.join(firsts, cond, "inner").drop(*[c + "_o" for c in cols], "_rid", "_rn")


def _row_number(df: DataFrame, order: list[Column], name: str, num_ranges: int | None) -> DataFrame:
    """Range-partition on the order, number rows inside each range, add the
    row count of all earlier ranges (a table of one row per range)."""
    ranged = materialize(range_partition(df, order, num_ranges), "ranked")
    w = Window.partitionBy("_part").orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per range: the unpartitioned window is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_part_o"),
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    j = local.join(offsets, F.col("_part") == F.col("_part_o"), "inner")
    return j.withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint")).drop(
        "_part", "_part_o", "_off", "_local")


def axis_order(df: DataFrame, label: str, y: str, name: str = "axis_position",
               num_ranges: int | None = None) -> DataFrame:
    """Position of each label on a chart axis ordered by the mean of ``y``
    per label (ascending, ties by label), attached to every row of ``df``.
    ``df`` is read twice (means, then the rows the positions attach to), so it
    is written once (while the plan is built) and its plan does not run twice."""
    df = materialize(df, "axis-input")
    rows = df.count()           # no more labels than rows
    means = df.groupBy(label).agg(F.avg(F.col(y).cast("double")).alias("_mean"))
    pos = global_rank(means, ["_mean", label], name, method="row_number", num_ranges=num_ranges,
                      at_most=rows if rows <= ONE_TASK_ROWS else None).drop("_mean")
    pos = pos.withColumnRenamed(label, "_label_o")
    return df.join(pos, F.col(label).eqNullSafe(F.col("_label_o")), "left").drop("_label_o")
