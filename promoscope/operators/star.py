"""Star-schema joins.

Two join flavours exist in the reference and both are kept:

* SQL reports use inner equi-joins: a NULL key matches nothing.
* R reports use dplyr-style left joins: every fact row is kept, and a NULL key
  matches a NULL dimension key (``eqNullSafe``). Spark still plans ``<=>`` as
  an equi-join (hash or sort-merge), so this costs nothing extra.

A dimension is broadcast only behind a measured bound in bytes
(``sized_broadcast``): one partially aggregated job adds up its rows and the
lengths of its values, and the hint is given only below ``max_bytes``;
otherwise the join is left to the planner and AQE (sort-merge, skew splitting).
This matters for dimensions derived by aggregation (the campaign table is the
distinct order years): Catalyst estimates their size from the whole input, and
a runtime conversion by AQE comes after the fact side has been shuffled.
The measuring job runs while the plan is built (``star_dim``, ``enrich`` and
the reports over them), once per DataFrame of a dimension.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:           # the sources use this module too
    from promoscope.sources.star import RetailStar

DIM_KEYS = {
    "dim_campaigns": "campaign_id",
    "dim_products": "product_code",
    "dim_stores": "store_id",
}


def left_join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keep every left row; NULL matches NULL; the right key column is dropped."""
    rk = f"__{key}_r"
    r = right.withColumnRenamed(key, rk)
    return left.join(r, F.col(key).eqNullSafe(F.col(rk)), "left").drop(rk)


def inner_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SQL inner equi-join on one key column."""
    return left.join(right, key, "inner")


DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32           # bytes of an in-memory row besides its values


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and its size in memory, about: a row's overhead, 8 bytes a column and the text lengths.

    One aggregation with map-side sums: a task sends one row whatever it reads."""
    size = F.lit(ROW_OVERHEAD + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    got = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return got[0], int(got[1] or 0)


def measured_bytes(df: DataFrame) -> int:
    return measured_size(df)[1]


def sized_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if ``df`` measures at most ``max_bytes``, else ``df``. Runs the measuring job."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def dim_size(star: RetailStar, name: str) -> tuple[int, int]:
    """Rows and bytes of a dimension of ``star``. Measured once per DataFrame: a star over a re-read dimension
    measures it anew, even where it shares the memo."""
    df = getattr(star, name)
    known = star.memo.get(("size", name))
    if known is None or known[0] is not df:
        known = star.memo[("size", name)] = (df, measured_size(df))
    return known[1]


def dim_is_small(star: RetailStar, name: str, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """Whether a dimension of ``star`` measures at most ``max_bytes``."""
    return dim_size(star, name)[1] <= max_bytes


def star_dim(star: RetailStar, name: str, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """A dimension of ``star`` prepared for a join with the fact: broadcast if
    measured small."""
    dim = getattr(star, name)
    return F.broadcast(dim) if dim_is_small(star, name, max_bytes) else dim


def enrich(star: RetailStar, fact: DataFrame | None = None,
           dims=("dim_campaigns", "dim_products", "dim_stores"), how: str = "left",
           max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """The wide fact. ``dims`` names only the dimensions a report needs, since
    Spark cannot drop an unused outer join by itself."""
    out = star.fact_events if fact is None else fact
    for d in dims:
        dim, key = star_dim(star, d, max_broadcast_bytes), DIM_KEYS[d]
        out = left_join_null_safe(out, dim, key) if how == "left" else inner_join(out, dim, key)
    return out


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row global aggregate on every row.

    Planned as scalar subqueries: Spark computes the aggregate once, before
    the main job, and inlines its value; there is no join at all. (A scalar
    subquery must return at most one row; a global aggregate always does.)"""
    spark = df.sparkSession
    cols = ", ".join(f"(SELECT `{c}` FROM {{scalar}}) AS `{c}`" for c in one_row.columns)
    return spark.sql(f"SELECT *, {cols} FROM {{rows}}", rows=df, scalar=one_row)
