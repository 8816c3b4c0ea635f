"""Key and nullability checks the DDL declares but files do not enforce.

Returns one row per check, ``(check, violations)``:

* ``<table>.<pk>.duplicate_keys``: key values present more than once
* ``<table>.<col>.nulls``: NULLs in a NOT NULL column
* ``fact_events.<fk>.orphans``: fact rows whose key has no dimension row

Every table is scanned once. A dimension is summed up by its key (rows and NULL
counts per key, partially aggregated), the fact once by each of its keys (one
``groupingSets`` pass, whose first set also carries the NULL counts), and each
profile is written to the shared checkpoint folder by a job that runs
while the plan is built. The checks read only the profiles: NULL and duplicate
checks add them up, and orphans are an anti-join of the fact's rows per key
with the dimension's keys, one row per distinct key on either side.

Profiles add up, so checks need not read a load again: ``add_load`` writes the
profiles of one load's rows into an append-only table, and ``checks_of_loads``
gives the checks of all loads together from those tables alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from promoscope.session import materialize
from promoscope.sources.layout import replace_folder
from promoscope.sources.star import RetailStar

TABLES = ("fact_events", "dim_campaigns", "dim_products", "dim_stores")


def _measures(columns: list[str]) -> list:
    return [F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.col(c).isNull()).cast("bigint").alias(f"_null_{c}") for c in columns)]


def _profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and NULLs of the columns per value of the keys."""
    return df.groupBy(*keys).agg(*_measures(columns))


def _fact_profile(fact: DataFrame, fks: list[str], columns: list[str]) -> DataFrame:
    """Rows per distinct value of each key, ``_set`` telling whose; the NULL counts ride with every set."""
    which = F.lit(None).cast("string")
    for k in fks:
        which = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(which)
    return fact.groupingSets([[k] for k in fks], *fks).agg(which.alias("_set"), *_measures(columns))


def _null_checks(profile: DataFrame, table: str, columns: list[str]) -> DataFrame:
    sums = profile.agg(*[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(c) for c in columns])
    pairs = ", ".join(f"'{table}.{c}.nulls', `{c}`" for c in columns)
    return sums.selectExpr(f"stack({len(columns)}, {pairs}) as (`check`, violations)")


def _one(check: str, rows: DataFrame, violations) -> DataFrame:
    return rows.agg(violations.cast("bigint").alias("violations")).select(F.lit(check).alias("check"), "violations")


def _columns(star: RetailStar, not_null: dict[str, list[str]] | None) -> dict[str, list[str]]:
    if not_null is not None:
        return not_null
    return {t: [c for c in getattr(star, t).columns if not (t == "fact_events" and c == "promo_type")] for t in TABLES}


def _profiles(star: RetailStar, not_null: dict[str, list[str]]) -> dict[str, DataFrame]:
    fks = list(FOREIGN_KEYS)
    out = {t: _profile(getattr(star, t), key, not_null.get(t, [])) for t, key in PRIMARY_KEYS.items()}
    return {"fact_events": _fact_profile(star.fact_events, fks, not_null.get("fact_events", [])), **out}


def _checks(profiles: dict[str, DataFrame], not_null: dict[str, list[str]]) -> DataFrame:
    fact = profiles["fact_events"]
    whole = {**profiles, "fact_events": fact.where(F.col("_set") == next(iter(FOREIGN_KEYS)))}
    parts = [_null_checks(whole[t], t, not_null[t]) for t in TABLES if not_null.get(t)]
    for t, key in PRIMARY_KEYS.items():
        twice = profiles[t].where(F.col("_rows") > 1)
        parts.append(_one(f"{t}.{'+'.join(key)}.duplicate_keys", twice, F.count(F.lit(1))))
    for k, (dim, dk) in FOREIGN_KEYS.items():
        per_key = fact.where(F.col("_set") == k).select(k, "_rows")
        known = profiles[dim].select(F.col(dk).alias("_dk"))
        missing = per_key.join(known, F.col(k) == F.col("_dk"), "left_anti")
        parts.append(_one(f"fact_events.{k}.orphans", missing, F.coalesce(F.sum("_rows"), F.lit(0))))
    return reduce(DataFrame.unionByName, parts)


def quality_checks(star: RetailStar, not_null: dict[str, list[str]] | None = None) -> DataFrame:
    not_null = _columns(star, not_null)
    profiles = {t: materialize(p, f"{t}-profile") for t, p in _profiles(star, not_null).items()}
    return _checks(profiles, not_null)


def add_load(load: RetailStar, root: str, load_id: str, not_null: dict[str, list[str]] | None = None) -> None:
    """Writes the profiles of one load, a star that holds only the load's new rows (of any table), under ``root``.

    Only the load is read. A load that is added again, say after a failure, replaces its own profiles."""
    for t, profile in _profiles(load, _columns(load, not_null)).items():
        replace_folder(profile, f"{root.rstrip('/')}/{t}/load={load_id}")


def checks_of_loads(spark: SparkSession, root: str) -> DataFrame:
    """``quality_checks`` of all loads together, from their profiles: a key is a duplicate, or known, across loads. Reads
    a row per load and distinct key, and no fact."""
    merged, not_null = {}, {}
    for t in TABLES:
        stored = spark.read.parquet(f"{root.rstrip('/')}/{t}").drop("load")
        sums = [c for c in stored.columns if c == "_rows" or c.startswith("_null_")]
        keys = [c for c in stored.columns if c not in sums]
        not_null[t] = [c.removeprefix("_null_") for c in sums if c != "_rows"]
        merged[t] = materialize(stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), f"{t}-profiles")
    return _checks(merged, not_null)


def compact_loads(spark: SparkSession, root: str, load_id: str = "compacted") -> None:
    """Merges the profiles of all loads into one, so that many small loads do not pile up. The merged profile is
    complete beside the loads before they go."""
    for t in TABLES:
        path = f"{root.rstrip('/')}/{t}"
        stored = spark.read.parquet(path).drop("load")
        sums = [c for c in stored.columns if c == "_rows" or c.startswith("_null_")]
        keys = [c for c in stored.columns if c not in sums]
        whole = stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("load", F.lit(load_id))
        replace_folder(whole, path, partition_by=["load"])
