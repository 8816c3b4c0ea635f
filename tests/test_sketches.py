"""Stored sketches against the exact forms, within their documented errors."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from promoscope.operators import sketches as S
from promoscope.operators import stats


def _rows(spark, n=60_000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"promo": rng.choice(["a", "b", "hot", "hot", "hot", None], n), "campaign": rng.integers(0, 4, n),
                        "store": rng.integers(0, 9000, n).astype("float64"), "v": rng.normal(0, 100, n).round(2)})
    pdf.loc[rng.random(n) < 0.02, "store"] = np.nan
    pdf.loc[rng.random(n) < 0.02, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "promo string, campaign long, store double, v double")
    return df.withColumn("store", F.col("store").cast("long")).repartition(5)


def test_distinct_counts_merge(spark, tmp_path):
    df = _rows(spark)
    for campaign in range(4):                       # stored load by load
        S.distinct_sketches(df.filter(F.col("campaign") == campaign), ["promo", "campaign"], "store").write.mode("append").parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    for keys in (["promo", "campaign"], ["promo"], []):
        got = {tuple(r[:-1]): r[-1] for r in S.merged_distinct(stored, keys).collect()}
        want = {tuple(r[:-1]): r[-1] for r in df.groupBy(*keys).agg(stats.n_distinct_with_null("store")).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 4 * 1.04 / 64 * want[k] for k in want)


def test_small_groups_are_exact(spark):
    df = spark.range(3000).select((F.col("id") % 20).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 130).alias("v"))
    got = {r.g: r.n_distinct for r in S.merged_distinct(S.distinct_sketches(df, ["g"], "v"), ["g"]).collect()}
    assert got == {r.g: r.n for r in df.groupBy("g").agg(stats.n_distinct_with_null("v").alias("n")).collect()}


def test_quantiles_merge_within_the_rank_error(spark, tmp_path):
    df = _rows(spark)
    for campaign in range(4):
        S.quantile_sketches(df.filter(F.col("campaign") == campaign), ["promo", "campaign"], "v").write.mode("append").parquet(f"{tmp_path}/q")
    stored = spark.read.parquet(f"{tmp_path}/q")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}
    values = {}
    for r in df.filter("v IS NOT NULL").collect():
        values.setdefault(r.promo, []).append(r.v)
    got = {r.promo: r for r in S.merged_quantiles(stored, ["promo"], probs).collect()}
    assert got.keys() == values.keys()
    for promo, vs in values.items():
        vs = np.sort(vs)
        for name, p in probs.items():
            lo, hi = np.searchsorted(vs, got[promo][name], "left") / len(vs), np.searchsorted(vs, got[promo][name], "right") / len(vs)
            assert lo - S.rank_error() <= p <= hi + S.rank_error(), (promo, name)
    exact = {r.promo: r.med for r in stats.exact_percentiles(df, ["promo"], "v", {"med": 0.5}).collect()}
    assert all(abs(exact[p] - got[p].med) < 10 for p in exact)


def test_empty_and_all_null_groups(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert S.merged_distinct(S.distinct_sketches(none, ["g"], "v"), ["g"]).collect() == []
    assert S.merged_quantiles(S.quantile_sketches(none, ["g"], "v"), ["g"], {"m": 0.5}).collect() == []
    df = spark.createDataFrame([("a", None), ("a", None), (None, 2.0)], "g string, v double")
    assert {r.g: r.n_distinct for r in S.merged_distinct(S.distinct_sketches(df, ["g"], "v"), ["g"]).collect()} == {"a": 1, None: 1}
    assert {r.g: r.m for r in S.merged_quantiles(S.quantile_sketches(df, ["g"], "v"), ["g"], {"m": 0.5}).collect()} == {"a": None, None: 2.0}
