"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (two long columns): the smallest id reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest (large-star, small-star); the number of rounds grows with the
    logarithm of the longest chain. A round joins the edges with one minimum per
    node, so no neighbourhood is ever gathered, and is written, so a lost
    executor costs one round at most. Only a count and a hash reach the driver.
    NULL ends and self-links are left out; no links give no rows."""
    a, b = links.columns[:2]
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    edges = scratch.write(edges, f"{name}-0")
    before = _fingerprint(edges)
    rows = 2 * before[0]                # a star contraction has an edge for each edge, and one for each node
    for k in range(1, max_rounds + 1):
        # large-star: every larger neighbour of a node moves to the smallest of the node and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = scratch.write(large, f"{name}-{k}-large", rows)
        # small-star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = scratch.write(small, f"{name}-{k}", rows)
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
