"""Centroid clustering by bisector tournament: exact k-means in whole numbers.

Vectors become whole numbers, ``floor(1024 x)`` a component. The first centroids are
the ``k`` vectors with the smallest hash of their key. A round assigns every vector
to its nearest centroid (squared Euclidean distance; ties: the smaller number) and
moves every centroid that has vectors to their mean, rounded down by component.

*Tournament*: ``|x - a|^2 <= |x - b|^2`` exactly when ``2 (b - a) x <= |b|^2 - |a|^2``,
so for every two centroids the normal ``b - a`` and the threshold are worked out once
a round, in whole numbers. A vector starts with centroid 0 as its champion and meets
the others in order: the sign of one linear test eliminates one of the two, and zero
favours the champion, which has the smaller number. After k - 1 tests one is left,
the nearest; only its distance is computed, exactly.

The vectors are written once, as whole numbers. A round is one pass over them: a
task returns one sum a centroid and component, Spark adds them up, and k times 64
numbers reach the driver, which divides. No vector is shuffled.

Defined cases: vectors that are NULL, of another length than ``DIM``, or with a
component that is NULL, not finite, or so large that a squared distance would not fit
64 bits (``floor(1024 x)`` beyond 2^27, |x| above 131,071) are left out; repeated rows are
vectors each, and may be first centroids side by side; a NULL key comes last in the
choice of the first centroids; with fewer vectors than ``k`` each is a centroid; a sum
of distances that does not fit 64 bits is NULL; an empty table gives no rows; extra
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import Scratch

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
LARGEST = 1 << 27           # of a whole component: tests and distances then fit 64 bits
_ROWS = 4096                # vectors that are tested at a time


def _whole(vectors: DataFrame, column: str) -> DataFrame:
    """(key_, v): the vectors' whole components, as 4 bytes each; unusable vectors are left out."""
    schema = T.StructType([T.StructField("key_", vectors.schema["key_"].dataType), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                where, raw = [], []
                for i, row in enumerate(batch.column(column).to_pylist()):
                    if row is None or len(row) != DIM or None in row:
                        continue
                    x = np.asarray(row, dtype=np.float64)
                    if not np.isfinite(x).all():
                        continue
                    x = np.floor(x * SCALE)
                    if np.abs(x).max() <= LARGEST:
                        where.append(i)
                        raw.append(x.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("key_").take(pa.array(where, pa.int64())), pa.array(raw, pa.binary())],
                                                 names=["key_", "v"])

    return vectors.mapInArrow(run, schema)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, components) of some rows at a time."""
    for a in range(0, batch.num_rows, _ROWS):
        part = batch.column("v").slice(a, _ROWS)
        yield a, np.frombuffer(b"".join(part.to_pylist()), dtype="<i4").reshape(-1, DIM).astype(np.int64)


class Bisectors:
    """The tests between every two centroids. ``centroids``: [k, DIM] whole numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = (centroids * centroids).sum(axis=1)
        self.normals = centroids[None, :, :] - centroids[:, None, :]        # [a, b]: b - a
        self.thresholds = norms[None, :] - norms[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The tournament's last champion for every row of ``x``."""
        champion = np.zeros(len(x), dtype=np.int64)
        for other in range(1, len(self.centroids)):
            side = 2 * np.einsum("ij,ij->i", self.normals[champion, other], x) - self.thresholds[champion, other]
            champion = np.where(side > 0, other, champion)
        return champion

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        away = x - self.centroids[cluster]
        return (away * away).sum(axis=1)


def _moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    tests, k = Bisectors(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIM + 1), dtype=object)        # the last column counts; Python's numbers do not overflow
        for batch in batches:
            for _, x in _vectors(batch):
                cluster = tests.nearest(x)
                part = np.zeros((k, DIM + 1), dtype=np.int64)
                np.add.at(part, cluster, np.c_[x, np.ones(len(x), dtype=np.int64)])
                total = total + part
        at = np.flatnonzero(total[:, DIM])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, DIM + 1), pa.int32()), pa.array(np.tile(np.arange(DIM + 1), len(at)), pa.int32()),
             pa.array([int(v) for v in total[at].ravel()], pa.decimal128(38, 0))], names=["cluster", "i", "s"])

    sums = whole.select("v").mapInArrow(run, "cluster int, i int, s decimal(38,0)").groupBy("cluster", "i").agg(F.sum("s").alias("s"))
    out, found = centroids.copy(), {(r.cluster, r.i): int(r.s) for r in sums.collect()}       # k * (DIM + 1) numbers
    for c in range(k):
        if (c, DIM) in found:
            out[c] = [found[c, i] // found[c, DIM] for i in range(DIM)]
    return out


def cluster(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per usable vector: the key, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    base = vectors.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{column}`").alias("v_"))
    whole = scratch.write(_whole(base, "v_"), "whole")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key_").cast("string")), 256)
    first = whole.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    kind = vectors.schema[key].dataType
    if not first:
        return spark.createDataFrame([], T.StructType([
            T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")),
            T.StructField("centroid_sha256", T.StringType())]))
    centroids = np.stack([np.frombuffer(r.v, dtype="<i4").astype(np.int64) for r in first])
    for _ in range(rounds):
        moved = _moved(whole, centroids)
        if (moved == centroids).all():      # further rounds would not move them either
            break
        centroids = moved
    tests = Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in _vectors(batch):
                near = tests.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column("key_").slice(a, len(x)), pa.array(near.astype(np.int32)),
                                                  pa.array(tests.distance(x, near))], names=[key, "cluster", "distance"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = scratch.write(whole.mapInArrow(run, schema), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in sorted(sums.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")     # k rows at most
    return (assigned.join(F.broadcast(told), "cluster")
            .select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
