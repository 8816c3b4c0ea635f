"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. *Codes*: unit vectors are centred and projected on their principal axes, and a
   rotation is learnt that brings the projections closest to the corners of a
   cube (iterative quantisation). The signs are a balanced code of 64 bits, or of
   as many as the vectors have dimensions. The model is fitted on a bounded sample
   (``SAMPLE_ROWS`` vectors); every vector is coded.
2. *Tables*: a code is cut into four chunks, each the key of one table. Two codes
   that differ in 7 bits or fewer agree in some chunk but for one bit, so a vector
   has a home in every table and probes its chunk and those one bit away. Vectors
   at cosine 0.95 differ in a tenth of the bits, about 6 of 64, if the vectors point
   everywhere. If they share a direction, the centred vectors of such a pair
   differ in more: the sample tells in how many. Partners at the very cosine
   threshold are made for sampled vectors, and as many further codes (four tables
   each, by other rotations that are learnt from other starts) are added as
   it takes for ``RECALL`` of these pairs to meet, up to ``MOST_CODES``.
3. *Rerank*: pairs that meet (each in the first table where it can) and whose first
   codes differ by no more than nearly all of the made pairs do are compared by the
   cosine of the original vectors in double precision.

No pair leaves a task: a task gets blocks of at most ``BLOCK`` homes and probes
of a bucket (small buckets share a task, a large bucket is cut into a grid), first
with codes only, to find which vectors have a candidate at all, then with those
vectors; it returns link counts, and a spanning forest of its links for the
classes. Equal vectors are one node that counts as many times as it occurs.

Defined cases: vectors that are NULL, empty, zero, hold NULL or non-finite
components, or have another length than most of the sample link with nothing;
repeated rows are copies; a NULL ``vec_id`` counts as a vector and never names a
class unless all of it is NULL; an empty table gives no rows; extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import Scratch
from promoscope.llm.components import connected_components

SAMPLE_ROWS = 8192
BITS, TABLES = 64, 4                 # of a code
RECALL, MOST_CODES = 0.97, 24        # of pairs at the threshold, made from the sample; codes at most (96 tables)
BLOCK = 1024
_ROWS_A_TASK = 20_000


@dataclass
class Quantiser:
    dim: int
    mean: np.ndarray
    axes: list[np.ndarray]      # per code [dim, bits], principal axes times a rotation
    most: int = BITS            # bits by which the first codes of a pair may differ

    @property
    def bits(self) -> int:
        return self.axes[0].shape[1]

    def chunks(self) -> list[tuple[int, int, int]]:
        """(code, first bit, number of bits) of each table's chunk."""
        edges = np.linspace(0, self.bits, TABLES + 1).astype(int)
        return [(c, int(a), int(b - a)) for c in range(len(self.axes)) for a, b in zip(edges[:-1], edges[1:])]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """[vectors, codes]"""
        at = np.arange(self.bits, dtype=np.uint64)
        return np.stack([((((unit - self.mean) @ axes) > 0).astype(np.uint64) << at).sum(axis=1, dtype=np.uint64) for axes in self.axes], axis=1)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the vectors of two lists of codes meet, pair by pair, in any table?"""
        x = a ^ b
        near = np.zeros(len(x), dtype=bool)
        for c, low, n in self.chunks():
            near |= np.bitwise_count((x[:, c] >> np.uint64(low)) & np.uint64((1 << n) - 1)) <= 1
        return near & (np.bitwise_count(x[:, 0]) <= self.most)

    @classmethod
    def fit(cls, unit: np.ndarray, cosine: float = 0.95, bits: int = BITS, rounds: int = 50, seed: int = 11) -> Quantiser:
        dim = unit.shape[1]
        mean = unit.mean(axis=0)
        x = unit - mean
        _, main = np.linalg.eigh(x.T @ x)
        main = main[:, ::-1][:, : min(bits, dim)]
        v = x @ main
        rng = np.random.default_rng(seed)
        a = unit[rng.permutation(len(unit))[:2000]]
        b = threshold_partners(a, cosine, rng)
        model = cls(dim, mean, [])
        while len(model.axes) < MOST_CODES:
            r = np.linalg.qr(np.random.default_rng(seed + len(model.axes)).standard_normal((v.shape[1], v.shape[1])))[0]
            of = v if not model.axes else v[:2000]      # further rotations need less: they only have to differ
            for _ in range(rounds):
                corners = np.where(of @ r > 0, 1.0, -1.0)
                u, _, w = np.linalg.svd(corners.T @ of)
                r = (u @ w).T
            if model.axes:
                rounds = min(rounds, 15)
            model.axes.append(main @ r)
            ca, cb = model.codes(a), model.codes(b)
            if len(model.axes) == 1:
                apart = np.bitwise_count(ca[:, 0] ^ cb[:, 0])
                model.most = int(np.quantile(apart, 0.999)) + 2
            if dim == 1 or model.meet(ca, cb).mean() >= RECALL:
                break
        return model


def threshold_partners(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another one at exactly that cosine, in a random direction."""
    away = rng.standard_normal(unit.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * away / np.where(norm > 0, norm, 1)


def _unit(rows: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors divided by their norms, and where they were."""
    good, where = [], []
    for i, row in enumerate(rows):
        if row is None or not len(row) or (dim is not None and len(row) != dim):
            continue
        v = np.array([np.nan if x is None else x for x in row], dtype=np.float64) if None in row else np.asarray(row, dtype=np.float64)
        top = np.abs(v).max()
        if np.isfinite(top) and top > 0:
            v = v / top                     # so that squares neither overflow nor vanish
            good.append(v / np.sqrt(v @ v))
            where.append(i)
    return (np.stack(good) if good else np.zeros((0, dim or 0))), np.array(where, dtype=np.int64)


def fit(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", cosine: float = 0.95,
        sample_rows: int = SAMPLE_ROWS) -> Quantiser | None:
    """A quantiser from the first ``sample_rows`` usable vectors by a hash of their key; None if there is none."""
    order = F.xxhash64(F.lit("itq"), F.col(key).cast("string"))
    rows = [r[0] for r in vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).orderBy(order, key).select(column)
            .limit(sample_rows).collect()]
    sizes = pd.Series([len(r) for r in rows], dtype="int64").value_counts()
    if not len(sizes):
        return None
    unit, _ = _unit(rows, int(min(sizes.index[sizes == sizes.max()])))
    return Quantiser.fit(unit, cosine) if len(unit) else None


def _coded(vectors: DataFrame, model: Quantiser, column: str) -> DataFrame:
    """(key_, k1, k2, codes, unit): the vector's name by its components, its codes and its unit vector (NULL: unusable)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("key_", vectors.schema["key_"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("k1", "k2")]
                          + [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("unit", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                unit, where = _unit(batch.column(column).to_pylist(), m.dim)
                raw = [u.tobytes() for u in unit]
                name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in raw), dtype="<i8").reshape(-1, 2)
                out = np.zeros((batch.num_rows, 2), dtype=np.int64)
                out[where] = name
                codes = np.zeros((batch.num_rows, len(m.axes)), dtype=np.int64)
                if len(unit):
                    codes[where] = m.codes(unit).view(np.int64)
                ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                kept: list = [None] * batch.num_rows
                for i, r in zip(where, raw):
                    kept[i] = r
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key_"), *(pa.array(out[:, k].copy()) for k in range(2)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel())), pa.array(kept, pa.binary())],
                    names=[f.name for f in schema.fields])

    return vectors.mapInArrow(run, schema)


def _cells(nodes: DataFrame, model: Quantiser, scratch: Scratch) -> DataFrame:
    """(tab, chunk, home, uid, codes, cell, i, j): the homes and probes of all tables, dealt into blocks."""
    homes, probes = [], []
    for t, (c, low, n) in enumerate(model.chunks()):
        own = F.shiftrightunsigned(F.get("codes", F.lit(c)), low).bitwiseAND((1 << n) - 1)
        homes.append(F.struct(F.lit(t).alias("tab"), own.alias("chunk"), F.lit(True).alias("home")))
        near = [own] + [own.bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(n)]
        probes += [F.struct(F.lit(t).alias("tab"), c.alias("chunk"), F.lit(False).alias("home")) for c in near]
    rows = nodes.select("uid", F.explode(F.array(*homes, *probes)).alias("r")).select("r.*", "uid")
    count = (rows.groupBy("tab", "chunk").agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("p"))
             .filter("h > 0 AND p > 1"))
    grid = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    count = scratch.write(count.select("tab", "chunk", grid("h").alias("hs"), grid("p").alias("ps")), "buckets")
    n_rows = nodes.count() * (model.bits + 2 * TABLES) * len(model.axes)
    tasks = max(1, n_rows // _ROWS_A_TASK)
    spread = lambda c: F.pmod(F.xxhash64(F.lit(3), "uid"), F.col(c)).cast("int")
    large = (F.col("hs") > 1) | (F.col("ps") > 1)
    return (rows.join(count, ["tab", "chunk"])
            # a row stands in one line of its bucket's grid and crosses all blocks of the other side
            .withColumn("mine", F.when(F.col("home"), spread("hs")).otherwise(spread("ps")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("ps")).otherwise(F.col("hs")) - 1)))
            .withColumn("i", F.when(F.col("home"), F.col("mine")).otherwise(F.col("other")))
            .withColumn("j", F.when(F.col("home"), F.col("other")).otherwise(F.col("mine")))
            .withColumn("cell", F.when(large, F.xxhash64("tab", "chunk")).otherwise(F.pmod(F.xxhash64("tab", "chunk"), F.lit(tasks))))
            .select("tab", "chunk", "home", "uid", "cell", "i", "j").join(nodes.select("uid", "codes"), "uid"))


def _meetings(g: pd.DataFrame, chunks: list[tuple[int, int, int]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (home, probe) of the candidate pairs in a block, some at a time: the home has the smaller uid, the
    table is the first where the two chunks differ in a bit at most, and the first codes differ in ``most`` at most."""
    tab, chunk = g["tab"].to_numpy(), g["chunk"].to_numpy()
    uid, codes = g["uid"].to_numpy(), np.stack(g["codes"].to_list()).view(np.uint64)
    home, probe = np.flatnonzero(g["home"].to_numpy()), np.flatnonzero(~g["home"].to_numpy())
    bucket = chunk * len(chunks) + tab
    home = home[np.argsort(bucket[home], kind="stable")]
    at = bucket[home]
    low, high = np.searchsorted(at, bucket[probe], "left"), np.searchsorted(at, bucket[probe], "right")
    n = high - low
    ends = np.cumsum(n)
    done = 0
    while done < len(probe):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 500_000, "right")))
        k = n[done:stop]
        p = np.repeat(probe[done:stop], k)
        h = home[np.repeat(low[done:stop], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        ok = uid[h] < uid[p]
        h, p = h[ok], p[ok]
        ok = np.bitwise_count(codes[h, 0] ^ codes[p, 0]) <= most
        h, p = h[ok], p[ok]
        ok = np.ones(len(h), dtype=bool)
        for t, (c, first, size) in enumerate(chunks):
            part = np.bitwise_count(((codes[h, c] ^ codes[p, c]) >> np.uint64(first)) & np.uint64((1 << size) - 1))
            ok &= (part > 1) | (t >= tab[h])
        yield h[ok], p[ok]
        done = stop


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each member's smallest connected member."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", cosine: float = 0.95,
                 model: Quantiser | None = None) -> DataFrame:
    """One row per vector: the key, n_links, component_id and kept."""
    scratch = Scratch(vectors.sparkSession, "itq")
    model = model or fit(vectors, column, key, cosine)
    base = vectors.select(F.col(key).alias("key_"), F.col(column).alias("v_"))
    if model is None:
        return base.select(F.col("key_").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key_").alias("component_id"), F.lit(True).alias("kept"))
    chunks = model.chunks()
    coded = scratch.write(_coded(base, model, "v_"), "coded")
    nodes = (coded.filter(F.col("unit").isNotNull()).groupBy("k1", "k2")
             .agg(F.min("key_").alias("rep"), F.count("*").alias("copies"), F.first("codes").alias("codes"), F.first("unit").alias("unit")))
    nodes = scratch.write(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    cells = _cells(nodes.select("uid", "codes"), model, scratch)
    most = model.most

    def with_candidates(g: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(len(g), dtype=bool)
        for h, p in _meetings(g, chunks, most):
            on[h] = on[p] = True
        return g[on]

    asked = scratch.write(cells.groupBy("cell", "i", "j").applyInPandas(with_candidates, cells.schema), "asked")
    schema = "uid long, add long, to long"

    def rerank(g: pd.DataFrame) -> pd.DataFrame:
        g = g.reset_index(drop=True)
        unit = np.frombuffer(b"".join(g["unit"]), dtype=np.float64).reshape(len(g), -1)
        uid, copies = g["uid"].to_numpy(), g["copies"].to_numpy()
        who, first = np.unique(uid, return_inverse=True)
        add, pairs = np.zeros(len(who), dtype=np.int64), []
        for h, p in _meetings(g, chunks, most):
            for k in range(0, len(h), 50_000):
                a, b = h[k: k + 50_000], p[k: k + 50_000]
                ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[ok], b[ok]
                np.add.at(add, first[a], copies[b])
                np.add.at(add, first[b], copies[a])
                pairs.append((first[a], first[b]))
        if not pairs:
            return pd.DataFrame({"uid": [], "add": [], "to": []}).astype("int64")
        label = _forest(len(who), *(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))
        out = pd.DataFrame({"uid": who, "add": add, "to": who[label]})
        return out[out["add"] > 0]

    found = (asked.join(nodes.select("uid", "copies", "unit"), "uid").groupBy("cell", "i", "j").applyInPandas(rerank, schema))
    found = scratch.write(found, "found")
    parts = connected_components(found.select("uid", "to"), scratch)
    links = found.groupBy("uid").agg(F.sum("add").alias("others"))
    known = (nodes.select("uid", "k1", "k2", "rep", "copies").join(links, "uid", "left")
             .join(parts.withColumnRenamed("id", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid")))
    names = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(names, "component").select(
        "k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    usable = F.col("unit").isNotNull()
    out = coded.select("key_", "k1", "k2", usable.alias("usable")).join(known.withColumn("usable", F.lit(True)), ["k1", "k2", "usable"], "left")
    return (out.select(F.col("key_").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("component_id", "key_").alias("component_id"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
