"""N-gram Jaccard join: exact near-duplicate classes through metric-space regions.

Word shingles make a text a set; Jaccard distance is a metric. Nearly all pairs
of texts are at distance 1, where document pivots tell nothing apart, so the
join works on two kinds of pivots, one inside the other:

*Outer regions* have single shingles as pivots. A text's nearest pivots are its
own shingles, all equally near; ties go by the shingle's hash. Two texts within
the radius must have a pivot in common among their first ones, so a text is
replicated to the regions of its first ``n - need(n) + 1 + slack(n)`` shingles,
its boundary window; two such texts then share at least ``1 + slack`` regions.
A *hot* region (more than ``HOT`` texts) is left out for texts that are in no
more hot regions than the slack covers: they still share another region. The
few texts made mostly of hot shingles recurse: their regions are chosen anew,
by the rarest shingles among themselves.

*Inner regions* have document pivots. A large region picks a pivot and measures
all members against it: those within the radius are linked to it. By the
triangle inequality only members in the window ``distance - radius`` of the
nearest outsider can link to an outsider; each outsider looks for one partner
among them. Outsiders without a partner are the next round's region, for
``ROUNDS`` rounds; what is left then, and every small cell, is cut into rings by the
distance to its last pivot, a radius wide. Texts of one ring can only be similar to
texts of the same and the next ring, so each ring is compared with those two, in
blocks of ``BLOCK`` texts.

*Comparison*: sets travel to blocks, never with pairs. Pairs of texts that share
enough regions are dealt out by their neighbourhoods (a text's least candidate), so
that the members of a group meet in one block or a grid of blocks; a task compares
what is not connected yet and returns a spanning forest.

Equal sets are one node from the start, and regions with the same members are
one region. What is returned is the class of every document, never its pairs.

Defined cases: NULL or empty texts, or texts of white space only, have no
shingles and are alone; texts with fewer words than a shingle are one shingle of
all their words; repeated rows are copies; a NULL ``doc_id`` is a copy or near
copy like others but never names a class unless all of it is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import Scratch, row_pieces
from promoscope.llm.components import connected_components
from promoscope.operators.star import sized_broadcast

WORDS, SIMILARITY = 5, 80         # words in a shingle; per cent
HOT = 64                          # texts in a region from which it counts as hot
LEAF = 8                          # members up to which a region among the heavy texts is compared pair by pair
SLICE = 32                        # outsiders of a cell that one task compares with the members on its border
BLOCK = 512                       # texts on either side of a block comparison
ROUNDS = 2                        # pivots that a region has in turn
_SETS_A_TASK = 2_000              # sets that small cells bring to a task
_COLUMNS = 8_192                  # shingles that a block comparison counts at a time


@dataclass(frozen=True)
class Spec:
    words: int = WORDS
    percent: int = SIMILARITY

    def need(self, n):
        """Fewest shingles that a text of ``n`` shares with any similar text (ints, arrays or columns)."""
        if isinstance(n, Column):
            return F.floor((n * self.percent + 99) / 100).cast("int")
        return (n * self.percent + 99) // 100

    def slack(self, n):
        if isinstance(n, Column):
            return F.least(self.need(n) - 1, F.lit(30) + F.floor(n * 3 / 100).cast("int"))
        return np.minimum(self.need(n) - 1, 30 + n * 3 // 100)

    def window(self, n):
        return n - self.need(n) + 1 + self.slack(n)

    def similar(self, a: Column, b: Column, common: Column) -> Column:
        return common * 100 >= (a + b - common) * self.percent


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; words split at ASCII white space, A-Z in lower case."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, w)), dtype=np.uint64)
    k = min(words, len(w))
    s = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i: len(h) - k + 1 + i]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(s ^ (s >> np.uint64(29)))


def _sets(docs: DataFrame, text: str, spec: Spec, whole: bool) -> DataFrame:
    """Replaces the text by n, the set's 128-bit name (k1, k2), and the boundary window or the whole set."""
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("k1", "k2")]
                          + [T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in row_pieces(big, text):
                sets = [shingles(t, spec.words) for t in batch.column(text).to_pylist()]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                name = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                name = np.frombuffer(b"".join(name), dtype="<i8").reshape(-1, 2)
                take = n if whole else np.where(n > 0, spec.window(n), 0)
                off = np.r_[0, np.cumsum(take)].astype(np.int32)
                keys = np.concatenate([s[:k] for s, k in zip(sets, take)]) if len(sets) else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(n.astype(np.int32)), pa.array(name[:, 0].copy()),
                     pa.array(name[:, 1].copy()), lists], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _whole_sets(base: DataFrame, every: DataFrame, asked: DataFrame, spec: Spec) -> DataFrame:
    """(cid, n, keys) of the texts that ``asked`` names by key and hash; the set's name is compared too, since texts of one
    hash may differ. Rows only leave their task where ``asked`` is large or where ``every`` has such a row repeatedly."""
    named = asked.select("cid", "rep", "rep_hash", F.col("k1").alias("w1"), F.col("k2").alias("w2"))
    named = sized_broadcast(named)
    same = F.col("key_").eqNullSafe(F.col("rep")) & F.col("text_hash").eqNullSafe(F.col("rep_hash"))
    sets = _sets(base.join(named, same).select("cid", "w1", "w2", "text_"), "text_", spec, whole=True)
    sets = sets.filter("k1 = w1 AND k2 = w2").select("cid", "n", "keys")
    repeated = every.join(named, same).count() > asked.count()
    return sets.dropDuplicates(["cid"]) if repeated else sets


def _regions(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, cid, n) -> the same with ``members`` and ``weight``, only for regions of two texts or more; of
    regions with equal members one stays, weighing as many as there were. Members are told by their number, a 64-bit
    hash and their numbers' own sum without carry, which compresses: nearly all rows shuffled here are of one text."""
    keys = rows.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("x1"),
                                   F.bit_xor("cid").alias("x2")).filter("members >= 2")
    one = keys.groupBy("members", "x1", "x2").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    one = scratch.write(one.select("key", "members", "weight"), f"{name}-keys")
    # few keys are in two texts or more: as long as they measure small, the others' rows never leave their task
    return scratch.write(rows.join(sized_broadcast(one), "key"), f"{name}-rows")


def _pairs(rows: DataFrame, spec: Spec) -> DataFrame:
    """Pairs (a, b) of texts that share regions and can be similar by size, with the regions' weight; ``rows``
    has (key, cid, n, weight) in regions of ``HOT`` or ``LEAF`` members at most."""
    a = rows.select("key", "weight", F.col("cid").alias("a"), F.col("n").alias("na"))
    b = rows.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * spec.percent
    return (a.join(b, "key").filter((F.col("a") < F.col("b")) & fits)
            .groupBy("a", "b").agg(F.sum("weight").alias("shared")))


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ...) -> with na, nb and the number of common shingles."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .withColumn("common", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb"))


def _inner_regions(rows: DataFrame, sets: DataFrame, spec: Spec, scratch: Scratch) -> list[DataFrame]:
    """Links that connect all similar texts inside regions of any size. ``rows``: (key, cid, n, members, weight).

    A round gives every region a pivot; regions with the same pivot become one cell. Members near the pivot are
    linked to it and so to each other. Of the others, each needs one partner among them, found by a semi-join in
    which only members within a radius of the nearest outsider take part; what then has no partner is compared
    with the outsiders that have one, and with itself in the next round, or in rings after the last one."""
    pairs = scratch.write(_pairs(rows.filter(F.col("members") <= LEAF), spec).select("a", "b"), "leaf-pairs")
    links = [_forest(pairs, sets, spec, scratch, "leaf")]
    radius = 1 - spec.percent / 100 + 1e-9
    large = rows.filter(F.col("members") > LEAF).select("key", "cid")
    for k in range(ROUNDS):
        large = scratch.write(large, f"inner-{k}")
        rows_now = large.count()
        if not rows_now:
            return links
        # the member in most regions is most like the others
        degree = large.groupBy("cid").agg(F.count("*").alias("deg"))
        pivot = large.join(degree, "cid").groupBy("key").agg(F.max_by("cid", F.struct("deg", -F.col("cid"))).alias("b"))
        cells = large.join(pivot, "key").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
        told = _measure(scratch.write(cells, f"cells-{k}", rows_now), sets)
        told = scratch.write(told.select("a", "b", spec.similar(F.col("na"), F.col("nb"), F.col("common")).alias("near"),
                                         (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far")), f"told-{k}", rows_now, 500)
        links.append(told.filter("near").select("a", "b"))
        outside = told.filter("NOT near")
        edge = outside.groupBy("b").agg(F.min("far").alias("edge"))
        border = told.filter("near").join(edge, "b").filter(F.col("far") >= F.col("edge") - radius)
        tied = _partnered(outside, border, sets, spec, radius, scratch, f"tied-{k}", rows_now)
        alone = scratch.write(outside.join(tied.select("a", "b"), ["a", "b"], "left_anti"), f"alone-{k}", rows_now)
        late = _partnered(alone, tied, sets, spec, radius, scratch, f"late-{k}", rows_now)
        links += [tied.select("a", "b"), late.select("a", "b")]
        size = alone.groupBy("b").agg(F.count("*").alias("members"))
        rest = alone.join(size, "b").select(F.col("b").alias("key"), F.col("a").alias("cid"), "far", "members")
        last = k == ROUNDS - 1
        rest = scratch.write(rest, f"rest-{k}", rows_now)
        links.append(_rings(rest if last else rest.filter(F.col("members") <= BLOCK), sets, spec, scratch, radius, f"rings-{k}"))
        large = rest.filter(F.col("members") > BLOCK).select("key", "cid")
    return links


def _partnered(some: DataFrame, others: DataFrame, sets: DataFrame, spec: Spec, radius: float, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """The rows (a, b, far) of ``some`` with a similar text among ``others`` of the same cell b. A row stops at its
    first partner; by the triangle inequality partners' distances to the pivot differ by the radius at most."""
    parts = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a large cell is cut along ``some``; a slice holds about SLICE rows and meets a copy of the others
    slices = some.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    mine = some.select("a", "b", "far").join(slices, "b").withColumn("slice", F.pmod(F.xxhash64("a"), "slices").cast("int"))
    mine = scratch.write(mine.drop("slices"), f"{name}-mine", rows)
    theirs = (others.select(F.col("a").alias("o"), "b", F.col("far").alias("ofar")).join(slices, "b")
              .select(F.col("b").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), "o", "ofar"))
    theirs = scratch.write(theirs, f"{name}-theirs")
    mine = (mine.join(sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("sa")), "a")
            .repartition(parts, "b", "slice"))
    theirs = (theirs.join(sets.select(F.col("cid").alias("o"), F.col("n").alias("no"), F.col("keys").alias("so")), "o").drop("o")
              .repartition(parts, "cell", "part"))
    fits = ((F.col("b") == F.col("cell")) & (F.col("slice") == F.col("part")) & (F.abs(F.col("far") - F.col("ofar")) <= radius)
            & spec.similar(F.col("na"), F.col("no"), F.size(F.array_intersect("sa", "so"))))
    found = scratch.write(mine.join(theirs, fits, "left_semi").select("a", "b", "far"), name, rows, 500)
    scratch.drop(f"{name}-mine", f"{name}-theirs")
    return found


class _Union:
    """Connected numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(y)] = self.root(x)


def _compare_listed(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect the similar ones of the listed pairs: rows (cid, n, keys, partners)."""
    sets, size = dict(zip(g["cid"], g["keys"])), dict(zip(g["cid"], g["n"]))
    united, out = _Union(), []
    for a, partners in zip(g["cid"], g["partners"]):
        for b in partners:
            if united.root(a) == united.root(b):
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common * 100 >= (size[a] + size[b] - common) * percent:
                united.join(a, b)
                out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _forest(pairs: DataFrame, sets: DataFrame, spec: Spec, scratch: Scratch, name: str) -> DataFrame:
    """Links that connect the similar ones of the pairs (a, b). A pair goes to the cell of its texts' least candidates:
    the pairs of a group of alike texts so fall into one cell, which is a grid of blocks if it is large, and a set is
    sent to a block once for all its pairs there. ``pairs`` is a written table, and so is what is returned; steps are
    written one by one, as the driver holds the plan and the tasks of a whole step."""
    both = pairs.union(pairs.select("b", "a"))
    least = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), f"{name}-least")
    placed = (pairs.join(least.withColumnRenamed("least", "x"), "a")
              .join(least.select(F.col("a").alias("b"), F.col("least").alias("y")), "b"))
    placed = scratch.write(placed, f"{name}-placed")
    scratch.drop(f"{name}-least")
    # how many blocks a cell needs may be estimated: it decides where pairs meet, not which
    size = placed.groupBy("x", "y").agg(F.ceil(F.approx_count_distinct("a") / BLOCK).cast("int").alias("rows"),
                                        F.ceil(F.approx_count_distinct("b") / BLOCK).cast("int").alias("cols"))
    tasks = max(1, pairs.count() // _SETS_A_TASK)
    spread = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.greatest(F.col(n), F.lit(1))).cast("int")
    cell = F.xxhash64("x", "y")
    placed = placed.join(size, ["x", "y"]).select(
        "a", "b", spread("a", "rows").alias("i"), spread("b", "cols").alias("j"),
        F.when((F.col("rows") > 1) | (F.col("cols") > 1), cell).otherwise(F.pmod(cell, F.lit(tasks))).alias("cell"))
    placed = scratch.write(placed, f"{name}-cells")
    scratch.drop(f"{name}-placed")
    members = (placed.select("cell", "i", "j", F.col("a").alias("cid"), F.col("b").alias("partner"))
               .union(placed.select("cell", "i", "j", "b", F.lit(None).cast("long")))
               .groupBy("cell", "i", "j", "cid").agg(F.collect_list("partner").alias("partners")))
    members = scratch.write(members, f"{name}-members")
    percent = spec.percent
    # the sets are far wider than who meets where: as long as that measures small, a set is only sent to its blocks
    links = (sets.join(sized_broadcast(members), "cid").select("cell", "i", "j", "cid", "partners", "n", "keys").groupBy("cell", "i", "j")
             .applyInPandas(lambda g: _compare_listed(g, percent), "a long, b long"))
    links = scratch.write(links, f"{name}-links")
    scratch.drop(f"{name}-cells", f"{name}-members")
    return links


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every two sets of two lists."""
    everything = np.concatenate([*left, *right])
    names, code = np.unique(everything, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    often = np.flatnonzero(np.bincount(code, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    code = place[code]
    out = np.zeros((len(left), len(right)), dtype=np.float32)       # counts under 2^24 are exact
    for low in range(0, len(often), _COLUMNS):
        some = (code >= low) & (code < low + _COLUMNS)
        table = np.zeros((len(left) + len(right), min(_COLUMNS, len(often) - low)), dtype=np.float32)
        table[row[some], code[some] - low] = 1
        out += table[: len(left)] @ table[len(left):].T
    return out


def _compare_rings(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect all similar texts of the blocks in ``g``: rows (key, ring, own, cid, n, keys)."""
    out = []
    for _, block in g.groupby(["key", "ring"], sort=False):
        left, right = block[block["own"]], block[~block["own"]]
        if not len(left) or not len(right):
            continue
        common = _common_counts(list(left["keys"]), list(right["keys"]))
        na, nb = left["n"].to_numpy(np.int64)[:, None], right["n"].to_numpy(np.int64)[None, :]
        a, b = left["cid"].to_numpy(), right["cid"].to_numpy()
        near = common.astype(np.int64) * 100 >= (na + nb - common.astype(np.int64)) * percent
        united = _Union()
        for x, y in zip(*np.nonzero(near)):
            if united.root(int(a[x])) != united.root(int(b[y])):
                united.join(int(a[x]), int(b[y]))
                out.append((a[x], b[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rings(rows: DataFrame, sets: DataFrame, spec: Spec, scratch: Scratch, radius: float, name: str) -> DataFrame:
    """Links that connect all similar texts of each cell. ``rows``: (key, cid, far), ``far`` the distance to the cell's
    pivot. Two texts are only similar if their distances differ by the radius at most, so a text meets those of its own
    ring and of the next; rings of any size are cut into a grid of blocks."""
    ring = F.floor(F.col("far") / radius).cast("int")
    own = scratch.write(rows.select("key", "cid", ring.alias("ring")), f"{name}-texts")
    guests = own.union(own.select("key", "cid", F.col("ring") - 1))        # whom a ring's texts are compared with
    number = lambda df, c: df.groupBy("key", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    size = scratch.write(number(own, "rows").join(number(guests, "cols"), ["key", "ring"]), f"{name}-size")
    tasks = max(1, own.count() // _SETS_A_TASK)
    spread = lambda n: F.pmod(F.xxhash64(F.lit(6), "cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(size, ["key", "ring"]).select("key", "ring", "cid", "rows", "cols", F.lit(True).alias("own"), spread("rows").alias("i"), every("cols").alias("j"))
    right = guests.join(size, ["key", "ring"]).select("key", "ring", "cid", "rows", "cols", F.lit(False).alias("own"), every("rows").alias("i"), spread("cols").alias("j"))
    cell = F.xxhash64("key", "ring")
    both = left.unionByName(right).withColumn("cell", F.when((F.col("rows") > 1) | (F.col("cols") > 1), cell).otherwise(F.pmod(cell, F.lit(tasks))))
    percent = spec.percent
    both = scratch.write(both.select("cell", "i", "j", "key", "ring", "own", "cid"), f"{name}-blocks")
    links = (both.join(sets, "cid").groupBy("cell", "i", "j")
             .applyInPandas(lambda g: _compare_rings(g, percent), "a long, b long"))
    links = scratch.write(links, f"{name}-links")
    scratch.drop(f"{name}-texts", f"{name}-size", f"{name}-blocks")
    return links


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: the key, ``text_hash``, ``n_shingles``, ``group_id`` (of the class; NULL without
    shingles), ``component_id`` (the smallest key reachable by links) and ``n_copies`` (rows with the same set)."""
    spark, spec = docs.sparkSession, Spec(words, percent)
    scratch = Scratch(spark, "ngram-join")
    base = docs.select(F.col(key).alias("key_"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text_"))
    windows = scratch.write(_sets(base, "text_", spec, whole=False), "windows")
    every = scratch.write(windows.drop("keys"), "rows")
    classes = (windows.filter("n > 0").groupBy("k1", "k2", "n")
               .agg(F.min("key_").alias("rep"), F.min_by("text_hash", F.struct(F.col("key_").isNull(), "key_")).alias("rep_hash"),
                    F.count("*").alias("copies"), F.first("keys").alias("keys")))
    named = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "named")
    scratch.drop("windows")
    classes = scratch.write(named.drop("keys"), "classes")
    rows = _regions(named.select(F.explode("keys").alias("key"), "cid", "n"), scratch, "outer")
    scratch.drop("named", "outer-keys")

    # what a text's slack covers, against the hot regions it is in; the smallest similar text has the least slack
    hot = (rows.groupBy("cid", "n").agg(F.sum(F.when(F.col("members") > HOT, F.col("weight")).otherwise(0)).alias("hot")))
    state = hot.select("cid", "n", "hot", (F.col("hot") > spec.slack(spec.need(F.col("n")))).alias("heavy"))
    state = scratch.write(state, "state")
    cold = rows.filter(F.col("members") <= HOT)
    pairs = _pairs(cold, spec)
    of = lambda c: state.select(*(F.col(x).alias(y) for x, y in (("cid", c), ("n", f"n_{c}"), ("hot", f"hot_{c}"))))
    # similar texts share 1 + slack regions, of which at most the smaller hot count is missing here
    enough = (F.least(spec.slack(F.col("n_a")), spec.slack(F.col("n_b"))) + 1 - F.least("hot_a", "hot_b"))
    pairs = (pairs.join(of("a"), "a").join(of("b"), "b")
             .filter(F.col("shared") >= enough).select("a", "b"))
    pairs = scratch.write(pairs, "pairs")
    scratch.drop("outer-rows")
    heavy = state.filter("heavy").select("cid")

    # whole sets, only of the texts that are compared
    asked = (pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(heavy).distinct()
             .join(classes.select("cid", "rep", "rep_hash", "k1", "k2"), "cid"))
    asked = scratch.write(asked, "asked")
    sets = scratch.write(_whole_sets(base, every, asked, spec), "sets")

    links = [_forest(pairs, sets, spec, scratch, "outer")]
    if not heavy.isEmpty():
        # recursion: among the heavy texts, regions by their rarest shingles
        full = scratch.write(sets.join(sized_broadcast(heavy), "cid", "left_semi"), "heavy-sets")
        items = full.select("cid", "n", F.explode("keys").alias("key"))
        often = items.groupBy("key").agg(F.count("*").alias("df"))
        ranked = (items.join(often, "key").groupBy("cid", "n")
                  .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))
                  .select("cid", "n", F.explode(F.slice("order", F.lit(1), F.col("n") - spec.need(F.col("n")) + 1)).alias("o"))
                  .filter("o.df >= 2").select(F.col("o.key").alias("key"), "cid", "n"))
        ranked = scratch.write(ranked, "heavy")
        links += _inner_regions(_regions(ranked, scratch, "inner"), full, spec, scratch)
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)
    parts = connected_components(all_links, scratch)
    scratch.drop("sets", "heavy-sets", "asked", "pairs", "outer-links")

    known = (classes.select("cid", "k1", "k2", "rep", "copies").join(parts.withColumnRenamed("id", "cid"), "cid", "left")
             .withColumn("component", F.coalesce("component", "cid")))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("k1", "k2", F.col("component").alias("group_id"), "component_id", "copies")
    # a set with a third of all rows is a hot key here: a plain join, which Spark can split
    return (every.select("key_", "text_hash", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
            .select(F.col("key_").alias(key), "text_hash", F.col("n").cast("long").alias("n_shingles"), "group_id",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key_")).alias("component_id"),
                    F.coalesce("copies", F.lit(1)).alias("n_copies")))


def one_of_each_class(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the smallest key (NULL last), then the smallest hash of the text.
    Documents without shingles are in no class and all stay."""
    found = near_classes(docs, text, key, words, percent).filter(F.col("group_id").isNotNull())
    first = F.min(F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), F.col("text_hash").alias("hash")))
    stay = found.groupBy("group_id").agg(first.alias("s")).select(F.col("s.key").alias("_k"), F.col("s.hash").alias("_h"))
    has_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    told = docs.filter(has_words).withColumn("_key", F.col(key)).withColumn("_hash", F.xxhash64(text))
    kept = (told.join(stay, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_semi")
            .dropDuplicates(["_key", "_hash"]).drop("_key", "_hash"))
    return kept.union(docs.filter(~has_words))
