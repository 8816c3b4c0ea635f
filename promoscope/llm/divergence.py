"""Source divergence audit by count-cell ranking: how far the sources of a language differ in their words.

Terms are runs of letters (ASCII letters and every character beyond ASCII), A-Z in
lower case. Each language keeps the V terms that occur in at least ``MIN_DOCS`` of
its documents. A group is the documents of one language and source; a group, and
each language as a whole, gives every kept term the share
``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))`` with N the sum of its counts, and
two shares differ by ``f = floor((p - q)^2 / (p + q))``. All numbers are whole and
all arithmetic is exact (DECIMAL where a BIGINT could overflow).

*Counts*: tasks count the terms of a bounded run of texts before anything is
shuffled; Spark adds them up per (language, term, source).

*Part ``term``* (a group's terms that it uses more than its language does): a term's
value depends only on its count in the group and its count in the language, so
terms are grouped into cells by these two counts, f is evaluated once a cell, cells
of equal value are merged, and the cells' cumulative multiplicity tells which values
hold the first ``TOP`` ranks. Only the terms of those cells are looked up again and
put in UTF-8 order. Neither the terms nor the cells of a group are ever sorted whole.

*Part ``pair``* (every two sources of a language): f summed over all kept terms. The
terms of a language are dealt into slices of about ``SLICE`` and its sources into
blocks of ``SOURCES``; a task holds the shares of one slice in two blocks as a table
and returns one sum for each two sources. Terms that occur in neither block are
not sent; they are all alike, so their number times their one value is added.

Defined cases: NULL text, language and source count as ''; empty texts have no
terms but their group exists; a language without kept terms gives value 0 for every
pair; each row is a document, repeated ones too; ties are broken by the item's
UTF-8 bytes; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch, row_pieces
from promoscope.operators.star import sized_broadcast

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
SLICE, SOURCES = 4096, 64
ENTRIES = 300_000           # counted (language, source, term) entries after which a task hands them on
PIECE = 1 << 20             # bytes of a long text that are split at a time

#: Letters and bytes beyond ASCII stay, A-Z in lower case; every other byte is a separator.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    at = 0
    while at < len(raw):
        stop = at + PIECE
        part = raw[at:stop].translate(_LETTERS)
        if stop < len(raw):
            cut = part.rfind(b" ") + 1
            if not cut:         # a term longer than a piece: on to its end
                while stop < len(raw) and b" " not in (more := raw[stop:stop + PIECE].translate(_LETTERS)):
                    part, stop = part + more, stop + PIECE
                if stop < len(raw):
                    end = more.index(b" ")
                    part, stop = part + more[:end], stop + end
            else:
                part, stop = part[:cut], at + cut
        yield part.split()
        at = stop


def _counted(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, summed over the task's texts so far."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def hand_on() -> pa.RecordBatch:
        rows = [(g, list(c)) for g, c in n.items()]
        flat = [t for _, ts in rows for t in ts]
        group = [g for g, ts in rows for _ in ts]
        out = pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in group], pa.string()), pa.array([g[1] for g in group], pa.string()),
             pa.array(flat, pa.binary()).cast(pa.string()), pa.array([n[g][t] for g, t in zip(group, flat)], pa.int64()),
             pa.array([docs[g][t] for g, t in zip(group, flat)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()
        return out

    for big in batches:
        for batch in row_pieces(big, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                group, seen = (lang, source), set()
                count = n.setdefault(group, Counter())
                for some in terms(text.encode("utf-8", "surrogatepass")):
                    count.update(some)
                    seen.update(some)
                docs.setdefault(group, Counter()).update(seen)
            if sum(map(len, n.values())) >= entries:
                yield hand_on()
    yield hand_on()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in whole numbers; NULL where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.nullif(wide(total) + wide(kept) * F.lit(2).cast("decimal(1,0)"), F.lit(0).cast("decimal(20,0)"))
    above = (wide(count) + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + _div(above, below)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _differ(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _pair_sums(g: pd.DataFrame, a_block: int) -> pd.DataFrame:
    """Sums of f for every two sources of one slice and two blocks. Rows without a term carry a source's share of a
    term that it does not have."""
    empty = g["term"].isna().to_numpy()
    sid, p = g["sid"].to_numpy(), g["p"].to_numpy()
    order = np.argsort(sid[empty])
    who, unused = sid[empty][order], p[empty][order]
    code, names = pd.factorize(g["term"][~empty])
    shares = np.tile(unused, (len(names), 1))
    shares[code, np.searchsorted(who, sid[~empty])] = p[~empty]
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    block = who // a_block
    a_all, b_all, sums = [], [], []
    for a in np.flatnonzero(block == i):
        b = np.flatnonzero((block == j) & (who > who[a]))
        away = shares[:, [a]] - shares[:, b]
        sums.append((away * away // (shares[:, [a]] + shares[:, b])).sum(axis=0))
        a_all.append(np.full(len(b), who[a]))
        b_all.append(who[b])
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"lang": g["lang"].iloc[0], "a": cat(a_all), "b": cat(b_all), "value": cat(sums), "met": len(names)})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    scratch = Scratch(docs.sparkSession, "divergence")
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    entries = ENTRIES
    counts = (base.mapInArrow(lambda batches: _counted(batches, entries), "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    counts = scratch.write(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_DOCS).drop("docs")
    used = scratch.write(counts.drop("docs").join(kept, ["lang", "term"]), "used")       # (lang, term, source, n, total)
    scratch.drop("counts")

    # one row per group, numbered inside its language
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = used.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    groups = (base.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept", "lang_size")]))
    groups = groups.withColumn("sid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("unused", F.coalesce(_share(F.lit(0), F.col("size"), F.col("kept")), F.lit(1).cast("long")))
    groups = scratch.write(groups, "groups")
    out = _terms(used, groups, scratch).union(_pairs(used, groups, scratch))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _terms(used: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    cells = used.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("many")).join(groups, ["lang", "source"])
    cells = (cells.withColumn("p", _share(F.col("n"), F.col("size"), F.col("kept")))
             .withColumn("q", _share(F.col("total"), F.col("lang_size"), F.col("kept"))).filter("p > q")
             .select("lang", "source", "n", "total", "many", _differ(F.col("p"), F.col("q")).alias("value")))
    cells = scratch.write(cells, "cells")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a value holds one term at least, so the first TOP values are enough to add up
    values = values.withColumn("place", F.row_number().over(falling)).filter(F.col("place") <= TOP)
    before = F.coalesce(F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < TOP).select("lang", "source", "value", "before")
    first = cells.join(values, ["lang", "source", "value"]).drop("many")
    first = sized_broadcast(scratch.write(first, "first-cells"))
    rising = Window.partitionBy("lang", "source", "value").orderBy("term")
    found = (used.join(first, ["lang", "source", "n", "total"])
             .withColumn("among", F.row_number().over(rising)).filter(F.col("among") <= TOP)
             .withColumn("rank", F.col("before") + F.col("among")).filter(F.col("rank") <= TOP))
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(used: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    size = groups.groupBy("lang").agg(F.floor(F.max("sid") / SOURCES).cast("int").alias("last"), F.max("kept").alias("kept"))
    size = size.withColumn("slices", F.ceil(F.col("kept") / SLICE).cast("int")).filter("slices > 0").select("lang", "last", "slices")
    own = F.floor(F.col("sid") / SOURCES).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("last")))
    named = (used.join(groups.select("lang", "source", "sid", "size", "kept"), ["lang", "source"]).join(size, "lang")
             .select("lang", "term", "sid", _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"),
                     F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), own.alias("own"), every.alias("other")))
    blank = (groups.join(size, "lang").select("lang", F.lit(None).cast("string").alias("term"), "sid", F.col("unused").alias("p"),
                                              F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), own.alias("own"), "last")
             .select("lang", "term", "sid", "p", "slice", "own", every.alias("other")))
    rows = named.union(blank).select("lang", "term", "sid", "p", "slice", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    a_block = SOURCES
    sums = (rows.groupBy("lang", "slice", "i", "j").applyInPandas(lambda g: _pair_sums(g, a_block), "lang string, a long, b long, value long, met long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met")))
    sums = scratch.write(sums, "pair-sums")
    # the answer itself has a row for every two sources of a language
    g = groups.select("lang", "source", F.col("sid").alias("sid_g"), F.col("unused").alias("unused_g"), "kept")
    o = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("sid_o"), F.col("unused").alias("unused_o"))
    pairs = (g.join(o, "lang").filter("sid_g <> sid_o").withColumn("a", F.least("sid_g", "sid_o")).withColumn("b", F.greatest("sid_g", "sid_o"))
             .join(sums, ["lang", "a", "b"], "left"))
    unmet = F.col("kept") - F.coalesce("met", F.lit(0))
    value = F.coalesce("value", F.lit(0)) + unmet * _differ(F.col("unused_g"), F.col("unused_o"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(falling))
