"""Benchmark decontamination: q-gram lemma filter and banded alignment.

A benchmark item is contaminated into a document when a window of the item
(``window`` characters, or the whole item when it is shorter) occurs in the
document within an edit budget of ``rate`` times the window's length. By the
q-gram lemma, such an occurrence shares at least ``m + 1 - q * (e + 1)`` of the
window's q-grams with the document, all on diagonals (document position minus
item position) that differ by ``e`` at most. So:

1. hash every q-gram of every whole text and keep the ones the items hold;
2. count them per item in overlapping diagonal bands, each ``2 * (e + 1)`` wide
   and ``e + 1`` apart, so that one band holds all of an occurrence's diagonals;
3. in regions that reach the bound, every window of the item (at any offset)
   that holds enough of the region's q-grams for the lemma is verified: verbatim
   ones by comparing characters along a diagonal, the others by a banded
   semi-global alignment, which gives the exact number of edits.

Texts are compared lower-cased, with runs of white space as one space; spans
refer to the original characters. The items travel in blocks of at most
``block_chars`` characters, one at a time, so what is broadcast has a fixed bound. One
block is one narrow pass over the documents and nothing is shuffled; with more, each
pass leaves the matches of the texts that have any, and these are joined to the
documents by the text's hash at the end. A task goes through the hits of common
q-grams ``HITS`` at a time, so repetitive texts need no more memory than others.

Defined cases: NULL or empty text -> no match; NULL items and items shorter
than ``min_chars`` are evidence of nothing and never match; repeated item ids
or texts match each on their own (repeated rows of one id and text once); an
empty benchmark leaves every document without a match; extra columns pass
through, except one named ``matches``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import Scratch, row_pieces
from promoscope.operators.star import sized_broadcast

WINDOW, RATE, Q, MIN_CHARS, BLOCK_CHARS = 100, 0.08, 10, 24, 4_000_000
HITS = 500_000              # equal q-grams of texts and items that a task looks at together
_SLICE = 1 << 20        # characters hashed at once
_FILTER_BITS = 22

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())])

_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower case of each character (where that is one character), white space and NUL as a space."""
    global _FOLD
    if _FOLD is None:
        fold = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            s = chr(c)
            if s.isspace() or c == 0:
                fold[c] = 32
            elif len(s.lower()) == 1:
                fold[c] = ord(s.lower())
        _FOLD = fold
    return _FOLD


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, and the original position of each."""
    cp = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = cp == 32
    keep = np.flatnonzero(~(space & np.r_[True, space[:-1]]))
    return cp[keep], keep


def _grams(cp: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, by doubling."""
    k = np.uint64(0x9E3779B97F4A7C15)
    have: dict[int, np.ndarray] = {1: (cp.astype(np.uint64) + np.uint64(1)) * k}
    n = 1
    while 2 * n <= q:
        h = have[n]
        have[2 * n] = (h[: len(h) - n] * np.uint64(0xBF58476D1CE4E5B9)) + (h[n:] ^ (h[n:] >> np.uint64(31)))
        n *= 2
    out, done = have[n], n
    for m in sorted(have, reverse=True):
        while done + m <= q:
            tail = have[m][done:]
            size = len(cp) - done - m + 1
            out = out[:size] * np.uint64(0x94D049BB133111EB) + (tail[:size] ^ (tail[:size] >> np.uint64(29)))
            done += m
    return out


@dataclass
class ItemIndex:
    """One block of items: their windows and the positions of their q-grams."""
    ids: np.ndarray
    texts: list[np.ndarray]
    q: int
    window: int
    rate: float
    grams: np.ndarray           # sorted distinct hashes
    first: np.ndarray           # where a hash's places begin in ``item`` and ``at``
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray
    edits: np.ndarray           # edit budget of each item's windows
    need: np.ndarray            # shared q-grams that the lemma asks for

    @classmethod
    def build(cls, items: list[tuple[int, str]], q: int, window: int, rate: float, min_chars: int) -> ItemIndex:
        ids, texts = [], []
        for i, text in sorted(set(items)):
            cp, _ = normalise(text)
            if len(cp) and cp[-1] == 32:
                cp = cp[:-1]
            if len(cp) >= max(min_chars, q):
                ids.append(i)
                texts.append(cp)
        size = np.array([min(len(t), window) for t in texts], dtype=np.int64)
        edits = np.minimum((size * rate).astype(np.int64), np.maximum(0, (size - q) // q))
        need = size + 1 - q * (edits + 1)
        g = [_grams(t, q) for t in texts]
        h = np.concatenate(g) if g else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        mask = np.zeros(1 << _FILTER_BITS, dtype=bool)
        mask[grams >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(np.array(ids, dtype=np.int64), texts, q, window, rate, grams, np.r_[first, len(h)],
                   item[order], at[order], mask, edits, need)

    @property
    def longest(self) -> int:
        return max(len(t) for t in self.texts)

    def found(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions in ``cp`` whose q-gram the items hold, and the q-grams' numbers."""
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, max(0, len(cp) - self.q + 1), _SLICE):
            h = _grams(cp[lo: lo + _SLICE + self.q - 1], self.q)
            p = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            k = np.searchsorted(self.grams, h[p])
            ok = self.grams[np.minimum(k, len(self.grams) - 1)] == h[p]
            where.append(p[ok] + lo)
            which.append(k[ok])
        return np.concatenate(where), np.concatenate(which)

    def hits(self, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (position, item, position in the item) with equal q-grams."""
        n = self.first[k + 1] - self.first[k]
        place = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(p, n), self.item[place], self.at[place]

    def _regions(self, p: np.ndarray, k: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(document, item, band, places in the item, diagonals) of every region that holds enough q-grams. Hits are
        gone through some at a time and only counted; a region's own are looked up again."""
        n = self.first[k + 1] - self.first[k]
        ends = np.cumsum(n)
        keys, counts, done = [], [], 0
        bands = (int(starts[-1]) + 2 * self.longest) + 2
        while done < len(p):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
            pos, item, at = self.hits(p[done:stop], k[done:stop])
            doc = np.searchsorted(starts, pos, side="right") - 1
            # each hit lies in band ``band`` and in the one before, which overlaps it (numbered from 0 on)
            band = (pos - starts[doc] - at + self.longest) // (self.edits[item] + 1) + 1
            key = (doc * len(self.ids) + item) * bands + band
            u, c = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys.append(u)
            counts.append(c)
            done = stop
        if not keys:
            return
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(u), dtype=np.int64)
        np.add.at(count, back, np.concatenate(counts))
        of = u // bands % len(self.ids)
        enough = count >= self.need[of]
        for key in u[enough].tolist():
            d, i, band = key // bands // len(self.ids), key // bands % len(self.ids), key % bands - 1
            width = int(self.edits[i]) + 1
            low = band * width - self.longest                    # diagonals low .. low + 2 * width - 1
            a, b = np.searchsorted(p, [starts[d] + low, starts[d] + low + 2 * width + len(self.texts[i])])
            a = max(a, int(np.searchsorted(p, starts[d])))
            b = min(b, int(np.searchsorted(p, starts[d + 1])))
            at, diagonal = [], []
            some = k[a:b]
            for gram in np.unique(some).tolist():
                x, y = self.first[gram], self.first[gram + 1]
                x, y = x + np.searchsorted(self.item[x:y], [i, i + 1])
                here = p[a:b][some == gram] - starts[d]
                g = (here[:, None] - self.at[x:y][None, :]).ravel()
                inside = (g >= low) & (g < low + 2 * width)
                diagonal.append(g[inside])
                at.append(np.broadcast_to(self.at[x:y], (len(here), y - x)).ravel()[inside])
            yield d, i, band, np.concatenate(at), np.concatenate(diagonal)

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item id, start, end, fewest edits), overlapping windows of an item joined."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not len(self.ids):
            return out
        norm = [normalise(t) for t in texts]
        gap = np.zeros(1, dtype=np.uint32)          # a character that no folded text holds
        starts = np.cumsum([0] + [len(cp) + 1 for cp, _ in norm])
        cp = np.concatenate([x for c, _ in norm for x in (c, gap)]) if norm else gap
        spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        jobs: list[tuple] = []

        def align() -> None:
            for (d, i, *_), got in zip(jobs, self._align(jobs, norm) if jobs else []):
                if got is not None:
                    spans.setdefault((d, i), []).append(got)
            jobs.clear()

        for d, i, b, at, diagonal in self._regions(*self.found(cp), starts):
            width = int(self.edits[i]) + 1
            m = min(len(self.texts[i]), self.window)
            same, offs = self._windows(i, m, at, diagonal, norm[d][0])
            spans.setdefault((d, i), []).extend(same)
            for o in offs:
                jobs.append((d, i, o, m, b * width - self.longest, 2 * width))
                if len(jobs) == 2000:
                    align()
        align()
        for (d, i), found_spans in sorted(spans.items()):
            if not found_spans:
                continue
            back, merged = norm[d][1], []
            for a, b, e in sorted(set(found_spans)):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), min(e, merged[-1][2]))
                else:
                    merged.append((a, b, e))
            out[d] += [(int(self.ids[i]), int(back[a]), int(back[b - 1]) + 1, e) for a, b, e in merged]
        return out

    def _windows(self, i: int, m: int, at: np.ndarray, diagonal: np.ndarray,
                 doc: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int]]:
        """Of the windows that the region's hits allow by the lemma: the spans of the verbatim ones, and the
        offsets of the others."""
        text, grams = self.texts[i], m - self.q + 1

        def held(places: np.ndarray) -> np.ndarray:
            """How many of each window's q-grams begin at one of the places."""
            mark = np.zeros(len(text) - self.q + 1, dtype=np.int64)
            mark[places] = 1
            total = np.r_[0, np.cumsum(mark)]
            return total[grams:] - total[:-grams]

        todo = held(at) >= self.need[i]
        spans = []
        each, n = np.unique(diagonal, return_counts=True)
        for g in each[n >= grams].tolist():
            if not todo.any():
                break
            ok = np.flatnonzero(todo & (held(at[diagonal == g]) == grams))
            for run in np.split(ok, np.flatnonzero(np.diff(ok) > 1) + 1) if len(ok) else []:
                a, b = int(run[0]), int(run[-1]) + m                         # windows at neighbouring offsets overlap
                if (text[a:b] == doc[a + g: b + g]).all():                   # equal hashes may still differ
                    todo[run] = False
                    spans.append((a + g, b + g, 0))
                    continue
                for o in run.tolist():
                    if (text[o: o + m] == doc[o + g: o + g + m]).all():
                        todo[o] = False
                        spans.append((o + g, o + g + m, 0))
        return spans, np.flatnonzero(todo).tolist()

    def _align(self, jobs: list[tuple], norm: list) -> list[tuple[int, int, int] | None]:
        """Banded semi-global alignment of each job's window: (start, end, edits) in the folded text if within budget."""
        m_max = max(j[3] for j in jobs)
        w_max = max(j[5] for j in jobs) + 1
        n = len(jobs)
        pat = np.full((n, m_max), 0xFFFFFFFF, dtype=np.uint32)
        doc = np.full((n, m_max + w_max), 0xFFFFFFFE, dtype=np.uint32)
        base = np.zeros(n, dtype=np.int64)
        size = np.array([j[3] for j in jobs])
        for r, (d, i, o, m, low, _) in enumerate(jobs):
            pat[r, :m] = self.texts[i][o: o + m]
            base[r] = low + o                                   # document position under column 0 of row 0
            lo, hi = max(0, base[r]), min(len(norm[d][0]), base[r] + m_max + w_max)
            if hi > lo:
                doc[r, lo - base[r]: hi - base[r]] = norm[d][0][lo:hi]
        width = np.array([j[5] for j in jobs])
        far = 1 << 20
        cols = np.arange(w_max)
        # cell (row, c): the pattern's first ``row`` characters end before document position base + row + c
        cost = np.where(cols[None, :] <= width[:, None], 0, far).astype(np.int64)
        start = np.broadcast_to(cols, (n, w_max)).copy()        # column where the alignment began
        last_cost, last_start = cost.copy(), start.copy()
        for row in range(m_max):
            differs = pat[:, row: row + 1] != doc[:, row: row + w_max]
            best, origin = cost + differs, start.copy()
            up = np.concatenate([cost[:, 1:], np.full((n, 1), far)], axis=1) + 1     # pattern character without partner
            upo = np.concatenate([start[:, 1:], start[:, -1:]], axis=1)
            take = up < best
            best, origin = np.where(take, up, best), np.where(take, upo, origin)
            # document characters without partner run along the row
            shifted = best - cols
            low = np.minimum.accumulate(shifted, axis=1)
            src = np.maximum.accumulate(np.where(shifted == low, cols, 0), axis=1)
            cost = low + cols
            start = np.take_along_axis(origin, src, axis=1)
            cost = np.where(cols[None, :] <= width[:, None], cost, far)
            end = size == row + 1
            if end.any():
                last_cost[end], last_start[end] = cost[end], start[end]
        best = last_cost.argmin(axis=1)
        out: list[tuple[int, int, int] | None] = []
        for r, (d, i, o, m, low, _) in enumerate(jobs):
            e = int(last_cost[r, best[r]])
            a, b = int(base[r] + last_start[r, best[r]]), int(base[r] + m + best[r])
            a, b = max(0, a), min(len(norm[d][0]), b)
            out.append((a, b, e) if e <= self.edits[i] and b > a else None)
        return out


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
             window: int = WINDOW, rate: float = RATE, q: int = Q, min_chars: int = MIN_CHARS,
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds ``matches``: an array of (item_id, start, end, edits), empty for a clean document."""
    spark = docs.sparkSession
    known = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).dropna()
    total = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    none = F.array().cast(T.ArrayType(MATCH))

    def block(b: int):
        part = known.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).distinct()
        return spark.sparkContext.broadcast(ItemIndex.build([(r[0], r[1]) for r in part.collect()], q, window, rate, min_chars))

    docs = docs.drop("matches")
    if blocks == 1:
        return _pass(docs.withColumn("matches", none), block(0), text)
    # what a text matches depends on the text alone: one block after the other leaves its matches, and is gone
    scratch = Scratch(spark, "decontam")
    name = [F.xxhash64(F.lit(k), F.col(text)).alias(f"_h{k}") for k in (1, 2)]
    parts = []
    for b in range(blocks):
        shared = block(b)
        hit = _pass(docs.select(*name, F.col(text).alias("_text"), none.alias("matches")), shared, "_text").filter(F.size("matches") > 0)
        parts.append(scratch.write(hit.select("_h1", "_h2", "matches").dropDuplicates(["_h1", "_h2"]), f"block-{b}"))
        shared.destroy()
    every = reduce(DataFrame.union, parts).groupBy("_h1", "_h2").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    every = scratch.write(every, "matches")
    met = docs.select("*", *name).join(sized_broadcast(every), ["_h1", "_h2"], "left")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("matches", none).alias("matches"))


def _pass(docs: DataFrame, shared, text: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_pieces(whole, text):
                got = shared.value.matches([t or "" for t in batch.column(text).to_pylist()])
                had = batch.column("matches")
                if any(got):
                    rows = [(old or []) + [dict(zip(("item_id", "start", "end", "edits"), m)) for m in new]
                            for old, new in zip(had.to_pylist(), got)]
                    had = pa.array(rows, had.type)
                yield pa.RecordBatch.from_arrays([had if c == "matches" else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)
