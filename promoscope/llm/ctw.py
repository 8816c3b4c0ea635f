"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the
``DEPTH`` bytes before it. A node of a tree estimates its bit from counts with
the Krichevsky-Trofimov rule, and context-tree weighting mixes the estimates of
all depths along a path: a node's weighted probability of the training data is
the mean of its own estimate and the product of its children's, and the share of
its own estimate is its weight in the prediction. The code length of a text is
the sum over its bytes and one closing zero byte.

Counts cover every byte of every training text: tasks count (context, byte)
pairs, Spark adds them up. The tree holds every counted context, at any size of
corpus, and is never gathered: pairs are dealt out by their last three context
bytes, so a task meets whole subtrees of at most 2^16 pairs and weighs them one
after the other; what they hand up is added by Spark, a row per decision node
two bytes deep (at most 2^24 by the alphabet, whatever the input), and weighed
on the driver; with that top broadcast, the subtrees are walked down again and
every pair's log probability is written to a table. Pairs with a share of at
least ``2 ** -SHARE_BITS`` of all training bytes (at most ``2 ** SHARE_BITS``)
are broadcast for scoring; the texts' other pairs, one row a text and pair, meet
the table in a join. Pairs that training never saw walk down the same subtrees
with a count of 0, which gives their exact weighted probability.

The unigram base model counts whole words. Its vocabulary has no bound, so only
words with a share of at least ``2 ** -WORD_BITS`` (at most ``2 ** WORD_BITS``
words) are broadcast; the others' counts meet the texts in the same join, in which no
key is hot for a frequent word or pair, as these never get there.

Defined cases: NULL text is an empty text (only the end is scored); no training
row -> every bit has probability 1/2; repeated rows count and are scored each;
rows are told apart by position, so NULL or repeated keys do no harm; extra
columns pass through ``score`` unless they bear an output name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import Scratch, row_pieces

DEPTH = 4
SHARE_BITS = 22
WORD_BITS = 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: The end of a text as a token; no word holds white space.
END = xxhash.xxh3_64_intdigest(b"\n")


# --- words -------------------------------------------------------------------

def word_counts(text: str | None) -> Counter:
    """Words of a text with A-Z in lower case, split at ASCII white space (bytes' own rules for both)."""
    return Counter((text or "").encode("utf-8", "surrogatepass").lower().split())


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their numbers, and the number of distinct words of each text (the end included)."""
    keys: list[int] = []
    nums: list[int] = []
    size = np.empty(len(texts), dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        c = word_counts(text)
        keys += map(digest, c)
        keys.append(END)
        nums += c.values()
        nums.append(1)
        size[i] = len(c) + 1
    return np.array(keys, dtype=np.uint64), np.array(nums, dtype=np.int64), size


# --- bytes ---------------------------------------------------------------------

def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(context bytes, byte) of every position as one number, and how many positions each text has."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes(DEPTH)
    b = np.frombuffer(b"".join([pad + r + b"\0" for r in raw]), dtype=np.uint8)
    size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), size
    g = b[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        g |= b[DEPTH - k: len(b) - k].astype(np.uint64) << np.uint64(8 * k)
    start = np.cumsum(size + DEPTH) - (size + DEPTH)            # of each text's positions in ``g``
    keep = np.ones(len(g), dtype=bool)
    for k in range(DEPTH):
        at = start[1:] - DEPTH + k
        keep[at] = False
    return g[keep], size


def _add_up(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        s = np.sort(keys)
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        return s[head], np.diff(np.r_[head, len(s)])
    order = np.argsort(keys)
    s = keys[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[head], np.add.reduceat(n[order], head) if len(s) else n


def _times(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order of texts, and how often each occurs."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])]) if len(of) else np.zeros(0, np.int64)
    return of[head], keys[head], np.diff(np.r_[head, len(of)]).astype(np.int64)


class _Sum:
    """Counts of one task, merged as they grow."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.limit = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > max(500_000, 2 * self.limit):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, n = _add_up(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        self.parts, self.size, self.limit = [(k, n)], len(k), len(k)
        return k, n


_COUNTS = "kind int, key long, n long"
WORD, GRAM = 0, 1


def count_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): every word's and every (context, byte) pair's number in the given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Sum(), _Sum()
        for whole in batches:
            for batch in row_pieces(whole, text):
                texts = batch.column(text).to_pylist()
                keys, n, _ = _hashed(texts)
                words.add(*_add_up(keys, n))
                grams.add(*_add_up(_grams(texts)[0]))
                if words.size > 3_000_000:          # a task's memory stays bounded: counts go out in parts
                    yield from _count_batches(WORD, *words.merge())
                    words = _Sum()
                if grams.size > 3_000_000:
                    yield from _count_batches(GRAM, *grams.merge())
                    grams = _Sum()
        yield from _count_batches(WORD, *words.merge())
        yield from _count_batches(GRAM, *grams.merge())

    return docs.select(text).mapInArrow(run, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _count_batches(kind: int, keys: np.ndarray, n: np.ndarray, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keys), rows):
        k = keys[a: a + rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)),
                                          pa.array(n[a: a + rows].astype(np.int64))], names=["kind", "key", "n"])


# --- look-up tables --------------------------------------------------------------

@dataclass
class HashTable:
    """Open addressing over 64-bit keys, filled and asked in bulk."""
    keys: np.ndarray
    at: np.ndarray
    shift: int

    @classmethod
    def build(cls, keys: np.ndarray) -> HashTable:
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        table, at = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, dtype=np.int32)
        slot = ((keys * _MUL) >> np.uint64(64 - bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = table[s] == _EMPTY
            table[s[free]] = keys[todo[free]]           # of several, the last written stays
            done = free & (table[s] == keys[todo])
            at[s[done]] = todo[done]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        return cls(table, at, 64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys in the array that the table was built from, -1 for strangers."""
        slot = ((keys * _MUL) >> np.uint64(self.shift)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        todo = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (got != _EMPTY)]
        return out


# --- the weighted tree -------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series, after raising small arguments."""
    x = x.astype(np.float64)
    low = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        small = z < 8
        low[small] += np.log(z[small])
        z[small] += 1
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + inv / 12 - inv**3 / 360 + inv**5 / 1260 - low


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT probability of a sequence with ``a`` zeros and ``b`` ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - 1.1447298858494002


@dataclass
class ByteModel:
    """A whole tree in memory, for small corpora and as the yardstick of the distributed one. Per depth: the cells (context, byte) of the kept contexts with log10 probabilities, the kept contexts,
    and the decision nodes with what the depths above and at the node contribute to a one (``above``), the
    weight left for the depths below (``left``), and the whole estimate where no deeper context is kept."""
    cells: list[HashTable]
    logp: list[np.ndarray]
    contexts: list[HashTable]
    nodes: list[HashTable]
    above: list[np.ndarray]
    left: list[np.ndarray]
    strange: list[np.ndarray]       # a node's probability of a one for context bytes that are not kept

    @classmethod
    def build(cls, cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> ByteModel:
        """``cells``: for each depth the kept contexts' (context, byte, count)."""
        keys, zeros, ones, back = [], [], [], []
        for ctx, byte, n in cells:
            per_level, bits = [], []
            for j in range(8):
                node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
                per_level.append((ctx << np.uint64(8)) | node)
                bits.append(((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool))
            flat, bit, num = np.concatenate(per_level), np.concatenate(bits), np.tile(n, 8).astype(np.float64)
            u, inv = np.unique(flat, return_inverse=True)
            keys.append(u)
            ones.append(np.bincount(inv, weights=num * bit, minlength=len(u)))
            zeros.append(np.bincount(inv, weights=num * ~bit, minlength=len(u)))
            back.append((inv.reshape(8, -1), np.stack(bits)) if len(ctx) else (np.zeros((8, 0), int), np.zeros((8, 0), bool)))
        depth = len(cells) - 1
        tables = [HashTable.build(k) for k in keys]
        mask = [np.uint64((1 << (8 * d)) - 1) for d in range(depth + 1)]
        parent = [None]
        for d in range(1, depth + 1):
            ctx, node = keys[d] >> np.uint64(8), keys[d] & np.uint64(255)
            parent.append(tables[d - 1].find(((ctx & mask[d - 1]) << np.uint64(8)) | node))
        own = [_log_kt(z, o) for z, o in zip(zeros, ones)]
        weighted = [None] * (depth + 1)
        other: list = [None] * (depth + 1)
        weighted[depth] = own[depth]
        for d in range(depth - 1, -1, -1):
            size = len(keys[d])
            below = np.bincount(parent[d + 1], weights=weighted[d + 1], minlength=size)
            z = zeros[d] - np.bincount(parent[d + 1], weights=zeros[d + 1], minlength=size)
            o = ones[d] - np.bincount(parent[d + 1], weights=ones[d + 1], minlength=size)
            other[d] = (z, o)
            weighted[d] = np.logaddexp(own[d], below + _log_kt(z, o)) - np.log(2.0)
        cells_t, logp, contexts, above, left, strange = [], [], [], [], [], []
        a, b = np.zeros(len(keys[0])), np.ones(len(keys[0]))
        for d in range(depth + 1):
            if d:
                a, b = above[d - 1][parent[d]].astype(np.float64), left[d - 1][parent[d]].astype(np.float64)
            kt = (ones[d] + 0.5) / (ones[d] + zeros[d] + 1.0)
            if d < depth:
                stop = np.exp(own[d] - np.log(2.0) - weighted[d])
                above.append(a + b * stop * kt)
                left.append(b * (1 - stop))
                z, o = other[d]
                p = above[d] + left[d] * (o + 0.5) / (z + o + 1.0)      # the next context byte is none of the kept ones
            else:
                p = a + b * kt
                above.append(p)
                left.append(np.zeros(len(p)))
            strange.append(p)
            inv, bit = back[d]
            logp.append(np.where(bit, np.log10(p[inv]), np.log10(1 - p[inv])).sum(axis=0))
            ctx, byte, _ = cells[d]
            cells_t.append(HashTable.build((ctx << np.uint64(8)) | byte))
            contexts.append(HashTable.build(np.unique(ctx)))
        return cls(cells_t, logp, contexts, tables, above, left, strange)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, byte)."""
        depth = len(self.cells) - 1
        out = np.empty(len(grams))
        at = self.cells[depth].find(grams)
        hit = at >= 0
        out[hit] = self.logp[depth][at[hit]]
        todo = np.flatnonzero(~hit)
        if len(todo):
            u, inv = np.unique(grams[todo], return_inverse=True)
            out[todo] = self._rare(u)[inv]
        return out

    def _rare(self, grams: np.ndarray) -> np.ndarray:
        """The same for pairs without a cell at full depth: the deepest kept context decides, or, where it never
        saw the byte, the decisions one by one."""
        depth = len(self.cells) - 1
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for d in range(depth, -1, -1):
            g = grams[todo] & np.uint64((1 << (8 * d + 8)) - 1)
            if d < depth:
                at = self.cells[d].find(g)
                out[todo[at >= 0]] = self.logp[d][at[at >= 0]]
                todo, g = todo[at < 0], g[at < 0]
            kept = self.contexts[d].find(g >> np.uint64(8)) >= 0
            if kept.any():
                out[todo[kept]] = self._by_decision(grams[todo[kept]], d)
            todo = todo[~kept]
        out[todo] = -8 * np.log10(2.0)              # an empty model
        return out

    def _by_decision(self, grams: np.ndarray, d: int) -> np.ndarray:
        """Contexts kept at depth ``d``, bytes not seen there."""
        byte, total = grams & np.uint64(255), np.zeros(len(grams))
        for j in range(8):
            node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
            one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            p = np.full(len(grams), 0.5)
            todo = np.arange(len(grams))
            for k in range(d, -1, -1):
                ctx = (grams[todo] >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
                at = self.nodes[k].find((ctx << np.uint64(8)) | node[todo])
                seen = at >= 0
                # below, either no context is kept, or a kept one never met this decision and says one half
                p[todo[seen]] = self.strange[k][at[seen]] if k == d else self.above[k][at[seen]] + self.left[k][at[seen]] * 0.5
                todo = todo[~seen]
            total += np.where(one, np.log10(p), np.log10(1 - p))
        return total


# --- the same tree in parts --------------------------------------------------------

@dataclass
class Level:
    """Decision nodes (context, decision) of one depth, what they saw, and log KT and weighted probabilities."""
    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    weighted: np.ndarray

    @classmethod
    def inner(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Level:
        own = _log_kt(zeros, ones)
        return cls(keys, zeros, ones, own, np.logaddexp(own, below) - np.log(2.0))

    def handed_up(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node keys at ``depth``, one less than this level's, with zeros, ones and the sum of the children's
        weighted probabilities, and each child's place among them."""
        u, up = np.unique(_cut(self.keys, depth), return_inverse=True)
        return u, *(np.bincount(up, weights=x, minlength=len(u)) for x in (self.zeros, self.ones, self.weighted)), up

    def down(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What this depth and those above contribute to a one, and the weight left for the depths below, from the
        same of the parents."""
        stop = np.exp(self.own - np.log(2.0) - self.weighted)
        return a + b * stop * (self.ones + 0.5) / (self.ones + self.zeros + 1.0), b * (1 - stop)


def _cut(keys: np.ndarray, depth: int) -> np.ndarray:
    """(context, decision or byte) with only the last ``depth`` bytes of the context."""
    return keys & np.uint64((1 << (8 * depth + 8)) - 1)


def _handed_depth(depth: int) -> int:
    """The deepest depth that the driver weighs (-1: none)."""
    return min(2, depth - 1)


def _subtrees(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels of the subtrees under the driver's depths from their (context, byte) counts, deepest first, each but
    the last level's places in the next, and the decisions of every pair: their places in the deepest level and bits."""
    shift = np.arange(8, dtype=np.uint64)[:, None]
    byte = keys & np.uint64(255)
    flat = (keys & ~np.uint64(255)) | (np.uint64(1) << shift) | (byte >> (np.uint64(8) - shift))
    bit = ((byte >> (np.uint64(7) - shift)) & np.uint64(1)).astype(bool)
    u, inv = np.unique(flat.ravel(), return_inverse=True)
    num = np.tile(n, 8).astype(np.float64)
    ones = np.bincount(inv, weights=num * bit.ravel(), minlength=len(u))
    zeros = np.bincount(inv, weights=num * ~bit.ravel(), minlength=len(u))
    own = _log_kt(zeros, ones)
    levels, ups = [Level(u, zeros, ones, own, own)], []
    for d in range(depth - 1, _handed_depth(depth), -1):
        *node, up = levels[-1].handed_up(d)
        levels.append(Level.inner(*node))
        ups.append(up)
    return levels, ups, inv.reshape(8, -1), bit


@dataclass
class Top:
    """The depths that the driver weighs: per depth the nodes, and what ``Level.down`` says of them."""
    nodes: list[HashTable]
    above: list[np.ndarray]
    left: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, deepest: int) -> Top:
        levels, ups = [Level.inner(keys, zeros, ones, below)], []
        for d in range(deepest - 1, -1, -1):
            *node, up = levels[-1].handed_up(d)
            levels.append(Level.inner(*node))
            ups.append(up)
        top, a, b = cls([], [], []), np.zeros(len(levels[-1].keys)), np.ones(len(levels[-1].keys))
        for level, up in zip(levels[::-1], [*ups[::-1], None]):
            a, b = level.down(a, b)
            top.nodes.append(HashTable.build(level.keys))
            top.above.append(a)
            top.left.append(b)
            if up is not None:
                a, b = a[up], b[up]
        return top

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``above`` and ``left`` of the nodes at the deepest depth that knows them."""
        a, b = np.zeros(len(keys)), np.ones(len(keys))
        todo = np.arange(len(keys))
        for d in range(len(self.nodes) - 1, -1, -1):
            at = self.nodes[d].find(_cut(keys[todo], d))
            seen = at >= 0
            a[todo[seen]], b[todo[seen]] = self.above[d][at[seen]], self.left[d][at[seen]]
            todo = todo[~seen]
        return a, b

    def log10(self, keys: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """log10 probability of every pair of some whole subtrees; pairs with count 0 leave the others' as they are."""
        levels, ups, inv, bit = _subtrees(keys, n, depth)
        a, b = self.find(levels[-1].keys)
        for level, up in zip(levels[:0:-1], ups[::-1]):
            a, b = level.down(a, b)
            a, b = a[up], b[up]
        last = levels[0]
        p = (a + b * (last.ones + 0.5) / (last.ones + last.zeros + 1.0))[inv]
        return np.where(bit, np.log10(p), np.log10(1 - p)).sum(axis=0)


def _group(depth: int) -> Column:
    """The context bytes that name a subtree under the driver's depths."""
    return F.shiftright("key", 8).bitwiseAND((1 << (8 * (_handed_depth(depth) + 1))) - 1)


def _dealt(cells: DataFrame, depth: int) -> DataFrame:
    """(key, n) with every subtree in one task, its rows one after the other."""
    return (cells.select("key", "n", _group(depth).alias("g")).repartition("g").sortWithinPartitions("g", "key"))


def _whole_subtrees(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of some whole subtrees at a time, about ``rows`` of them and at most one subtree more."""
    held, size = [], 0
    for batch in batches:
        held.append(tuple(np.asarray(batch.column(i)) for i in range(3)))
        size += batch.num_rows
        if size < rows:
            continue
        k, n, g = (np.concatenate([h[i] for h in held]) for i in range(3))
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if cut:
            yield k[:cut].astype(np.uint64), n[:cut]
        held, size = [(k[cut:], n[cut:], g[cut:])], len(k) - cut
    if size:
        k, n = (np.concatenate([h[i] for h in held]) for i in range(2))
        yield k.astype(np.uint64), n


def _top(cells: DataFrame, depth: int) -> Top:
    """Weighs the tree from its leaves to the root."""
    deepest = _handed_depth(depth)
    if deepest < 0:
        return Top([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_subtrees(batches):
            key, zeros, ones, below, _ = _subtrees(keys, n, depth)[0][-1].handed_up(deepest)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *map(pa.array, (zeros, ones, below))],
                                             names=["key", "zeros", "ones", "below"])

    nodes = (_dealt(cells, depth).mapInArrow(run, "key long, zeros double, ones double, below double")
             .groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow())
    key, zeros, ones, below = (np.asarray(nodes.column(i).combine_chunks()) for i in range(4))
    order = np.argsort(key)
    return Top.build(key[order].astype(np.uint64), zeros[order], ones[order], below[order], deepest)


def _log_table(cells: DataFrame, shared, depth: int) -> DataFrame:
    """(key, n, logp) of every pair, walking down from the broadcast top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_subtrees(batches):
            logp = shared.value.log10(keys, n, depth)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n), pa.array(logp)], names=["key", "n", "logp"])

    return _dealt(cells, depth).mapInArrow(run, "key long, n long, logp double")


@dataclass
class Frequent:
    """What is broadcast for scoring: the frequent pairs with log probabilities, and the frequent words."""
    cells: HashTable
    logp: np.ndarray
    words: HashTable
    word_n: np.ndarray
    mass: float


@dataclass
class Model:
    frequent: Frequent
    depth: int
    cells: DataFrame            # (key, n) of every counted pair
    logp: DataFrame             # (key, n, logp) of the same
    top: Top
    train_tokens: int


def _column(table: pa.Table, i: int) -> np.ndarray:
    return np.asarray(table.column(i).combine_chunks())


def fit(docs: DataFrame, scratch: Scratch, text: str = "text", share_bits: int = SHARE_BITS,
        word_bits: int = WORD_BITS, depth: int = DEPTH) -> tuple[Model, DataFrame]:
    """Learn from all given rows. Returns the model and the table of all word counts (key, n)."""
    spark = docs.sparkSession
    counts = scratch.write(count_corpus(docs, text), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    cells = counts.filter(F.col("kind") == GRAM).select("key", "n")
    if depth < DEPTH:
        # the low 8 (depth + 1) bits: the byte and its context bytes
        cells = scratch.write(cells.groupBy(F.col("key").bitwiseAND((1 << (8 * depth + 8)) - 1).alias("key")).agg(F.sum("n").alias("n")), "cells")
    row = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(row[0] or 0), int(row[1])
    often = words.filter(F.col("n") * (1 << word_bits) >= total).toArrow()
    top = _top(cells, depth)
    logp = scratch.write(_log_table(cells, spark.sparkContext.broadcast(top), depth), "logp")
    need = -(-int(cells.agg(F.sum("n")).first()[0] or 0) // (1 << share_bits))
    big = logp.filter(F.col("n") >= need).select("key", "logp").toArrow()
    frequent = Frequent(HashTable.build(_column(big, 0).astype(np.uint64)), _column(big, 1),
                        HashTable.build(_column(often, 0).view(np.uint64)), _column(often, 1), total + 0.1 * (distinct + 1))
    return Model(frequent, depth, cells, logp, top, total), words


def _unmet(asked: DataFrame, model: Model) -> DataFrame:
    """(key, logp) of the asked pairs that training never saw."""
    new = asked.join(model.logp, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n"))
    group = _group(model.depth)
    near = model.cells.withColumn("g", group).join(new.select(group.alias("g")).distinct(), "g", "left_semi").select("key", "n")
    shared = asked.sparkSession.sparkContext.broadcast(model.top)
    return _log_table(near.unionByName(new), shared, model.depth).filter("n = 0").select("key", "logp")


def score(docs: DataFrame, model: Model, words: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    new = ("n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    kept = docs.drop(*new)
    shared, depth = docs.sparkSession.sparkContext.broadcast(model.frequent), model.depth
    names = [c for c in kept.columns if c != text]
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField("_row", T.LongType())]
                          + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "_known")]
                          + [T.StructField(c, T.DoubleType()) for c in ("_base", "_sure")]
                          + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("_rare", "_times", "_pairs", "_often")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in row_pieces(whole, text):
                texts = batch.column(text).to_pylist()
                grams, size = _grams(texts)
                grams, of = _cut(grams, depth), np.repeat(np.arange(len(texts)), size)
                at = m.cells.find(grams)
                hit = at >= 0
                lp = np.bincount(of[hit], weights=m.logp[at[hit]], minlength=len(texts)).astype(np.float64)      # of no weights it makes whole numbers
                of, pair, often = _times(of[~hit], grams[~hit])
                keys, n, distinct = _hashed(texts)
                owner = np.repeat(np.arange(len(texts)), distinct)
                place = m.words.find(keys)
                known = place >= 0
                c = np.where(known, m.word_n[place] if len(m.word_n) else 0, 0)
                base = np.bincount(owner, weights=np.where(known, n * np.log10((c + 0.1) / m.mass), 0.0), minlength=len(texts))
                sure = np.bincount(owner, weights=n * known, minlength=len(texts))
                rare = ~known
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(o, minlength=len(texts)))].astype(np.int32)), pa.array(v))
                         for o, v in ((owner[rare], keys[rare].view(np.int64)), (owner[rare], n[rare]), (of, pair.view(np.int64)), (of, often))]
                tokens = np.bincount(owner, weights=n, minlength=len(texts))
                longs = [pa.array(v.astype(np.int64)) for v in (size - 1, tokens, sure)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in names), batch.column("_row"), *longs, pa.array(base), pa.array(lp), *lists],
                    names=[f.name for f in schema.fields])

    rows = scratch.write(kept.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema), "scored")

    def asked(kind: int, key: str, times: str) -> DataFrame:
        return (rows.select("_row", F.explode(F.arrays_zip(F.col(key).alias("k"), F.col(times).alias("t"))).alias("w"))
                .select("_row", F.lit(kind).alias("kind"), F.col("w.k").alias("key"), F.col("w.t").alias("times")))

    pairs = asked(GRAM, "_pairs", "_often")
    unmet = scratch.write(_unmet(pairs.select("key").distinct(), model), "unmet")
    mass = F.lit(model.frequent.mass)
    known = (words.select(F.lit(WORD).alias("kind"), "key", F.log10((F.col("n") + 0.1) / mass).alias("lp"))
             .unionByName(model.logp.select("key", "logp").unionByName(unmet).select(F.lit(GRAM).alias("kind"), "key", F.col("logp").alias("lp"))))
    word = F.col("kind") == WORD
    extra = (asked(WORD, "_rare", "_times").unionByName(pairs).join(known, ["kind", "key"], "left")
             .groupBy("_row").agg(F.sum(F.when(word, F.col("times") * F.coalesce("lp", F.log10(F.lit(0.1) / mass)))).alias("_more"),
                                  F.sum(F.when(word & F.col("lp").isNotNull(), F.col("times"))).alias("_also"),
                                  F.sum(F.when(~word, F.col("times") * F.col("lp"))).alias("_rest")))
    return (rows.drop("_rare", "_times", "_pairs", "_often").join(extra, "_row", "left")
            .withColumn("n_known", F.col("_known") + F.coalesce("_also", F.lit(0)))
            .withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
            .withColumn("base_score", F.col("_base") + F.coalesce("_more", F.lit(0.0)))
            .withColumn("score", F.col("_sure") + F.coalesce("_rest", F.lit(0.0)))
            .withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")))
            .select(*names, *new))
