"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The piece lattice of a text has an edge for every vocabulary piece that matches
at a position (and a byte edge for a character without a piece). Forward
filtering sums the weights of all paths to each position; backward sampling
draws one segmentation from the exact distribution over paths, going from the
end with one uniform number a piece. The numbers come from a hash of the row
key, the unit and the step, so a row has one segmentation whatever the batch,
the partitioning or the executor.

No piece crosses the start of a word (a space) or a character that is part of no
longer piece, so the lattice falls apart there into units: each distinct unit of
a batch is filtered once, and all its occurrences are sampled together in numpy.
A unit is filtered whole at any length, one step a character. A piece of rank r
weighs ``(r + SHIFT) ** -alpha`` times a constant a piece (Zipf's law; the
vocabulary's own scores are merge ranks, not probabilities).

Decoding joins the pieces' bytes. It is lossless: a literal U+2581 is encoded in
bytes, since the piece character stands for a space.

Defined cases: NULL text -> NULL pieces; empty text -> no pieces; a NULL key is
a key like any other; repeated rows get the same pieces; extra columns pass
through, except one with the name of the output column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import row_pieces


ALPHA, SHIFT, PIECE_COST = 1.0, 10.0, 2.4
SPACE, LITERAL = 0x2581, 0x110000            # the space's sign; a stand-in for a literal U+2581
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 20
_CHARS = 1 << 18                              # characters (or ids, in decoding) that a task handles at once
_CACHE_NODES = 600_000                      # lattice positions a task keeps between batches


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash's multiplier and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _MUL)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)


_POWERS = _Powers()


def _prefix(cp: np.ndarray) -> np.ndarray:
    _POWERS.to(len(cp) + 1)
    out = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(_mix(cp.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(cp)], out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * _POWERS.down[start] + (end - start).astype(np.uint64))


@dataclass
class Vocabulary:
    """What the lattice needs of a model: plain pieces, their weights, and the bytes of every id."""
    pieces: list[str]
    byte_ids: np.ndarray            # id of each byte's piece
    plain: np.ndarray               # ids that may be edges
    alpha: float = ALPHA
    _ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        at = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
        byte_ids = np.array([at[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int32)
        plain = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
                          and chr(SPACE) not in pieces[i].lstrip(chr(SPACE))], dtype=np.int32)
        return cls(pieces, byte_ids, plain, alpha)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def tables(self) -> dict:
        if not self._ready:
            text = [self.pieces[i] for i in self.plain]
            size = np.array([len(t) for t in text])
            cp = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32)
            end = np.cumsum(size)
            h = _span_hash(_prefix(cp), end - size, end)
            order = np.argsort(h)
            mask = np.zeros(1 << _FILTER_BITS, dtype=bool)
            mask[h >> np.uint64(64 - _FILTER_BITS)] = True
            joined = np.zeros(LITERAL + 1, dtype=bool)        # characters of longer pieces
            joined[cp[np.repeat(size, size) > 1]] = True
            single = np.zeros(LITERAL + 1, dtype=bool)        # characters that are pieces
            single[cp[np.repeat(size, size) == 1]] = True
            rank = np.arange(len(self.plain), dtype=np.float64)
            weight = -(self.alpha * np.log(rank + SHIFT) + PIECE_COST)
            raw = [b""] * len(self.pieces)
            for i in self.plain:
                raw[i] = self.pieces[i].replace(chr(SPACE), " ").encode()
            for b, i in enumerate(self.byte_ids):
                raw[i] = bytes([b])
            size_b = np.array([len(r) for r in raw])
            self._ready.update(hash=h[order], id=self.plain[order], weight=weight[order], mask=mask, longest=int(size.max()),
                               joined=joined, single=single, byte_weight=-(self.alpha * np.log(len(rank) + SHIFT) + PIECE_COST),
                               flat=np.frombuffer(b"".join(raw), dtype=np.uint8), flat_at=np.cumsum(size_b) - size_b, flat_size=size_b)
        return self._ready


class Lattices:
    """Filtered lattices of distinct units: per position the incoming edges with their probabilities.

    Edge ids below 2^24 are piece ids; above, 2^24 plus a character that goes out as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.t = vocabulary, vocabulary.tables()
        self.clear()

    def clear(self) -> None:
        self.known = pd.Series(dtype=np.int64, index=pd.Index([], dtype=np.uint64))   # unit hash -> last position
        self.first = np.zeros(1, np.int64)          # a position's first edge; positions are consecutive
        self.last = np.zeros(1, np.int64)
        self.edge_id = np.zeros(0, np.int32)
        self.edge_back = np.zeros(0, np.int32)      # characters covered
        self.edge_cum = np.zeros(0, np.float64)

    def ends(self, hashes: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The last lattice position of every unit (given by hash and extent), adding the lattices not yet known."""
        if len(self.first) > _CACHE_NODES:
            self.clear()
        codes, distinct = pd.factorize(hashes)
        at = self.known.index.get_indexer(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            where = np.empty(len(distinct), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]       # first occurrence
            s, e = start[where[new]], end[where[new]]
            ends = self._add(cp, s, e)
            self.known = pd.concat([self.known, pd.Series(ends, index=pd.Index(distinct[new]))])
            at = self.known.index.get_indexer(distinct)
        return self.known.to_numpy()[at][codes]

    def _add(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        t, size = self.t, end - start
        total = int(size.sum())
        off = np.cumsum(size) - size
        text = cp[np.repeat(start - off, size) + np.arange(total)]
        unit_end = np.repeat(off + size, size)
        prefix = _prefix(text)
        from_, ids, backs, weights = [], [], [], []
        for n in range(1, t["longest"] + 1):
            i = np.flatnonzero(np.arange(total) + n <= unit_end)
            if not len(i):
                break
            h = _span_hash(prefix, i, i + n)
            ok = t["mask"][h >> np.uint64(64 - _FILTER_BITS)]
            i, h = i[ok], h[ok]
            k = np.minimum(np.searchsorted(t["hash"], h), len(t["hash"]) - 1)
            ok = t["hash"][k] == h
            i, k = i[ok], k[ok]
            from_.append(i)
            ids.append(t["id"][k])
            backs.append(np.full(len(i), n, dtype=np.int32))
            weights.append(t["weight"][k])
        bare = np.flatnonzero(~t["single"][text])
        if len(bare):
            c = text[bare]
            real = np.where(c == LITERAL, SPACE, c)
            n_bytes = 1 + (real >= 0x80).astype(int) + (real >= 0x800) + (real >= 0x10000)
            one = n_bytes == 1
            from_.append(bare)
            ids.append(np.where(one, self.vocabulary.byte_ids[np.where(one, real, 0)], (1 << 24) + real.astype(np.int64)).astype(np.int32))
            backs.append(np.ones(len(bare), dtype=np.int32))
            weights.append(n_bytes * t["byte_weight"])
        i, ids_, back, w = np.concatenate(from_), np.concatenate(ids), np.concatenate(backs), np.concatenate(weights)
        # positions of a unit: its start and one behind each character
        unit = np.repeat(np.arange(len(size)), size)[i]
        node_base = off + np.arange(len(size))
        src = i + unit
        dst = src + back
        depth = dst - node_base[unit]
        order = np.lexsort((-back, dst, depth))
        src, dst, back, w, ids_, depth = src[order], dst[order], back[order], w[order], ids_[order], depth[order]
        n_nodes = total + len(size)
        alpha = np.full(n_nodes, -np.inf)
        alpha[node_base] = 0.0
        cum = np.empty(len(src))
        bounds = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(src) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:]):
            d = dst[a:b]
            head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            count = np.diff(np.r_[head, b - a])
            v = alpha[src[a:b]] + w[a:b]
            top = np.maximum.reduceat(v, head)
            p = np.exp(v - np.repeat(top, count))
            s = np.add.reduceat(p, head)
            alpha[d[head]] = top + np.log(s)
            p /= np.repeat(s, count)
            c = np.cumsum(p)
            cum[a:b] = c - np.repeat(np.r_[0.0, c[head[1:] - 1]], count)
        by_node = np.argsort(dst, kind="stable")
        base_node, base_edge = len(self.first), len(self.edge_id)
        n_in = np.bincount(dst, minlength=n_nodes)
        first = base_edge + np.cumsum(n_in) - n_in
        self.first = np.concatenate([self.first, first])
        self.last = np.concatenate([self.last, first + n_in - 1])
        self.edge_id = np.concatenate([self.edge_id, ids_[by_node]])
        self.edge_back = np.concatenate([self.edge_back, back[by_node]])
        self.edge_cum = np.concatenate([self.edge_cum, cum[by_node]])
        return base_node + node_base + size

    def sample(self, end: np.ndarray, size: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation for every unit occurrence: ids (flat, in text order) and their number per occurrence."""
        n = len(end)
        node, left = end.copy(), size.astype(np.int64).copy()
        active = np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(n, dtype=np.int64)
        step = 0
        while len(active):
            salt = np.uint64((step + 1) * int(_MUL) & 0xFFFFFFFFFFFFFFFF)
            u = (_mix(seed[active] + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e, stop = self.first[node[active]], self.last[node[active]]
            on = np.flatnonzero((e < stop) & (u >= self.edge_cum[e]))
            while len(on):
                e[on] += 1
                on = on[(e[on] < stop[on]) & (u[on] >= self.edge_cum[e[on]])]
            got = self.edge_id[e]
            steps.append((active, got))
            wide = got >= 1 << 24
            add = np.ones(len(active), dtype=np.int64)
            if wide.any():
                c = got[wide] - (1 << 24)
                add[wide] = 2 + (c >= 0x800) + (c >= 0x10000)
            count[active] += add
            back = self.edge_back[e]
            node[active] -= back
            left[active] -= back
            active = active[left[active] > 0]
            step += 1
        at = np.cumsum(count)
        out = np.empty(int(count.sum()), dtype=np.int32)
        for who, got in steps:
            wide = np.flatnonzero(got >= 1 << 24)
            plain = np.flatnonzero(got < 1 << 24) if len(wide) else slice(None)
            w = who[plain]
            at[w] -= 1
            out[at[w]] = got[plain]
            for k in wide:
                b = self.vocabulary.byte_ids[list(chr(int(got[k]) - (1 << 24)).encode("utf-8", "surrogatepass"))]
                at[who[k]] -= len(b)
                out[at[who[k]]: at[who[k]] + len(b)] = b
        return out, count


def encode_texts(lattices: Lattices, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the number of ids of each text."""
    t = lattices.t
    raw = np.frombuffer("".join([" " + s if s else "" for s in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(s) + 1 if s else 0 for s in texts], dtype=np.int64)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cp = np.where(raw == SPACE, np.uint32(LITERAL), np.where(raw == 32, np.uint32(SPACE), raw))
    text_at = np.cumsum(size) - size
    blank, solo = cp == SPACE, ~t["joined"][cp]
    cut = np.zeros(len(cp) + 1, dtype=bool)
    cut[1:-1] = (blank[1:] & ~blank[:-1]) | solo[1:] | solo[:-1]
    cut[text_at[size > 0]] = True
    cut[-1] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    doc = np.searchsorted(text_at + size, start, side="right")
    first_unit = np.searchsorted(start, text_at)
    nth = (np.arange(len(start)) - first_unit[doc]).astype(np.uint64)
    seed = _mix(seeds[doc] + nth * np.uint64(0xD1342543DE82EF95))
    last = lattices.ends(_span_hash(_prefix(cp), start, end), cp, start, end)
    ids, count = lattices.sample(last, end - start, seed)
    return ids, np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str | Column = "doc_id", seed: int = 1,
           out: str = "pieces", verify: str | None = None) -> DataFrame:
    """Adds the sampled piece ids of each text as an array. ``verify`` names a column that says whether the ids
    decode to the text, told in the same task (true for NULL text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)        # the vocabulary: its size is the model's
    key = F.col(key) if isinstance(key, str) else key
    kept = docs.drop(out).withColumn("_seed", F.xxhash64(F.lit(seed), key.cast("string")))
    names = [c for c in kept.columns if c != "_seed"]
    names = [c for c in names if c != verify]
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField(out, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(verify, T.BooleanType())] if verify else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        for whole in batches:
            for batch in row_pieces(whole, text, _CHARS):
                raw = batch.column(text).to_pylist()
                seeds = batch.column("_seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, count = encode_texts(lattices, [s or "" for s in raw], seeds)
                off = np.r_[0, np.cumsum(count)].astype(np.int32)
                null = np.array([s is None for s in raw], dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(off, mask=np.r_[null, False]) if null.any() else pa.array(off), pa.array(ids))
                more = [lists]
                if verify:
                    flat, size = decode_ids(shared.value, ids, count)
                    ends, flat = np.cumsum(size), flat.tobytes()
                    more.append(pa.array([flat[e - n: e] == (s or "").encode("utf-8", "surrogatepass")
                                          for e, n, s in zip(ends, size, raw)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and each text's number of bytes, the first space of each left out."""
    t = vocabulary.tables()
    size = t["flat_size"][ids]
    total = int(size.sum())
    ends = np.cumsum(size)
    flat = t["flat"][np.repeat(t["flat_at"][ids] - (ends - size), size) + np.arange(total)]
    stop = np.r_[0, ends][np.cumsum(count)]
    n = np.diff(np.r_[0, stop])
    keep = np.ones(total, dtype=bool)
    keep[(stop - n)[n > 0]] = False
    return flat[keep], np.maximum(n - 1, 0)


def decode(df: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of piece ids (NULL for NULL)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = df.drop(out)
    schema = T.StructType(kept.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _id_pieces(whole, pieces):
                lists = batch.column(pieces)
                null = np.array(lists.is_null(), dtype=bool)
                off = np.asarray(lists.offsets)
                ids = np.asarray(lists.values)[off[0]: off[-1]]
                flat, size = decode_ids(shared.value, ids, np.diff(off))
                ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
                text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends), pa.py_buffer(flat), valid)
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def _id_pieces(batch: pa.RecordBatch, pieces: str) -> Iterator[pa.RecordBatch]:
    """The rows in turn, about ``_CHARS`` ids at a time (one long array stays whole)."""
    off = np.asarray(batch.column(pieces).offsets)
    if batch.num_rows:
        owner = (off[1:].astype(np.int64) - off[0]) // _CHARS
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)
