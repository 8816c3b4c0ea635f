"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``text_statistics`` turns each whole text into a few ratios (letter case,
   symbols, repeated words and lines, word and line lengths).
2. Shallow regression trees, boosted on the labelled sample, propose rules:
   every path from a root to a node is a conjunction of threshold tests.
3. Lasso-penalised logistic regression (proximal gradient) weighs the rules;
   most weights become zero. The penalty is chosen on held-back sample rows.
4. The surviving rules are compiled into one Spark column expression, so scoring
   is a projection over the statistics.

Defined cases: NULL text counts as empty; empty texts get statistics of 0 and a
score from them; rows without a label are never learnt from; several label rows
of one key are averaged; no labelled row at all -> score 0.5, only one class ->
that class's smoothed share; extra columns pass through unless an output column
has the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import crc_remainder

SAMPLE_ROWS = 6000          # labelled rows that are learnt from, at most
STATS = ("n_bytes", "n_words", "word_len", "upper", "digit", "punct", "symbol", "non_ascii", "space",
         "word_end_symbol", "distinct_words", "repeated_next", "top_word", "n_lines", "line_len", "distinct_lines",
         "letter_words", "stop_marks")

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(range(65, 91))] = 1                                  # upper case
_CLASS[list(range(97, 123))] = 2                                 # lower case
_CLASS[list(range(48, 58))] = 3                                  # digits
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4                     # punctuation of prose
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5           # other symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7


def statistics_of(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    m = len(words)
    if not m:
        return [float(n)] + [0.0] * (len(STATS) - 1)
    cls = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    count = np.bincount(cls, minlength=8)
    body = max(1, n - count[6])
    lines = [x for x in raw.split(b"\n") if x]
    ends = _CLASS[np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)]
    heads = _CLASS[np.frombuffer(b"".join([w[:1] for w in words]), dtype=np.uint8)]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [float(n), float(m), body / m, count[1] / body, count[3] / body, count[4] / body, count[5] / body,
            count[7] / body, count[6] / n, float(np.count_nonzero(ends == 5)) / m, len(seen) / m,
            sum(map(eq, words, words[1:])) / m, max(seen.values()) / m, float(len(lines)), n / len(lines),
            len(set(lines)) / len(lines), float(np.count_nonzero((heads == 1) | (heads == 2) | (heads == 7))) / m,
            (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / m]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``STATS``; the text itself is dropped."""
    kept = docs.drop(*STATS)
    rest = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType(rest + [T.StructField(s, T.DoubleType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([statistics_of(t.as_py()) for t in batch.column(text)], dtype=np.float64)
            got = got.reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in rest] + [pa.array(got[:, k]) for k in range(len(STATS))],
                names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


Test = tuple[int, bool, float]          # statistic, is it "greater than", threshold


@dataclass
class RuleModel:
    rules: list[tuple[Test, ...]]
    weights: list[float]
    intercept: float

    def score(self, stat: tuple[str, ...] = STATS) -> Column:
        """The model as one column expression over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for k, above, cut in rule:
                cond = cond & ((F.col(stat[k]) > cut) if above else (F.col(stat[k]) <= cut))
            z = z + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int,
          path: tuple[Test, ...], rules: list, out: np.ndarray, min_leaf: int) -> None:
    value = residual[rows].mean()
    out[rows] = value
    if path:
        rules.append(path)
    if depth == 0 or len(rows) < 2 * min_leaf:
        return
    best, total, n = (1e-9, -1, -1), residual[rows].sum(), len(rows)
    for k in range(binned.shape[1]):
        if not len(cuts[k]):
            continue
        size = len(cuts[k]) + 1
        cnt = np.cumsum(np.bincount(binned[rows, k], minlength=size))[:-1]
        s = np.cumsum(np.bincount(binned[rows, k], weights=residual[rows], minlength=size))[:-1]
        ok = (cnt >= min_leaf) & (n - cnt >= min_leaf)
        gain = np.where(ok, s**2 / np.maximum(cnt, 1) + (total - s) ** 2 / np.maximum(n - cnt, 1) - total**2 / n, -1)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (float(gain[j]), k, j)
    _, k, j = best
    if k < 0:
        return
    left = binned[rows, k] <= j
    cut = float(cuts[k][j])
    _tree(binned, cuts, residual, rows[left], depth - 1, (*path, (k, False, cut)), rules, out, min_leaf)
    _tree(binned, cuts, residual, rows[~left], depth - 1, (*path, (k, True, cut)), rules, out, min_leaf)


def _holds(x: np.ndarray, rules: list[tuple[Test, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float64)
    for i, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, i] *= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty (the intercept is free)."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    gram = np.c_[r, np.ones(n)]
    gram, top = gram.T @ gram / n, np.ones(m + 1)
    for _ in range(30):                     # largest eigenvalue by power iteration
        top = gram @ (top / np.linalg.norm(top))
    rate = 4.0 / max(1e-9, 1.05 * np.linalg.norm(top))
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        w2 = v - rate * (r.T @ g)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def train(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, seed: int = 5) -> RuleModel:
    """Fit on statistics ``x`` and 0/1 labels ``y``; every fifth row is held back to choose the penalty."""
    if not len(y):
        return RuleModel([], [], 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max() or len(y) < 20:
        return RuleModel([], [], base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 66)[1:-1])) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rng = np.random.default_rng(seed)
    z, rules = np.full(len(y), base), []
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(20, int(0.6 * len(y))), replace=False))
        residual = y - 1 / (1 + np.exp(-z))
        step, found = np.zeros(len(y)), []
        _tree(binned, cuts, residual, rows, depth, (), found, step, max(5, len(y) // 200))
        rules += found
        z += 2.0 * step
    # the same conjunction only once, whatever the order of its tests
    rules = list({tuple(sorted(set(r))): None for r in rules})
    held = np.arange(len(y)) % 5 == 4
    r = _holds(x, rules)
    keep = np.flatnonzero((r.mean(axis=0) > 0.002) & (r.mean(axis=0) < 0.998))
    rules, r = [rules[i] for i in keep], r[:, keep]
    best = (np.inf, 0.01)
    for penalty in (0.02, 0.01, 0.005, 0.0025, 0.001, 0.0005):
        w, b = _lasso(r[~held], y[~held], penalty, 150)
        p = np.clip(1 / (1 + np.exp(-(r[held] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
        best = min(best, (loss, penalty))
    w, b = _lasso(r, y, best[1])
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in on], [float(w[i]) for i in on], b)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS, holdout_mod: int = 5, **kw) -> RuleModel:
    """Learn from at most ``sample_rows`` labelled keys outside the hold-out, the first by a hash of the key.

    The sampled labels (a bounded table) are broadcast to the documents, so only
    the sample's statistics are computed and collected."""
    order = F.xxhash64(F.lit("quality"), F.col(key).cast("string"))
    lab = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_remainder(key, holdout_mod) != 0))
           .groupBy(F.col(key)).agg(F.avg(F.col(label).cast("double")).alias("_y"))
           .orderBy(order, key).limit(sample_rows))
    got = text_statistics(docs.select(key, text).join(F.broadcast(lab), key), text)
    rows = got.orderBy(order, key, *STATS).limit(2 * sample_rows).collect()
    x = np.array([[r[s] for s in STATS] for r in rows], dtype=np.float64).reshape(len(rows), len(STATS))
    y = np.array([float(r["_y"] >= 0.5) for r in rows])
    return train(x, y, **kw)


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, the statistics, and ``score`` (probability of label 1)."""
    return text_statistics(docs.drop("score"), text).withColumn("score", model.score())
