"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is a bag of hashed character bigrams and word-bounded trigrams. Each
bucket has an embedding; a text's vector is the mean over its subwords; a
linear softmax gives the language. Embeddings and weights are learnt jointly by
stochastic gradient descent in numpy on a bounded, documented sample of
labelled rows. Since the classifier is linear in the mean, the product of
embeddings and weights is folded into one score per bucket and language before
scoring, so a text costs one table look-up per subword.

Confidences are temperature-scaled on held-back sample rows, and the rejection
threshold is the lowest confidence whose accepted held-back rows keep the error
under a target.

Defined cases: NULL text, or text without a letter -> ``und`` with score 0;
rows with NULL text or NULL label are never learnt from; no labelled row at all
-> every text is ``und``; repeated rows are scored each; extra columns pass
through ``predict`` unless they bear the name of an output column, which they
lose to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 16
DIM = 16
SAMPLE_ROWS = 3000          # labelled rows that are learnt from, at most
EPOCHS = 6
UNDETERMINED = "und"
_PIECE = 1 << 21            # characters handled at once inside a task


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[: 0x20000] = [chr(c).isalpha() for c in range(0x20000)]
    table[0x20000:0x32000] = True       # the supplementary ideographic planes
    return table


_LETTERS: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every other character as a space; one space in front and behind."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_LETTERS[raw], raw, np.uint32(32))


def _subwords(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start positions and buckets of bigrams that hold a letter, and of trigrams with a letter in the middle."""
    letter = cp != 32
    shift = np.uint32(32 - BUCKET_BITS)
    mul, mix = np.uint32(2654435761), np.uint32(31337)
    pair = cp[:-1] * mix + cp[1:]
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    b2 = (pair[two] * mul) >> shift
    b3 = ((pair[three] * mix + cp[three + 2] + np.uint32(97)) * mul) >> shift
    return two, b2, three, b3


def buckets(text: str) -> np.ndarray:
    _, b2, _, b3 = _subwords(_codes(text))
    return np.concatenate([b2, b3])


@dataclass
class LangModel:
    langs: list[str]
    scores: np.ndarray          # [buckets, languages], the folded table
    bias: np.ndarray
    temperature: float
    threshold: float            # confidences below are rejected

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean scores of each text, and whether it has a letter. Works through pieces of bounded size."""
        out = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
                size += len(texts[end])
                end += 1
            parts = [_codes(t) for t in texts[at:end]]
            starts = np.cumsum([0] + [len(p) for p in parts])
            for piece, shift in _windows(np.concatenate(parts)):
                for pos, bucket in (lambda t: ((t[0], t[1]), (t[2], t[3])))(_subwords(piece)):
                    if not len(pos):
                        continue
                    owner = np.searchsorted(starts, pos + shift, side="right") - 1
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    who = owner[first] + at
                    count[who] += np.diff(np.r_[first, len(pos)])
                    for k in range(len(self.langs)):
                        out[who, k] += np.add.reduceat(self.scores[bucket, k], first, dtype=np.float64)
            at = end
        return out / np.maximum(count, 1)[:, None] + self.bias, count > 0


def _windows(cp: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Pieces of at most ``_PIECE`` characters that share their border characters, cut after a space."""
    at = 0
    while len(cp) - at > 2 * _PIECE:
        cut = at + _PIECE
        gap = np.flatnonzero(cp[cut: cut + _PIECE] == 32)
        cut += int(gap[0]) if len(gap) else _PIECE - 1
        yield cp[at: cut + 1], at
        at = cut
    yield cp[at:], at


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, target_error: float = 0.005) -> LangModel:
    """Fit on (text, language) rows; every fifth row is held back for calibration."""
    langs = sorted({lang for _, lang in rows})
    index = {lang: k for k, lang in enumerate(langs)}
    fit, held = [], []
    for i, (text, lang) in enumerate(rows):
        lines = [x for x in text.split("\n") if x != text]
        for part in [text, *lines[:: max(1, len(lines) // 3)][:3]]:     # whole texts, and some lines for short inputs
            b = buckets(part)
            if len(b):
                u, n = np.unique(b, return_counts=True)
                if i % 5 != 4:
                    fit.append((u, (n / n.sum()).astype(np.float32), index[lang]))
                elif part is text:          # calibrated on what is scored: whole texts
                    held.append((u, (n / n.sum()).astype(np.float32), index[lang]))
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((1 << BUCKET_BITS, DIM)) / DIM).astype(np.float32)
    w = np.zeros((DIM, len(langs)), dtype=np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            u, f, y = fit[i]
            rate = np.float32(0.5 * (1 - steps / total))
            steps += 1
            vec = f @ emb[u]
            z = vec @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(vec, p)
            bias -= rate * np.float32(0.1) * p
            # each bucket moves by its share of the mean, scaled up as in plain SGD on sums of subwords
            emb[u] -= (rate * np.float32(20)) * np.outer(f, back)
    model = LangModel(langs, (emb @ w).astype(np.float32), bias.astype(np.float64), 1.0, 0.5)
    check = held or fit
    if check:
        z = np.stack([f @ model.scores[u] + bias for u, f, _ in check]).astype(np.float64)
        y = np.array([y for _, _, y in check])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.mean(np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)))

        model.temperature = min(np.geomspace(0.05, 10, 40), key=loss)
        p = model.probabilities(z)
        right, conf = p.argmax(axis=1) == y, p.max(axis=1)
        floor = 1.0 / max(1, len(langs))
        for t in np.linspace(floor, 0.99, 100):
            ok = conf >= t
            if not ok.any() or 1 - right[ok].mean() <= target_error:
                model.threshold = float(t)
                break
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        where: Column | None = None, sample_rows: int = SAMPLE_ROWS, **kw) -> LangModel:
    """Learn from at most ``sample_rows`` labelled rows, the first by a hash of the key."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    order = F.xxhash64(F.lit("langid"), F.col(key).cast("string"))
    # ids first: the sort then carries no text, and the few chosen texts are fetched by one filter
    ids = [r[0] for r in rows.select(key, order.alias("o")).orderBy("o", key).limit(sample_rows).select(key).collect()]
    got = rows.filter(F.col(key).isin(ids)).select(key, text, lang).orderBy(order, text, lang).limit(2 * sample_rows)
    return train([(r[1], r[2]) for r in got.collect()], **kw)


def predict(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (calibrated confidence, 0 to 1) and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # 2^16 buckets x languages, whatever the input
    new = ("lang_pred", "score", "accepted")
    kept = docs.drop(*new)
    schema = T.StructType(kept.schema.fields + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw = batch.column(text).to_pylist() if batch.num_rows else []
            if m.langs:
                z, known = m.logits([t or "" for t in raw])
                p = m.probabilities(z) if len(raw) else np.zeros((0, len(m.langs)))
                best = p.argmax(axis=1)
                names = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
                conf = np.where(known, p.max(axis=1, initial=0.0), 0.0)
            else:
                names, conf, known = [UNDETERMINED] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(conf, pa.float64()),
                 pa.array(known & (conf >= m.threshold), pa.bool_())], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)
