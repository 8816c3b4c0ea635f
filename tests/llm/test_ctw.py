import math
from collections import Counter

import numpy as np

from promoscope.llm import ctw
from promoscope.llm.common import Scratch


def tree(texts, depth, need):
    """Cells of every depth straight from the texts."""
    out = []
    grams = Counter()
    for t in texts:
        raw = bytes(ctw.DEPTH) + (t or "").encode() + b"\0"
        for i in range(ctw.DEPTH, len(raw)):
            grams[raw[i - ctw.DEPTH:i + 1]] += 1
    for d in range(depth + 1):
        cell, total = Counter(), Counter()
        for g, n in grams.items():
            cell[g[ctw.DEPTH - d:]] += n
            total[g[ctw.DEPTH - d:ctw.DEPTH]] += n
        keep = sorted(k for k in cell if d == 0 or total[k[:-1]] >= need)
        num = lambda b: int.from_bytes(b, "big")
        out.append((np.array([num(k[:-1]) for k in keep], np.uint64), np.array([k[-1] for k in keep], np.uint64), np.array([cell[k] for k in keep])))
    return out, grams


def brute_probability(texts, gram, depth, need):
    """P(byte | context) by the recursive definition, one bit at a time."""
    rows = []
    for t in texts:
        raw = bytes(ctw.DEPTH) + t.encode() + b"\0"
        rows += [(raw[i - ctw.DEPTH:i], raw[i]) for i in range(ctw.DEPTH, len(raw))]
    context, byte = gram[:-1], gram[-1]

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    total = 0.0
    for j in range(8):
        prefix = byte >> (8 - j)
        bits = [(c, (x >> (7 - j)) & 1) for c, x in rows if x >> (8 - j) == prefix]

        def split(group, d):
            """Children of a context of depth d: kept ones by context, all others together."""
            kids = {}
            for c, bit in group:
                key = c[ctw.DEPTH - d - 1:]
                size = sum(1 for o, _ in rows if o.endswith(key))
                kids.setdefault(key if size >= need else None, []).append((c, bit))
            return kids

        def weighted(group, d, kept):
            one = sum(b for _, b in group)
            own = kt(len(group) - one, one)
            if d == depth or not kept:
                return own
            below = sum(weighted(g, d + 1, k is not None) for k, g in split(group, d).items())
            return np.logaddexp(own, below) - math.log(2)

        def predict(group, d, kept):
            one = sum(b for _, b in group)
            p = (one + .5) / (len(group) + 1)
            if d == depth or not kept:
                return p
            stop = math.exp(kt(len(group) - one, one) - math.log(2) - weighted(group, d, kept))
            key = context[ctw.DEPTH - d - 1:]
            size = sum(1 for o, _ in rows if o.endswith(key))
            key = key if size >= need else None
            return stop * p + (1 - stop) * predict(split(group, d).get(key, []), d + 1, key is not None)

        p = predict(bits, 0, True)
        total += math.log10(p if (byte >> (7 - j)) & 1 else 1 - p)
    return total


def test_predictions_equal_the_definition():
    texts = ["abracadabra", "abra cadabra!", "cabra"]
    for need in (1, 3):
        cells, _ = tree(texts, ctw.DEPTH, need)
        model = ctw.ByteModel.build(cells)
        for gram in (b"\0\0\0\0a", b"abrac", b"abraz", b"zzzza", b"zabra", b"abra\0", b"xbra!", b"qqqq\xff"):
            got = model.log10(np.array([int.from_bytes(gram, "big")], np.uint64))[0]
            assert abs(got - brute_probability(texts, gram, ctw.DEPTH, need)) < 1e-5, (need, gram)


def test_bytes_sum_to_one():
    cells, _ = tree(["the quick brown fox", "the lazy dog, the end"], ctw.DEPTH, 2)
    model = ctw.ByteModel.build(cells)
    for context in (b"the ", b"\0\0\0\0", b"xxxx", b"xthe"):
        g = (int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.log10(g)).sum() - 1) < 1e-5


def test_scores_tokens_and_base(spark):
    rows = [(1, "The cat sat\ton the mat"), (2, "the dog"), (3, None), (3, ""), (None, "ÉCLAIR éclair CAT"), (2, "the dog"), (9, "unseen words " * 4000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").coalesce(2)
    train = [rows[0][1], rows[1][1]]
    for bits in (20, 1):                     # all words broadcast, or nearly all joined
        model, words = ctw.fit(docs.filter("doc_id < 3").dropDuplicates(), Scratch(spark, "t"), word_bits=bits)
        got = ctw.score(docs, model, words, Scratch(spark, "t")).collect()
        c = Counter(w for t in train for w in [*t.encode().lower().split(), b"\n"])
        n, v = sum(c.values()), len(c)
        want = []
        cells, _ = tree(train, ctw.DEPTH, 1)
        m = ctw.ByteModel.build(cells)
        for key, text in rows:
            w = [*(text or "").encode().lower().split(), b"\n"]
            raw = bytes(ctw.DEPTH) + (text or "").encode() + b"\0"
            lp = m.log10(np.array([int.from_bytes(raw[i - ctw.DEPTH:i + 1], "big") for i in range(ctw.DEPTH, len(raw))], np.uint64)).sum()
            want.append((str(key), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w), 6), round(lp, 2)))
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in got) == sorted(want)


def test_every_counted_context_is_weighed(spark):
    train = ["abracadabra", "abra cadabra!", "cabra", "a cab, a bar; a crab"]
    rows = [(i, t) for i, t in enumerate([*train, "abra zebra", "qqqq\xff", "xcabr", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for depth, bits in ((4, 2), (4, 22), (3, 2), (2, 2), (1, 2), (0, 2)):     # few pairs are broadcast, or all
        model, words = ctw.fit(docs.filter("doc_id < 4"), Scratch(spark, "t"), share_bits=bits, depth=depth)
        got = {r.doc_id: r.score for r in ctw.score(docs, model, words, Scratch(spark, "t")).collect()}
        cells, _ = tree(train, depth, 1)
        for key, text in rows:
            raw = bytes(ctw.DEPTH) + (text or "").encode() + b"\0"
            grams = [raw[i - ctw.DEPTH:i + 1] for i in range(ctw.DEPTH, len(raw))]
            if depth == ctw.DEPTH and bits == 2:
                want = sum(brute_probability(train, g, depth, 1) for g in grams)
            else:
                want = ctw.ByteModel.build(cells).log10(np.array([int.from_bytes(g, "big") for g in grams], np.uint64)).sum()
            assert abs(got[key] - want) < 1e-6, (depth, bits, text)


def test_subtrees_stay_whole_over_batches():
    import pyarrow as pa
    g = np.sort(np.random.default_rng(1).integers(0, 40, 5000))
    key, n = np.arange(5000), np.ones(5000, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a: a + 70]) for x in (key, n, g)], names=["key", "n", "g"]) for a in range(0, 5000, 70)]
    parts = [k for k, _ in ctw._whole_subtrees(iter(batches), 300)]
    assert len(parts) > 5 and np.concatenate(parts).tolist() == key.tolist()
    assert all(g[a[-1]] != g[b[0]] for a, b in zip(parts, parts[1:]))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    model, words = ctw.fit(docs.limit(0), Scratch(spark, "t"))
    row = ctw.score(docs, model, words, Scratch(spark, "t")).collect()[0]
    assert abs(row.score + 24 * math.log10(2)) < 1e-9 and row.train_tokens == 0 and row.n_known == 0
