import math
from collections import Counter

import numpy as np
import pytest

from promoscope.llm import spm
from promoscope.llm.queries import PIECE_MODEL

TEXTS = ["a ▁b\n\n  c\té 漢字😀 \x00", "", "x" * 1000 + " y", " ", "▁▁", "On the mat.\nOn the mat.", None, "onthem " * 3000]


@pytest.fixture(scope="module")
def vocabulary():
    return spm.Vocabulary.load(PIECE_MODEL)


def test_round_trip_and_edges(spark, vocabulary):
    rows = [(i, t, "p") for i, t in enumerate(TEXTS)] + [(None, "same key"), (None, "same key")]
    df = spark.createDataFrame([r if len(r) == 3 else (*r, "p") for r in rows], "doc_id long, text string, pieces string").coalesce(2)
    got = spm.decode(spm.encode(df, vocabulary, verify="lossless"), vocabulary).collect()
    assert all(r.decoded == r.text and r.lossless for r in got) and len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].pieces == [] and by[6].pieces is None and by[6].decoded is None
    same = [r.pieces for r in got if r.doc_id is None]
    assert same[0] == same[1]
    other = {r.doc_id: r.pieces for r in spm.encode(df.repartition(3), vocabulary).collect()}
    assert all(other[k] == r.pieces for k, r in by.items())                  # whatever the partitioning
    assert spm.encode(df, vocabulary, seed=2).filter("doc_id = 7").first().pieces != by[7].pieces
    assert spm.encode(df.limit(0), vocabulary).collect() == []


def test_samples_follow_the_lattice(vocabulary):
    t = vocabulary.tables()
    weight = {vocabulary.pieces[i]: w for i, w in zip(t["id"], t["weight"])}

    def paths(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                for rest in paths(s[n:]):
                    yield (s[:n], *rest)

    p = {g: math.exp(sum(weight[x] for x in g)) for g in paths(chr(spm.SPACE) + "onthem")}
    total, n = sum(p.values()), 40_000
    ids, count = spm.encode_texts(spm.Lattices(vocabulary), ["onthem"] * n, np.arange(n, dtype=np.uint64))
    ends = np.cumsum(count)
    got = Counter(tuple(vocabulary.pieces[i] for i in ids[e - c: e]) for e, c in zip(ends, count))
    assert set(got) <= set(p)
    for g, x in p.items():
        assert abs(got[g] / n - x / total) < 5 * math.sqrt(x / total / n) + 1e-3


def test_long_units_are_not_cut(vocabulary):
    t = vocabulary.tables()
    weight = {vocabulary.pieces[i]: math.exp(w) for i, w in zip(t["id"], t["weight"])}
    text, n = "onthem" * 90, 4_000
    s = chr(spm.SPACE) + text
    before, behind = np.zeros(len(s) + 1), np.zeros(len(s) + 1)      # weights of all paths, scaled by position
    scale = math.exp(-2.5)
    before[0] = behind[len(s)] = 1
    for i in range(len(s) + 1):
        for k in range(max(0, i - t["longest"]), i):
            before[i] += before[k] * weight.get(s[k:i], 0) / scale ** (i - k)
    for i in range(len(s) - 1, -1, -1):
        for k in range(i + 1, min(len(s), i + t["longest"]) + 1):
            behind[i] += behind[k] * weight.get(s[i:k], 0) / scale ** (k - i)
    want = before * behind / before[-1]                               # probability of a border at each position
    ids, count = spm.encode_texts(spm.Lattices(vocabulary), [text] * n, np.arange(n, dtype=np.uint64))
    size = np.array([len(vocabulary.pieces[i]) for i in ids])
    ends = np.cumsum(size)
    borders = np.bincount((ends - 1) % len(s) + 1, minlength=len(s) + 1) / n
    assert ends[-1] == n * len(s) and want[256] < 0.9 and want[512] < 0.9
    assert (np.abs(borders - want)[1:] < 5 * np.sqrt(want * (1 - want).clip(0) / n)[1:] + 2e-3).all()
