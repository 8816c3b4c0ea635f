import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from promoscope.llm import fingerprints as P

MASK = (1 << 64) - 1


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def spark_hash(*parts):
    """Spark's 64-bit hash of strings (str), INTs ((4, v)) and BIGINTs ((8, v)); None is skipped."""
    seed = 42
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else int(p[1]).to_bytes(p[0], "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w] or [""]
    hashes = {spark_hash(*[words[i + k] if i + k < len(words) else None for k in range(5)]) for i in range(max(1, len(words) - 4))}
    dense = {}
    for h in hashes:
        b = (h >> 56) + 128
        dense[b] = min(h, dense.get(b, h))
    digits = []
    for i in range(256):
        h = dense.get(i)
        if h is None:
            for k in range(P.ATTEMPTS):
                h = dense.get(spark_hash((4, i), (4, k)) % 256)
                if h is not None:
                    break
            else:
                h = min((spark_hash((4, i), (4, b)), v) for b, v in dense.items())[1]
        digits.append("%X" % (spark_hash((8, h), (4, i)) & 15))
    return "".join(digits)


def like(a, b):
    agree = sum(x == y for x, y in zip(a, b)) / 256
    return max((agree - 1 / 16) / (15 / 16), 0.0)


ROWS = [(9, "The quick brown fox jumps over the lazy dog and runs away from it."), (8, "  The QUICK brown\tfox jumps over\nthe lazy dog and runs away from it. "),
        (7, None), (6, ""), (5, " \n "), (4, "one"), (3, "été à la plage, déjà vu 😀 " * 30), (2, "word " * 4000),
        (11, " ".join(f"w{i % 97}x{i}" for i in range(3000)))]


def test_fingerprints_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, "old") for k, t in ROWS], "doc_id long, text string, fingerprint string").repartition(3)
    out = P.with_fingerprint(df)
    assert sorted(out.columns) == ["doc_id", "fingerprint", "text"]
    rows = out.select("doc_id", "fingerprint", P.as_text(F.col("fingerprint")).alias("t"),
                      P.as_text(P.from_text(P.as_text(F.col("fingerprint")))).alias("again")).collect()
    got = {r.doc_id: r.t for r in rows}
    assert got == {k: brute(t) for k, t in ROWS}
    assert all(r.t == r.again for r in rows) and got[9] == got[8] and got[7] == got[6] == got[5]
    pairs = out.alias("a").crossJoin(out.alias("b")).select(
        F.col("a.doc_id"), F.col("b.doc_id"), P.likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()
    assert all(v == pytest.approx(like(got[a], got[b])) for a, b, v in pairs)
    by = {(a, b): v for a, b, v in pairs}
    assert by[9, 8] == 1.0 and by[7, 6] == 1.0 and by[4, 6] < 0.2 and by[9, 11] < 0.2


def test_likeness_estimates_jaccard(spark):
    """The mean error over many pairs is small, and no error is far beyond the standard error."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for i in range(120):
        n, shared = int(rng.integers(30, 900)), rng.random()
        a = [f"a{i}b{k}" for k in range(n)]
        b = a[:int(n * shared)] + [f"c{i}d{k}" for k in range(n - int(n * shared))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        sets = [{tuple(x[k: k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
        want[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    df = P.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    a = df.filter("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("int").alias("i"), F.col("fingerprint").alias("fa"))
    b = df.filter("doc_id % 2 = 1").select(F.floor(F.col("doc_id") / 2).cast("int").alias("i"), F.col("fingerprint").alias("fb"))
    got = {r.i: r.x for r in a.join(b, "i").select("i", P.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()}
    errors = np.array([got[i] - want[i] for i in want])
    assert abs(errors.mean()) < 0.02 and np.abs(errors).max() < 0.2 and errors.std() < 0.05


def brute_next(rows):
    order = sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for at, (key, text) in enumerate(order):
        after, t = order[(at + 1) % len(order)]
        n, third = len(text), len(text) // 3
        edited = text[: n - third] + t[:third]
        out[key] = (n, hashlib.sha256(edited.encode()).hexdigest(), brute(text), brute(edited), after,
                    like(brute(text), brute(edited)), like(brute(text), brute(t)))
    return out


def test_edited_by_next(spark):
    rows = ROWS + [(2, "word " * 4000), (None, "The last one by key has no key at all, but words.")]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, key double").repartition(4)
    got = P.edited_by_next(df).select(
        "doc_id", "n_chars", "edited_sha256", P.as_text(F.col("fingerprint")), P.as_text(F.col("edited_fingerprint")), "next_key",
        P.likeness(F.col("fingerprint"), F.col("edited_fingerprint")), P.likeness(F.col("fingerprint"), F.col("next_fingerprint"))).collect()
    want = brute_next(rows)
    assert len(got) == len(rows)
    assert all(tuple(r[1:6]) == want[r[0]][:5] and list(r[6:]) == pytest.approx(want[r[0]][5:]) for r in got)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.edited_by_next(none).collect() == [] and P.with_fingerprint(none).collect() == []
    one = P.edited_by_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.next_key == 1 and one.n_chars == 6


def test_query(spark, sf_small):
    from promoscope.llm import queries
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_next(docs)
    got = queries.op11_fingerprints(spark, sf_small)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == w[:4]
        assert [r.near_edited, r.near_next] == pytest.approx(list(w[5:]))
