import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from promoscope.llm import divergence as D
from promoscope.llm import queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """``rows``: (text, lang, source)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        share = {}
        whole = Counter()
        for s in sources:
            size = sum(n[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (n[lang, s][t] + 2) // (size + 2 * len(kept)) for t in kept}
            whole.update({t: n[lang, s][t] for t in kept})
        size = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 2) // (size + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(share[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and share[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def _rows(seed, n, n_sources, langs=("en", "fr", None)):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("sun", "Tree", "río", "ÉTÉ", "солнце", "x", "zz", "日本") for b in "abcdefghij"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else f"s{int(n_sources * rng.random() ** 2)}"
        words = rng.choices(vocabulary, weight, k=rng.randint(0, 60))
        rows.append((" ,".join(words) if i % 23 else None, langs[i % len(langs)], source))
    return rows


def _audit(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 1.5) for i, r in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, term string, value double").repartition(3)
    return sorted(map(tuple, D.audit(df).collect()))


def test_against_brute_force(spark):
    rows = _rows(1, 400, 7) + [("only here", "de", "s1"), ("", "de", "s2"), (None, None, None), ("", "it", "one"), ("A1b2C3 x-y_z [\\] `~ ª€😀", "en", "")]
    rows += rows[:20]
    got = _audit(spark, rows)
    assert got == brute(rows)
    assert any(r[2] == "term" for r in got) and ("de", "s1", "pair", "s2", 0, 1) in got and not any(r[0] == "it" for r in got)


def test_blocks_slices_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCES", 4)
    monkeypatch.setattr(D, "SLICE", 16)
    monkeypatch.setattr(D, "ENTRIES", 50)
    monkeypatch.setattr(D, "PIECE", 7)
    rows = _rows(2, 300, 23, ("en",))
    assert _audit(spark, rows) == brute(rows)


def test_many_equal_terms(spark):
    """Thousands of terms of equal counts: one cell, of which the first ten terms in UTF-8 order are listed."""
    names = [f"{c}{a}{b}" for c in ("q", "é", "z") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(" ".join(names), "en", "a")] * 10 + [("other words here", "en", "b")] * 12
    got = _audit(spark, rows)
    assert got == brute(rows) and [r[3] for r in got if r[1:3] == ("a", "term")] == sorted(names, key=str.encode)[:10]


def test_large_counts_are_exact(spark):
    """Shares of counts whose thousand-millionfold does not fit 64 bits."""
    from pyspark.sql import functions as F
    big = 7 * 10**12 + 3
    got = spark.range(1).select(D._share(F.lit(big), F.lit(10**14 + 7), F.lit(12345)).alias("p"), D._share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert got.p == 1 + 10**9 * (big + 2) // (10**14 + 7 + 2 * 12345) and got.none is None


@pytest.mark.parametrize("size", [1, 3, 8, 1 << 20])
def test_terms_of_pieces(size, monkeypatch):
    monkeypatch.setattr(D, "PIECE", size)
    for text in ("", "   ", "abc", "one two  THREE,fouréè " * 5, "x" * 50 + " y", " " * 20 + "Zed", "日本語" * 9):
        got = [t.decode() for some in D.terms(text.encode()) for t in some]
        assert got == [t.translate(LOWER) for t in TERM.findall(text)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(df).collect() == []


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.execute(f"SELECT {','.join(cols)} FROM ({queries.OP12_SQL})").fetchall())
    assert sorted(map(tuple, queries.op12_divergence(spark, sf_small).select(cols).collect())) == want and want
