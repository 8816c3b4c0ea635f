import random

import pytest

from promoscope.llm import ngram_join as J


def brute(rows, words, percent):
    """Components over equal or similar sets; repeated keys allowed."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(2, 5)))
    passage = [word() for _ in range(30)]
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.45:                       # near copy
            w = list(rnd.choice(texts))
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = word()
        elif kind < 0.75:                               # shares a passage
            w = passage + [word() for _ in range(rnd.randrange(1, 60))]
        else:
            w = [word() for _ in range(rnd.randrange(1, 80))]
        texts.append(w)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "oNE"), (1005, "a b c"), (None, rows[3][1]),
             (3, rows[3][1]), (1006, "word " * 500), (1007, "word " * 900), (1008, rows[5][1].upper().replace(" ", "\n\t"))]
    return rows


@pytest.mark.parametrize("seed,words,percent,hot,leaf", [(1, 4, 85, 64, 64), (2, 2, 60, 3, 2)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, words, percent, hot, leaf):
    """Small bounds send the same texts through hot regions, the recursion and the pivots."""
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "BLOCK", leaf)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").coalesce(2)
    got = J.near_classes(df, words=words, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_rows(rows, words, percent), key=key)


def brute_rows(rows, words, percent):
    sub = [(k if k is not None else 10**9, t) for k, t in rows]
    return [(None if k == 10**9 else k, n, None if c == 10**9 else c) for k, n, c in brute(sub, words, percent)]


def test_dense_group_of_variants(spark, monkeypatch):
    """Many variants of one text: a large inner region with members beyond the radius of the first pivot."""
    monkeypatch.setattr(J, "HOT", 8)
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "_SETS_A_TASK", 5)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for p in rnd.sample(range(120), rnd.randrange(0, 9)):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = J.near_classes(df, words=4, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 80])
def test_filled_in_templates(spark, percent):
    """More texts of one template than a block holds, each two of likeness 0.83: pivots tell nothing apart, so the
    rounds are few and the rings compare in blocks. No links at 85 per cent, one class at 80."""
    shared = [f"w{i}" for i in range(270)]
    rows = [(i, " ".join(shared[:135] + [f"x{i}_{k}" for k in range(28)] + shared[135:])) for i in range(J.BLOCK + 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.component_id for r in J.near_classes(df, words=4, percent=percent).collect()}
    sets = [set(t.split()[i:i + 4][0] + "".join(t.split()[i:i + 4]) for i in range(295)) for _, t in rows[:2]]
    assert 0.80 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    assert got == {i: i if percent == 85 else 0 for i, _ in rows}


def test_counts_of_common_elements():
    rnd = random.Random(2)
    import numpy as np
    sets = [np.unique(np.array([rnd.randrange(300) for _ in range(rnd.randrange(1, 90))])) for _ in range(40)]
    got = J._common_counts(sets[:25], sets[10:])
    assert [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:25]] == got.astype(int).tolist()


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, "z"), (4, " ", "z"), (1, "a b c d e f g", "x"), (5, "q r s t u v w", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = J.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_empty_table(spark):
    assert J.near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_steps_are_small(spark, monkeypatch):
    """The driver holds the plan and the tasks of a whole step: no step of the recursion shuffles many tables at once."""
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "LEAF", 2)
    write, seen = J.Scratch.write, {}

    def spy(self, df, name, *more):
        seen[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        return write(self, df, name, *more)

    monkeypatch.setattr(J.Scratch, "write", spy)
    rows = corpus(2)
    got = J.near_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3), words=2, percent=60)
    assert got.count() == len(rows)
    assert "inner-0" in seen and max(seen.values()) <= 6, seen


@pytest.mark.parametrize("small,repeated", [(True, False), (False, True)])
def test_sets_are_sent_once(spark, monkeypatch, small, repeated):
    """The sets are the widest rows: where ids measure small, the sets stay in their task but for one way to their blocks,
    also where Spark's own bound for broadcasts is passed. Without broadcasts, and with a repeated row, the classes are right."""
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "LEAF", 2)
    if not small:
        monkeypatch.setattr(J, "sized_broadcast", lambda df: df)
    write, seen = J.Scratch.write, {}

    def spy(self, df, name, *more):
        seen[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return write(self, df, name, *more)

    monkeypatch.setattr(J.Scratch, "write", spy)
    rows = corpus(2)
    rows = rows if repeated else sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.near_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3), words=2, percent=60)
        got = got.select("doc_id", "n_shingles", "component_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_rows(rows, 2, 60), key=key)
    if small:
        assert (seen["sets"], seen["heavy-sets"], seen["outer-links"]) == (0, 0, 1), seen
