import random

from promoscope.llm import decontam as D


def fewest(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_items_against_brute_force():
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh  ") for _ in range(n))
    items = [(i, text(rnd.choice([30, 60, 90]))) for i in range(12)]
    docs = []
    for i in range(60):
        s = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(0, 10)):
            p = rnd.randrange(len(s) + 1)
            s[p:p + rnd.randrange(0, 2)] = rnd.choice(["", "z", "y"])
        docs.append(text(rnd.randrange(0, 80)) + "".join(s).upper() + text(rnd.randrange(0, 80)))
    index = D.ItemIndex.build(items, D.Q, D.WINDOW, D.RATE, D.MIN_CHARS)
    plain = lambda s: "".join(map(chr, D.normalise(s)[0]))
    budget = dict(zip(index.ids.tolist(), index.edits.tolist()))
    for doc, found in zip(docs, index.matches(docs)):
        want = {i for i, t in items if fewest(plain(t).rstrip(" "), plain(doc)) <= budget[i]}
        assert {m[0] for m in found} == want
        for i, a, b, e in found:
            assert 0 <= a < b <= len(doc) and e <= budget[i]


def test_inside_of_long_items_against_brute_force():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([101, 160, 300, 420])]
    passages = [items[2][1][60:190], items[2][1][63:163], items[3][1][25:125], items[3][1][130:225], items[3][1][130:215]]
    for _ in range(30):
        i, whole = rnd.choice(items)
        a = rnd.randrange(len(whole) - 90)
        s = list(whole[a: a + rnd.randrange(88, 140)])
        for _ in range(rnd.randrange(0, 11)):
            p = rnd.randrange(len(s) + 1)
            s[p:p + rnd.randrange(0, 2)] = rnd.choice(["", "z", "y"])
        passages.append("".join(s))
    docs = [text(rnd.randrange(0, 40)) + p + text(rnd.randrange(0, 40)) for p in passages]
    index = D.ItemIndex.build(items, D.Q, D.WINDOW, D.RATE, D.MIN_CHARS)

    def closest(item, doc):
        return min(fewest(item[o: o + D.WINDOW], doc) for o in range(len(item) - D.WINDOW + 1))

    for doc, passage, found in zip(docs, passages, index.matches(docs)):
        # another item's letters are random: only the passage's own item can be near
        near = {i: closest(t, doc) for i, t in items if any(passage[k: k + 12] in t for k in range(len(passage) - 11))}
        assert {m[0]: m[3] for m in found} == {i: e for i, e in near.items() if e <= index.edits[i]}
    first = index.matches(docs[:1])[0][0]
    at = docs[0].index(passages[0])
    assert first[1] <= at and first[2] >= at + 130 and first[3] == 0


def test_annotate_edges(spark):
    item = "What is the capital of the invented country called Ruritania? Answer: Strelsau, of course, since 1894 at the latest, they say."
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (None, item), (4, "Another item about nothing in particular.")],
                                  "item_id long, text string")
    rows = [(1, f"before {item.upper()}  after"), (2, item.replace(" ", "\n\t ")), (3, None), (4, ""), (5, item[:60]), (6, "x" * 300_000 + item[15:]),
            (7, "clean text of the capital"), (1, f"before {item.upper()}  after")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, matches int").coalesce(2)
    for chars in (D.BLOCK_CHARS, 50):                              # one block of items, or several
        got = {r.doc_id: r.matches for r in D.annotate(docs, items, block_chars=chars).collect()}
        assert {k for k, m in got.items() if m} == {1, 2, 6}
        m = got[1][0]
        assert (m.item_id, m.start, m.end, m.edits) == (1, 7, 7 + len(item), 0)
        assert got[3] == [] and got[6][0].edits == 0
    assert D.annotate(docs.limit(0), items).collect() == []
    assert all(r.matches == [] for r in D.annotate(docs, items.limit(0)).collect())


def test_repetitive_texts_in_little_memory():
    """Runs of one character on both sides: every place of the one meets every place of the other."""
    import tracemalloc
    index = D.ItemIndex.build([(1, "a" * 400), (2, "_-" * 200), (3, "plain words of an item that repeats nothing at all")], D.Q, D.WINDOW, D.RATE, D.MIN_CHARS)
    texts = ["a" * 300_000, "x" * 50 + "-_" * 300 + "y" * 40, "a" * 60, "b" * 30 + "a" * 150 + "c" * 30]
    tracemalloc.start()
    got = index.matches(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert [m[0] for m in got[0]] == [1] and got[0][0][1] == 0 and got[0][0][2] >= 299_900 and got[0][0][3] == 0
    assert [m[0] for m in got[1]] == [2] and got[2] == []
    assert [m[0] for m in got[3]] == [1] and got[3][0][1] <= 32 and got[3][0][2] >= 178


def test_hits_some_at_a_time(monkeypatch):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 90, 150, 260])] + [(9, "ab" * 80)]
    docs = [text(rnd.randrange(0, 60)) + items[i % 5][1][rnd.randrange(0, 30):] + text(rnd.randrange(0, 60)) for i in range(25)]
    index = D.ItemIndex.build(items, D.Q, D.WINDOW, D.RATE, D.MIN_CHARS)
    whole = index.matches(docs)
    monkeypatch.setattr(D, "HITS", 7)
    assert index.matches(docs) == whole and sum(map(len, whole)) > 10


def test_many_blocks_equal_one(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh  ") for _ in range(n))
    items = [(i, text(120)) for i in range(20)] + [(50, None)]
    docs = [(i, text(40) + items[i % 20][1][:110] + text(20) + items[(i * 7) % 20][1], "x") for i in range(30)] + [(90, None, "x"), (91, "", "x"), (3, "dup", "y"), (3, "dup", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, matches string").coalesce(2)
    known = spark.createDataFrame(items, "item_id long, text string")
    one = D.annotate(df, known)
    many = D.annotate(df, known, block_chars=130)
    rows = lambda d: sorted(((r.doc_id, r.text or "", sorted(map(tuple, r.matches))) for r in d.collect()))
    got, want = rows(many), rows(one)
    assert many.columns == one.columns and [r[:2] for r in got] == [r[:2] for r in want] and sum(len(r[2]) for r in want) >= 40
    for g, w in zip(got, want):         # a span's ends may differ by edits: bands lie elsewhere in another block
        assert [m[0] for m in g[2]] == [m[0] for m in w[2]]
        assert all(abs(x[1] - y[1]) <= 9 and abs(x[2] - y[2]) <= 9 for x, y in zip(g[2], w[2]))
