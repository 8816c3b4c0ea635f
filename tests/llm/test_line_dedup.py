import random
import re

from promoscope.llm import line_dedup as L
from pyspark.sql import functions as F


def edits(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:          # what both begin with costs nothing
        k += 1
    a, b = a[k:], b[k:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Expected texts: a line goes when it, or one within the longer one's budget, came before."""
    budget = lambda n: 2 if n >= 20 else 1 if n >= 10 else 0
    first, seen, out = {}, [], {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" ") and line not in first:
                near = any(abs(len(o) - len(line)) <= (k := budget(max(len(o), len(line)))) and edits(o, line) <= k for o in seen)
                first[line] = None if near else (key, p)
                seen.append(line)
        out[key] = None if text is None else "\n".join(
            x for p, x in enumerate(text.split("\n")) if not x.strip(" ") or first[x] == (key, p))
    return out


def test_banded_distance_against_brute_force(spark):
    rnd, pairs = random.Random(1), [("", ""), ("a", ""), ("", "ab"), ("abc", ""), ("é", "e")]
    for _ in range(300):
        a = [rnd.choice("abé ") for _ in range(rnd.randrange(0, 30))]
        b = list(a)
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.randrange(len(b) + 1)
            b[p:p + rnd.randrange(0, 2)] = rnd.choice(["", "x", "é"])
        pairs.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(4).withColumns(
        {f"w{k}": L.within_edits(F.col("a"), F.col("b"), k) for k in (1, 2)}).collect()
    assert [(r.w1, r.w2) for r in got] == [(edits(r.a, r.b) <= 1, edits(r.a, r.b) <= 2) for r in got]


def test_texts_equal_brute_force(spark):
    rnd = random.Random(4)
    line = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.choice([3, 19, 20, 21, 24, 40]))).strip() or "x"
    pool = [line() for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rnd.randrange(0, 8)):
            s = list(rnd.choice(pool) if rnd.random() < 0.7 else line())
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                p = rnd.randrange(len(s) + 1)
                s[p:p + rnd.randrange(0, 2)] = rnd.choice(["", "z"])
            text.append("".join(s))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "the same short\nthe same short\n"), (104, "w" * 30_000 + "\n" + "w" * 30_001),
             (105, "w" * 30_000)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows] + [(103, rows[-3][1], 5)], "doc_id long, text string, n_removed int").coalesce(2)
    got = L.dedup_lines(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.text for r in got} == want
    by = {r.doc_id: r for r in got}
    assert (by[103].n_lines, by[103].n_removed) == (2, 1) and by[100].n_lines == 0 and by[101].n_lines == 0


def test_short_lines_equal_brute_force(spark):
    """Lines of 1 to 30 characters, many about the lengths where the budget changes."""
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcdefg ") for _ in range(n)).strip() or "x" for n in [*range(1, 31), *range(7, 24), 9, 10, 18, 19, 20, 21]]
    rows = []
    for i in range(70):
        s = list(rnd.choice(pool))
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            p = rnd.randrange(len(s) + 1)
            s[p:p + rnd.randrange(0, 2)] = rnd.choice(["", "z", "y"])
        rows.append((i, "".join(s) + "\n" + rnd.choice(pool)))
    rows += [(200, "Share this page!!!!"), (201, "Share this page!!!?"), (202, "Share this page now ab"), (203, "Share this page now ac"),
             (204, "a line of nineteen!"), (205, "a line of nineteen!ab"), (206, "Page 1"), (207, "Page 2")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == brute(rows)
    assert got[201] == got[203] == got[205] == "" and got[207] == "Page 2"


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(df).collect() == []
    got = L.dedup_lines(spark.createDataFrame([(1, "one line here"), (None, "one line here")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {None: "one line here", 1: ""}


def test_lookups_compile(spark, capsys):
    """The JVM leaves methods of more than 8000 bytes uncompiled."""
    lines = spark.range(5).selectExpr("id AS h1", "repeat('é', 8 + int(id) * 3) AS line").withColumn("size", F.char_length("line"))
    looked = L._lookups(lines)
    assert looked.count() == 0 + 4 + 4 + 4 + 12
    looked.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_edits_at_both_ends(spark):
    """Pairs that differ at their ends, with what is between the same, shifted, or not quite the same."""
    rnd, pairs = random.Random(9), []
    for _ in range(300):
        mid = "".join(rnd.choice("aab") for _ in range(rnd.randrange(0, 40)))
        end = lambda: rnd.choice(["", "x", "é", "a", "ab", "xy"])
        other = mid if rnd.random() < 0.8 else mid[:len(mid) // 2] + rnd.choice("ab") + mid[len(mid) // 2:]
        pairs.append((end() + mid + end(), end() + other + end()))
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(4).withColumns(
        {f"w{k}": L.within_edits(F.col("a"), F.col("b"), k) for k in (1, 2)}).collect()
    assert [(r.w1, r.w2) for r in got] == [(edits(r.a, r.b) <= 1, edits(r.a, r.b) <= 2) for r in got]
