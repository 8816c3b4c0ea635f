import hashlib
import math

import duckdb
import numpy as np

from promoscope.llm import centroids as C
from promoscope.llm import queries


def brute(rows, k=8, rounds=10):
    good = [(key, [math.floor(1024 * x) for x in v]) for key, v in rows
            if v is not None and len(v) == 64 and None not in v and all(map(math.isfinite, v)) and max(map(abs, v)) < 131000]
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in sorted(good, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        near = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in good]
        if step == rounds:
            break
        for c in range(len(centres)):
            mine = [v for (_, v), n in zip(good, near) if n == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [far(v, centres[n]) for (_, v), n in zip(good, near)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda n: n if n < 2**63 else None
    return sorted(((key, n, x, fits(sum(b for a, b in zip(near, d) if a == n)), fits(sum(d)), sha[n]) for (key, _), n, x in zip(good, near, d)), key=str)


def _got(spark, rows, **how):
    df = spark.createDataFrame([(k, v, "old") for k, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    return sorted(map(tuple, C.cluster(df, **how).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    heart = rng.standard_normal((5, 64))
    rows = [(i, (heart[i % 5] + 0.4 * rng.standard_normal(64)).tolist()) for i in range(150)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63),
             (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (208, [-0.0009765] * 64)]
    assert _got(spark, rows) == brute(rows)
    assert _got(spark, rows, rounds=1) == brute(rows, rounds=1)


def test_ties_go_to_the_smaller_number(spark):
    """Vectors half way between equal and mirrored centroids."""
    rows = [(i, [float(i % 3 - 1)] + [0.0] * 63) for i in range(60)]
    assert _got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.choice([-130000.0, 130000.0], 64) + rng.random(64)).tolist()) for i in range(30)] + [(99, [2e5] * 64), (98, [1e300] * 64)]
    assert _got(spark, rows) == brute(rows)


def test_tournament_equals_plain_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-6, 7, (8, 64))
    centres[5] = centres[2]                                     # equal centroids: a tie everywhere
    x = rng.integers(-6, 7, (3000, 64))
    tests = C.Bisectors(centres)
    plain = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    near = tests.nearest(x)
    assert (near == plain.argmin(axis=1)).all() and not (near == 5).any()       # argmin takes the first of equal ones
    assert (tests.distance(x, near) == plain.min(axis=1)).all()


def test_few_and_none(spark):
    assert _got(spark, []) == [] and _got(spark, [(1, None)]) == []
    rows = [(1, [1.0] * 64), (2, [2.0] * 64), (3, [-1.0] * 64)]
    assert _got(spark, rows) == brute(rows)


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = sorted(con.execute(f"SELECT {','.join(cols)} FROM ({queries.oracle_queries()['op13_centroids']})").fetchall())
    assert sorted(map(tuple, queries.op13_centroids(spark, sf_small).select(cols).collect())) == want and want
