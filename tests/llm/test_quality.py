import numpy as np

from promoscope.llm import quality as Q
from promoscope.llm import queries


def test_held_out_scores(spark, sf_small):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    got = queries.op10_quality(spark, sf_small).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_compiled_column_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(Q.STATS)))
    y = ((x[:, 3] > 0.7) | ((x[:, 6] > 0.5) & (x[:, 9] < 0.3))).astype(float)
    model = Q.train(x, y, trees=8)
    z = Q._holds(x, model.rules) @ np.array(model.weights) + model.intercept
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{s} double" for s in Q.STATS)).coalesce(2)
    got = {r.i: r.p for r in df.select("i", model.score().alias("p")).collect()}
    assert max(abs(got[i] - 1 / (1 + np.exp(-z[i]))) for i in range(len(x))) < 1e-9
    assert np.mean((z > 0) == (y > 0)) > 0.97 and 0 < len(model.rules) < 200


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "Fine words. Here.", "d"), (None, "x" * 200_000, "e"), (4, "Fine words. Here.", "d")],
                                 "doc_id long, text string, score string").coalesce(2)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    model = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, model).collect()} == {0.5} and Q.score(docs.limit(0), model).collect() == []
