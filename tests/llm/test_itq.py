import numpy as np

from promoscope.llm import itq


def brute(rows, cosine=0.95):
    good = [(i, k, np.asarray(v, float)) for i, (k, v) in enumerate(rows)
            if v is not None and len(v) == 64 and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    links = {i: set() for i in range(len(rows))}
    for i, _, a in good:
        for j, _, b in good:
            if i != j and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((key, len(links[i]), min(rows[j][0] for j in seen)))
    return out


def test_links_and_classes(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)              # large buckets become grids
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 64))
    rows = []
    for i in range(260):
        v = centres[i % 12] if i % 3 else rng.standard_normal(64)
        rows.append((i, (v + rng.standard_normal(64) * [0.02, 0.18, 0.3][i % 3 if i % 5 else 0]).tolist()))
    rows += [(300 + i, rows[1][1]) for i in range(20)]                       # exact copies
    rows += [(400, None), (401, []), (402, [0.0] * 64), (403, [None] + [1.0] * 63), (404, [float("nan")] + [1.0] * 63),
             (405, [float("inf")] + [1.0] * 63), (406, [1.0, 2.0]), (1, rows[1][1])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, kept string").coalesce(2)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_vectors(df).collect())
    want = sorted((k, n, c, k == c) for k, n, c in brute(rows))
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and 0.9 * true <= found <= true and true > 1000
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert [g for g, w in zip(got, want) if w[1] == 0] == [w for w in want if w[1] == 0]


def test_recall_at_the_threshold():
    """Pairs just above cosine 0.95 meet in some table often enough."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * noise
    model = itq.Quantiser.fit(np.concatenate([a, b])[::2])
    assert model.meet(model.codes(a), model.codes(b)).mean() >= 0.9 and len(model.axes) <= 2


def _spread(n, shared, rng):
    """Unit vectors whose mean has about the norm ``shared``."""
    v = rng.standard_normal((n, 64)) / 8
    v[:, 0] += shared / np.sqrt(1 - shared**2)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_recall_with_a_shared_direction():
    """All vectors share a component, or 70 % of them one cone: more codes are fitted until pairs at the threshold meet."""
    rng = np.random.default_rng(7)
    for shared, cone in ((0.0, 1), (0.5, 1), (0.8, 1), (0.9, 1), (0.9, 0.7)):
        a = _spread(2500, shared, rng)
        if cone < 1:
            some = rng.random(len(a)) > cone
            a[some] = _spread(int(some.sum()), 0.0, rng)
        b = itq.threshold_partners(a, 0.951, rng)
        model = itq.Quantiser.fit(a)
        assert model.meet(model.codes(a), model.codes(b)).mean() >= 0.9, (shared, cone, len(model.axes))


def test_links_with_a_shared_direction(spark):
    rng = np.random.default_rng(8)
    a = _spread(220, 0.85, rng)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, itq.threshold_partners(a[:150], 0.953, rng)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    got = {r.vec_id: r.n_links for r in itq.near_vectors(df).collect()}
    want = {k: n for k, n, _ in brute(rows)}
    assert all(got[k] <= want[k] for k in want) and 0.9 * sum(want.values()) <= sum(got.values()) and sum(want.values()) > 250
