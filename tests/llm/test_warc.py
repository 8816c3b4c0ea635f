import duckdb

from promoscope.llm import queries, warc

SCHEMA = "record_id long, url string, ts long, status int, headers map<string,string>, payload string, outcome string"


def _resolve(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return {r.record_id: r for r in warc.resolve(df, **kw).collect()}


def test_as_of_validators_and_headers(spark):
    day = 86_400
    rows = [(1, "http://www.a.org:80/x/?b=2&a=1&utm_source=f#t", 10, 200, {"ETag": '"v1"', "Content-Type": "text/html", "X": "old"}, "one"),
            (2, "https://a.org/x?a=1&b=2", 5 * day, 200, {"etag": 'W/"v2"', "Last-Modified": "d2"}, "two"),
            (3, "HTTPS://A.org/x/?a=1&b=2", 20, 304, {"etag": 'W/"v1"', "Content-Type": "nothing", "x": "new", "Date": "now"}, None),
            (4, "https://a.org/x?a=1&b=2", 9 * day, 304, {"ETag": '"v2"'}, None),                # latest, over several spans
            (5, "https://a.org/x?a=1&b=2", 9 * day, 304, {"ETag": '"v1"'}, None),                # the older one does not count
            (6, "https://a.org/x?a=1&b=2", 5, 304, {}, None), (7, None, 9 * day, 304, None, None),
            (8, "https://a.org/x?b=2&a=1", 6 * day, 304, {"last-modified": "d2"}, None),
            (9, "https://a.org/x?b=2&a=1", 6 * day, 304, None, None), (10, "https://a.org/x?b=2&a=1", None, 304, None, None),
            (11, "https://a.org/x?b=2&a=1", 10, 304, None, None),                                # a tie in time: record id decides
            (12, "https://b.org", 10, 301, None, None)]
    got = _resolve(spark, rows)
    out = {k: (r.outcome, r.checked_by, r.response_id) for k, r in got.items()}
    assert out == {3: ("resolved", "etag", 1), 4: ("resolved", "etag", 2), 5: ("mismatch", "etag", 2), 6: ("orphan", None, None),
                   7: ("orphan", None, None), 8: ("resolved", "last-modified", 2), 9: ("resolved", None, 2), 10: ("orphan", None, None),
                   11: ("resolved", None, 1)}
    assert got[3].headers == {"etag": 'W/"v1"', "content-type": "text/html", "x": "new", "date": "now"} and got[3].payload == "one"
    assert got[5].payload is None and got[9].payload == "two" and got[3].canonical_url == "a.org/x?a=1&b=2"


def test_hot_url_spans_and_brute_force(spark):
    import random
    random.seed(2)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://c{i % 5}.org/p", random.randrange(50), random.choice([200, 304]), None, str(i)) for i in range(300)]
    full = [(r[1], r[2], r[0]) for r in rows if r[3] == 200]
    want = {r[0]: max([(t, k) for u, t, k in full if u == r[1] and (t, k) < (r[2], r[0])], default=(None, None))[1] for r in rows if r[3] == 304}
    for span, most in ((3, 1000), (10_000, 1000), (10_000, 7), (20, 1)):        # by time, and cut by count within a span
        assert {k: v.response_id for k, v in _resolve(spark, rows, span_seconds=span, span_rows=most).items()} == want


def test_empty_and_repeated_records(spark):
    assert _resolve(spark, []) == {}
    got = _resolve(spark, [(1, "http://a.b/", 1, 200, None, "x"), (1, "http://a.b/", 1, 200, None, "x"), (2, "http://a.b/", 2, 304, None, None)])
    assert got[2].payload == "x"


def test_repeated_and_null_revisits_keep_their_own_headers(spark):
    rows = [(1, "http://a.b/", 1, 200, {"ETag": '"v"'}, "x")]
    for key in (2, None):
        rows += [(key, "http://a.b/", 5, 304, {"etag": f'"{tag}"', "n": str(i)}, None) for i, tag in enumerate("vwvw")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    got = sorted((r.record_id or 0, r.outcome, r.checked_by, (r.headers or {}).get("n", "-")) for r in warc.resolve(df).collect())
    assert got == sorted((k, *x) for k in (0, 2) for x in [("resolved", "etag", "0"), ("resolved", "etag", "2")] + [("mismatch", "etag", "-")] * 2)


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_small}/pages.parquet'")
    cols = ["record_id", "canonical_url", "outcome", "checked_by", "response_id", "headers", "payload_md5"]
    want = sorted(map(str, con.execute(f"SELECT {','.join(cols)} FROM ({queries.OP3_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op3_revisits(spark, sf_small).select(cols).collect()) == want
