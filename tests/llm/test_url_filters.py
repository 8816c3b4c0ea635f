import duckdb

from promoscope.llm import queries, url_filters as U


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, bad int, rule string")


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/de/", "block")]


def test_hosts_paths_and_rules(spark):
    rows = [(1, "HTTP://Sub.EXAMPLE.org/es/x?q#f", None, "old"), (2, "http://example.org/en/15#top", None, None),
            (3, "http://notexample.org", None, None), (4, "https://a.com/de/1", None, None), (5, None, None, None),
            (6, "no scheme/at all", None, None), (7, "ftp://x?y://z/", None, None), (8, "http://É.org/", None, None),
            (9, "http://a\nb.org/p\nq?r", None, None), (1, "HTTP://Sub.EXAMPLE.org/es/x?q#f", None, "old"), (10, "", 1, None)]
    got = {r.page_id: r for r in U.judge(_pages(spark, rows), RULES).collect()}
    assert len(got) == 10
    want = {1: ("sub.example.org", "/es/x", "example.org/es/"), 2: ("example.org", "/en/15", "example.org/en/1"),
            3: ("notexample.org", "", None), 4: ("a.com", "/de/1", "com/de/"), 5: ("", "", None), 6: ("", "", None),
            7: ("x", "", None), 8: ("É.org", "/", "org/"), 9: ("a\nb.org", "/p\nq", "org/"), 10: ("", "", None)}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items()} == want
    assert got[1].verdict == "block" and got[8].verdict == "allow" and got[5].verdict in ("allow", "block")


def test_reputation_is_shrunk_and_bounded(spark):
    rows = [(i, f"http://bad.site.net/{i}", 1, None) for i in range(60)] + [(100 + i, f"http://good.site.net/{i}", 0, None) for i in range(60)]
    rows += [(200, "http://one.other.net/", 1, None), (201, "http://new.site.net/", None, None)]
    rows += [(300 + i, f"http://fine{i}.info/", 0, None) for i in range(80)]
    got = {r.page_id: r for r in U.judge(_pages(spark, rows), []).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[300].verdict == "allow"
    assert got[200].bad_low < 0.5 < 1.0 and got[200].verdict == "allow"          # one bad page proves little
    assert got[0].bad_rate < 1.0 and got[100].bad_rate > 0.0                     # pulled towards the domain
    assert 0.2 < got[201].bad_rate < 0.8 and got[201].n_labelled == 0            # the domain's rate


def test_no_rows_and_no_labels(spark):
    assert U.judge(_pages(spark, []), RULES).collect() == []
    got = U.judge(_pages(spark, [(1, "http://a.b/", None, None)]), RULES).collect()
    assert got[0].verdict == "allow"


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, con.execute(f"SELECT {','.join(cols)} FROM ({queries.OP1_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op1_url_filters(spark, sf_small).select(cols).collect()) == want


def test_domains_and_suffixes(spark):
    want = {"a.b.com.cn": ("b.com.cn", "com.cn"), "x.gov.uk": ("x.gov.uk", "gov.uk"), "www.site.co.kr:80": ("site.co.kr", "co.kr"),
            "me.github.io": ("me.github.io", "github.io"), "u@10.0.0.7:8080": ("10.0.0.7", "(address)"), "[::1]": ("[::1]", "(address)"),
            "deep.one.example.org": ("example.org", "org"), "com.cn": ("com.cn", "com.cn"), "plain": ("plain", "plain"), "": ("", "")}
    got = U.with_domains(spark.createDataFrame([(h,) for h in want], "host string"))
    assert {r.host: (r.domain, r.suffix) for r in got.collect()} == want


def test_query_equals_sql_on_other_suffixes(spark, tmp_path):
    hosts = ["a.com.cn", "b.com.cn", "c.github.io", "d.github.io", "10.1.2.3", "10.1.9.3", "x.co.uk", "y.co.uk", "z.org", "[::1]", "u:p@q.net:8080"]
    rows = [(i, f"http://{hosts[i % len(hosts)]}/en/{i}", "") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i % len(hosts) in (0, 2, 4) and i % 7 > 0) ^ 1, 0) for i in range(0, 300, 2)],
                          "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        name = next(p for p in (tmp_path / f"{t}.parquet").iterdir() if p.name.startswith("part"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{name}'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, con.execute(f"SELECT {','.join(cols)} FROM ({queries.OP1_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op1_url_filters(spark, str(tmp_path)).select(cols).collect()) == want
    assert any("'block'" in w for w in want)
