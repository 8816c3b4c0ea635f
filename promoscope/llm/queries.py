"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.llm import (
    centroids, ctw, decontam, divergence, fingerprints, itq, langid, line_dedup, ngram_join, quality, spm, url_filters, warc)
from promoscope.llm.common import Scratch, crc_remainder, table


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path numbers: bad when of low quality or toxic."""
    labels = (table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc"))
              .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("path", r"/(\d{1,18})", 1)
    pages = (url_filters.with_host_path(pages).withColumn("_doc", F.nullif(number, F.lit("")).cast("long"))
             .join(labels, "_doc", "left"))
    return (url_filters.judge(pages, URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


#: The same rules, counts and priors in DuckDB SQL.
OP1_SQL = r"""
WITH rules(rule, says, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
  ('com/de/', 'block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r, row_number() OVER () AS rid FROM pages),
hp AS (SELECT page_id, rid, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id),
parts AS (SELECT hp.*, lab.bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
    FROM hp LEFT JOIN lab ON lab.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') AS BIGINT)),
two AS (SELECT *, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS last2, regexp_matches(bare, '^\d+([.]\d+){3}$|^\[') AS address FROM parts),
long AS (SELECT *, regexp_matches(last2, '^(ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org)[.][a-z][a-z]$') OR last2 IN ('blogspot.com', 'github.io',
    'gitlab.io', 'netlify.app', 'pages.dev', 'vercel.app', 'wordpress.com') AS long FROM two),
named AS (SELECT *, CASE WHEN address THEN bare WHEN long THEN array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') ELSE last2 END AS domain,
    CASE WHEN address THEN '(address)' WHEN long THEN last2 ELSE list_extract(string_split(bare, '.'), -1) END AS suffix FROM long),
hosts AS (SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM named GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s0 AS (SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS p FROM suffixes),
sm AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 50.0 ELSE least(1000.0, greatest(2.0,
    sum(n * p * (1 - p)) / sum(n) / greatest(1e-4, (sum(n * pow(k / n - p, 2)) - sum(p * (1 - p))) / (sum(n) - count(*))) - 1)) END AS m
    FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (k + m * p) / (n + m) AS rate FROM s0, sm),
d0 AS (SELECT d.*, s1.rate AS p FROM domains d JOIN s1 USING (suffix)),
dm AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 50.0 ELSE least(1000.0, greatest(2.0,
    sum(n * p * (1 - p)) / sum(n) / greatest(1e-4, (sum(n * pow(k / n - p, 2)) - sum(p * (1 - p))) / (sum(n) - count(*))) - 1)) END AS m
    FROM d0 WHERE n > 0),
d1 AS (SELECT domain, suffix, (k + m * p) / (n + m) AS rate FROM d0, dm),
h0 AS (SELECT h.*, d1.rate AS p FROM hosts h JOIN d1 USING (domain, suffix)),
hm AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 50.0 ELSE least(1000.0, greatest(2.0,
    sum(n * p * (1 - p)) / sum(n) / greatest(1e-4, (sum(n * pow(k / n - p, 2)) - sum(p * (1 - p))) / (sum(n) - count(*))) - 1)) END AS m
    FROM h0 WHERE n > 0),
h1 AS (SELECT host, n + m AS w, (k + m * p) / (n + m) AS rate FROM h0, hm),
fit AS (SELECT rid, rule, says, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule) AS place
    FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, hp.host, path, rule, coalesce(says,
    CASE WHEN greatest(0.0, rate - 2.0 * sqrt(rate * (1 - rate) / (w + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM hp JOIN h1 USING (host) LEFT JOIN fit ON fit.rid = hp.rid AND place = 1
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
    return got.select("doc_id", "n_shingles", "component_id", "n_copies")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl derived from ``pages``: each page is fetched once in full, and asked for again some days later.
    Some of the later answers have another entity tag, only a date, or come before the first fetch."""
    stamp = lambda c: F.concat(F.lit("day "), c.cast("string"))
    page, first = F.col("page_id"), F.col("page_id") * 60
    body = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body), 1, 16), F.lit('"'))
    full = pages.select(
        (page * 2).alias("record_id"), "url", first.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), stamp(F.floor(page / 100)), F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Content-Length"), F.length(body).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        body.alias("payload"))
    later = F.when(page % 13 == 5, first - 30).otherwise(first + 86400 * (1 + page % 3))
    headers = (F.when(page % 10 == 0, F.create_map(F.lit("last-modified"), stamp(F.floor(page / 100)), F.lit("Date"), stamp(F.floor(later / 86400))))
               .when(page % 17 == 3, F.create_map(F.lit("etag"), F.lit('"other"'), F.lit("Date"), stamp(F.floor(later / 86400))))
               .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=600"),
                                       F.lit("Content-Length"), F.lit("0"))))
    again = pages.select((page * 2 + 1).alias("record_id"), F.regexp_replace("url", "^https?:", "HTTPS:").alias("url"),
                         later.alias("ts"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.select("record_id", "canonical_url", "outcome", "checked_by", "response_id",
                      F.array_join(lines, "; ").alias("headers"), F.md5("payload").alias("payload_md5"))


#: The derived crawl and its resolution in DuckDB SQL.
OP3_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, page_id * 60 AS first_ts,
    CASE WHEN page_id % 13 = 5 THEN page_id * 60 - 30 ELSE page_id * 60 + 86400 * (1 + page_id % 3) END AS later,
    regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages),
parts AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/?#]*')), '^.*@', ''), ':(80|443)?$', ''), '^www[.]', '') AS host,
    regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*[?]([^#]*)', 1), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM p),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url FROM parts),
f AS (SELECT canonical_url, first_ts AS ts, page_id * 2 AS response_id, '"' || left(md5(body), 16) || '"' AS tag,
    'day ' || (page_id // 100) AS modified, body FROM c WHERE canonical_url <> ''),
v AS (SELECT canonical_url, later AS ts, page_id * 2 + 1 AS record_id, 'day ' || (later // 86400) AS date, 'day ' || (page_id // 100) AS modified,
    CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 17 = 3 THEN '"other"' ELSE '"' || left(md5(body), 16) || '"' END AS tag FROM c),
j AS (SELECT v.*, f.response_id, f.tag AS ftag, f.modified AS fmod, f.body,
    row_number() OVER (PARTITION BY record_id ORDER BY f.ts DESC NULLS LAST, f.response_id DESC NULLS LAST) AS place
    FROM v LEFT JOIN f ON f.canonical_url = v.canonical_url AND (f.ts < v.ts OR f.ts = v.ts AND f.response_id < v.record_id)),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN tag = ftag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified = fmod THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE place = 1)
SELECT record_id, canonical_url, outcome,
    CASE WHEN response_id IS NULL THEN NULL WHEN tag IS NOT NULL THEN 'etag' ELSE 'last-modified' END AS checked_by, response_id,
    CASE WHEN outcome = 'resolved' THEN CASE WHEN tag IS NULL
        THEN 'cache-control: max-age=60; content-length: ' || length(body) || '; content-type: text/html; date: ' || date || '; etag: ' || ftag || '; last-modified: ' || modified
        ELSE 'cache-control: max-age=600; content-length: ' || length(body) || '; content-type: text/html; etag: W/' || tag || '; last-modified: ' || fmod END END AS headers,
    CASE WHEN outcome = 'resolved' THEN md5(body) END AS payload_md5
FROM o
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", "text")


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id", 10) == 0
    scratch = Scratch(spark, "ctw")
    model, words = ctw.fit(docs.filter(~held_out), scratch)
    return (ctw.score(docs, model, words, scratch)
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    "n_bytes", "bits_per_byte"))


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The piece model: a file of a public tokenizer, a parameter of the queries.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Sampled pieces of every text, their number, and whether decoding them gives the text back."""
    vocabulary = spm.Vocabulary.load(model)
    docs = spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, verify="lossless")
    return docs.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"), "pieces", "lossless")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 5) == 0
    model = langid.fit(docs, where=~held_out)
    return (langid.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.annotate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"), "matches")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return (quality.score(docs, model)
            .select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = fingerprints.edited_by_next(table(spark, sf_dir, "documents"))
    return met.select("doc_id", "n_chars", "edited_sha256",
                      fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
                      fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                      fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: The same audit in DuckDB SQL, over every term of every group.
OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY t.lang, t.source, t.term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
g AS (SELECT d.lang, d.source, coalesce(max(sizes.size), 0) AS size FROM d LEFT JOIN sizes ON sizes.lang = d.lang AND sizes.source = d.source
    GROUP BY d.lang, d.source),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // CAST(g.size + 2 * langs.v AS HUGEINT) AS p,
    1 + (1000000000 * CAST(kept.total + 2 AS HUGEINT)) // CAST(langs.size + 2 * langs.v AS HUGEINT) AS q
    FROM g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
met AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM every a JOIN every b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(met.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM every WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = centroids.ROUNDS) -> str:
    """Ten rounds over every vector and centroid, as one chain of tables."""
    nearest = "SELECT rid, num, d FROM (SELECT rid, num, d, row_number() OVER (PARTITION BY rid ORDER BY d, num) AS place FROM d{0}) WHERE place = 1"
    far = ("d{0} AS MATERIALIZED (SELECT e.rid, c.num, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d "
           "FROM e JOIN c{0} c ON c.i = e.i GROUP BY e.rid, c.num)")
    parts = [r"""good AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM good),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS num FROM good),
c0 AS MATERIALIZED (SELECT seeds.num, e.i, e.x FROM seeds JOIN e ON e.rid = seeds.rid WHERE seeds.num < 8)"""]
    for r in range(rounds):
        parts += [far.format(r), f"a{r} AS MATERIALIZED ({nearest.format(r)})",
                  f"m{r} AS MATERIALIZED (SELECT a.num, e.i, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN e ON e.rid = a.rid GROUP BY a.num, e.i)",
                  f"c{r + 1} AS MATERIALIZED (SELECT c.num, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x "
                  f"FROM c{r} c LEFT JOIN m{r} m ON m.num = c.num AND m.i = c.i)"]
    last = rounds
    parts += [far.format(last), f"a{last} AS MATERIALIZED ({nearest.format(last)})",
              f"s AS (SELECT num, sum(d) AS inertia FROM a{last} GROUP BY num)",
              f"h AS (SELECT num, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{last} GROUP BY num)"]
    return ("WITH " + ",\n".join(parts) + f"""
SELECT good.vec_id, CAST(a.num AS INTEGER) AS cluster, a.d AS distance, CAST(s.inertia AS BIGINT) AS cluster_inertia,
    CAST((SELECT sum(inertia) FROM s) AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM good JOIN a{last} a ON a.rid = good.rid JOIN s ON s.num = a.num JOIN h ON h.num = a.num
""")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_ngram_join": op2_ngram_join,
        "op3_revisits": op3_revisits,
        "op4_line_dedup": op4_line_dedup,
        "op5_ctw": op5_ctw,
        "op6_itq": op6_itq,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_langid": op8_langid,
        "op9_decontam": op9_decontam,
        "op10_quality": op10_quality,
        "op11_fingerprints": op11_fingerprints,
        "op12_divergence": op12_divergence,
        "op13_centroids": op13_centroids,
    }


def oracle_queries() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_revisits": OP3_SQL, "op12_divergence": OP12_SQL, "op13_centroids": _op13_sql()}
