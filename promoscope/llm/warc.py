"""Not-modified revisits of a web archive, resolved to the response they confirm.

A record has ``record_id``, ``url``, ``ts`` (seconds), ``status``, ``headers``
(map of text) and ``payload``. Status 200 is a full response; 304 is a revisit.

1. URLs get a canonical form, so that spellings of one page meet.
2. As-of join: each revisit takes the latest full response of its canonical URL
   that is earlier by (ts, record_id). Times are cut into spans of
   ``span_seconds``: within a span a window finds the response; across spans
   one row per URL and span carries the last response on. Spans with more than
   ``span_rows`` records of a URL are cut between seconds, by count. So a URL with
   a third of all records is spread, also if they fall into one day, and no task
   holds a whole URL (records of one URL and second stay together).
3. The revisit's validators are checked against the response: entity tags by
   weak comparison when both sides have one, else Last-Modified, else none.
4. Headers of the 304 that may update a stored response replace its headers;
   those that describe the missing body or the connection never do.

Defined cases: a revisit without an earlier response is ``orphan``; one whose
validator contradicts the response is ``mismatch`` and gets no payload; neither
side with a comparable validator is ``resolved`` with ``checked_by`` NULL; NULL
headers count as none; a NULL or empty url has the canonical form '' and never
resolves; records with NULL ``ts`` never serve or resolve (``orphan``);
repeated record ids of responses: the one with the smallest payload by order
serves; repeated or NULL record ids of revisits: each row is judged by its own
headers; extra columns of the records are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch
from promoscope.operators.star import sized_broadcast

SPAN_ROWS = 100_000         # records of a URL in a span from which it is cut into parts
SPAN_SECONDS = 86_400
#: Query parameters that say where a visitor came from (fixed values, a parameter of ``canonical_url``).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Headers a 304 never updates: they describe the body that it does not carry, or one connection (fixed values).
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                 "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Host without ``www.``, default port, user or capitals; path without closing slashes; sorted query without
    tracking; no scheme or fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracking))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path),
                     F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", F.lit("")).otherwise(whole)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the last by spelling stays."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(pairs, lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value"), p["key"].alias("spelt")))
    last = F.filter(named, lambda p: ~F.exists(named, lambda o: (o["key"] == p["key"]) & (o["spelt"] > p["spelt"])))
    return F.map_from_arrays(F.transform(last, lambda p: p["key"]), F.transform(last, lambda p: p["value"]))


def merged_headers(stored: Column, update: Column, fixed: tuple[str, ...] = FIXED_HEADERS) -> Column:
    """The stored headers with the 304's permitted ones over them."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*fixed))
    rest = F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def _counted_spans(base: DataFrame, most: int) -> DataFrame:
    """``base`` with ``part``: spans in which a URL has more than ``most`` records are cut, between seconds, into parts of
    about so many. Counts the records of every URL and span (a job); only where some have too many are their seconds
    counted."""
    scratch = Scratch(base.sparkSession, "warc")
    counted = base.groupBy("canonical_url", "span").agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n")
    full = scratch.write(counted.filter((F.col("canonical_url") != "") & F.col("span").isNotNull()), "full-spans")
    if full.isEmpty():
        return base.withColumn("part", F.lit(0).cast("long"))
    seconds = base.join(sized_broadcast(full), ["canonical_url", "span"], "left_semi").groupBy("canonical_url", "span", "ts").agg(F.count("*").alias("n"))
    before = W.partitionBy("canonical_url", "span").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    parts = seconds.withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most)).drop("n")
    parts = sized_broadcast(scratch.write(parts, "parts"))
    return base.join(parts, ["canonical_url", "span", "ts"], "left").withColumn("part", F.coalesce("part", F.lit(0)))


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome, checked_by, response_id, headers, payload."""
    base = (records.filter(F.col("status").isin(200, 304))
            .select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"),
                    (F.col("status") == 200).alias("full"), F.when(F.col("status") == 304, _lower_keys(F.col("headers"))).alias("h1")))
    base = base.withColumn("span", F.floor(F.col("ts") / span_seconds))
    base = _counted_spans(base, span_rows)
    usable = (F.col("canonical_url") != "") & F.col("ts").isNotNull()
    place = F.struct("ts", "record_id")
    # within a span
    inside = W.partitionBy("canonical_url", "span", "part").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = base.filter(usable).withColumn("near", F.last(F.when(F.col("full"), place), ignorenulls=True).over(inside))
    # across spans: the last response before each span, from one row per URL and span
    across = W.partitionBy("canonical_url").orderBy("span", "part").rowsBetween(W.unboundedPreceding, -1)
    carried = (base.filter(usable).groupBy("canonical_url", "span", "part").agg(F.max(F.when(F.col("full"), place)).alias("at"))
               .withColumn("far", F.last("at", ignorenulls=True).over(across)).drop("at"))
    found = (seen.filter(~F.col("full")).join(carried, ["canonical_url", "span", "part"], "left")
             .select("record_id", "canonical_url", "h1", F.coalesce(F.col("near")["record_id"], F.col("far")["record_id"]).alias("response_id")))
    lost = base.filter(~F.col("full") & ~F.coalesce(usable, F.lit(False))).select(
        "record_id", "canonical_url", "h1", F.lit(None).cast(base.schema["record_id"].dataType).alias("response_id"))
    # the responses' validators and bodies, fetched by record id; a revisit brings its own headers along
    stored = (records.filter(F.col("status") == 200)
              .select(F.col("record_id").alias("response_id"), _lower_keys(F.col("headers")).alias("h0"), F.col("payload").alias("p0")))
    twice = W.partitionBy("response_id").orderBy("p0", F.map_entries("h0").cast("string"))
    stored = stored.withColumn("_n", F.row_number().over(twice)).filter("_n = 1").drop("_n")
    # revisits without a response have no key to meet in: they are spread by their own
    spread = lambda *c: F.xxhash64(*c)
    asked = found.unionByName(lost).withColumn("_k", F.when(F.col("response_id").isNotNull(), spread("response_id")).otherwise(
        spread("canonical_url", "record_id")))
    got = asked.join(stored.withColumn("_k", spread("response_id")), ["response_id", "_k"], "left")
    tag = lambda h: F.regexp_replace(F.trim(F.element_at(h, F.lit("etag"))), r"^W/", "")
    date = lambda h: F.trim(F.element_at(h, F.lit("last-modified")))
    by_tag, by_date = tag(F.col("h0")).isNotNull() & tag(F.col("h1")).isNotNull(), date(F.col("h0")).isNotNull() & date(F.col("h1")).isNotNull()
    same = F.when(by_tag, tag(F.col("h0")) == tag(F.col("h1"))).when(by_date, date(F.col("h0")) == date(F.col("h1"))).otherwise(F.lit(True))
    ok = F.col("response_id").isNotNull() & same
    return got.select(
        "record_id", "canonical_url",
        F.when(F.col("response_id").isNull(), F.lit("orphan")).when(same, F.lit("resolved")).otherwise(F.lit("mismatch")).alias("outcome"),
        F.when(F.col("response_id").isNotNull() & by_tag, F.lit("etag"))
        .when(F.col("response_id").isNotNull() & by_date, F.lit("last-modified")).alias("checked_by"),
        "response_id", F.when(ok, merged_headers(F.col("h0"), F.col("h1"))).alias("headers"),
        F.when(ok, F.col("p0")).alias("payload"))
