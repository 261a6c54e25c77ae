"""WARC not-modified revisits, resolved to the full response they stand for.

A revisit record has no body of its own. It is joined as of its time to the
latest earlier full response of the same canonical URL, its validators are
checked against that response's (entity tag, payload digest, last-modified
time), and if they agree the headers a not-modified answer may renew replace
the stored ones.

The as-of join range-partitions the slim columns (URL, time, id), so that a URL
with a third of all records is spread over many partitions; each takes the last
response of its own rows and, where there is none, that of the partitions before
it, of which a URL has one row each. Headers are joined afterwards by record id.

Defined results: a null URL or time resolves to nothing; at equal times the
smaller record id is earlier; validators that only one side has are not checked,
and a revisit without any checked one is "unverified" and keeps its own headers;
repeated record ids each give their own row, and a revisit meets the response of its own URL and time; of responses
with one id, URL and time the first by their content counts; an empty table gives no rows; header names compare in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import stored, table

# fixed values: headers that a not-modified answer may renew, and parameters that do not change a page
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and port, path without end slash, query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    for pattern, into in (("&&+", "&"), (r"\?&", "?"), ("[?&]$", ""), (r"/(\?|$)", "$1")):
        rest = F.regexp_replace(rest, pattern, into)
    return F.concat(host, rest)


def asof_response(records: DataFrame) -> DataFrame:
    """(record_id, key, ts, response_id, response_ts) of every revisit in records (record_id, key, ts, kind)."""
    order = ["ts", "record_id"]
    placed = stored(records.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "placed")
    response = F.when(F.col("kind") == "response", F.struct(*order))
    inside = Window.partitionBy("key", "part").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("near", F.last(response, ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row for each partition
    tails = (placed.groupBy("key", "part").agg(F.max(response).alias("tail"))
             .withColumn("far", F.max("tail").over(before)).select("key", "part", "far"))
    return seen.join(tails, ["key", "part"]).select(
        "record_id", "key", "ts", F.coalesce("near.record_id", "far.record_id").alias("response_id"),
        F.coalesce("near.ts", "far.ts").alias("response_ts"))


def _tag(column: Column) -> Column:
    return F.regexp_replace(column, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, response_id, outcome, headers) of each revisit.

    records: record_id, url, ts, kind ('response' or 'revisit'), etag, digest,
    last_modified and headers (map); further columns are left out.
    """
    keyed = records.withColumn("key", canonical_url(F.col("url")))
    slim = keyed.select("record_id", "key", "ts", "kind").filter(
        F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()).distinct()
    # record ids may be repeated: a record is its id, canonical URL and time
    found = asof_response(slim).filter("response_id IS NOT NULL").select(
        *[F.col(c).alias(f"_of_{c}") for c in ("record_id", "key", "ts")], "response_id", "response_ts").distinct()
    fields = ("etag", "digest", "last_modified", "headers")
    # of responses equal in all three, the first by their validators and headers
    full = (keyed.filter("kind = 'response'")
            .select(F.col("record_id").alias("_full"), F.col("key").alias("_key"), F.col("ts").alias("_ts"),
                    F.struct(*[F.col(c) for c in fields[:3]], F.array_sort(F.map_entries("headers")).alias("headers")).alias("_r"))
            .groupBy("_full", "_key", "_ts").agg(F.min("_r").alias("_r"))
            .select("_full", "_key", "_ts", *[F.col(f"_r.{c}").alias(f"_{c}") for c in fields[:3]], F.map_from_entries("_r.headers").alias("_headers")))
    joined = (keyed.filter("kind = 'revisit'")
              .join(found, [F.col(c) == F.col(f"_of_{c}") for c in ("record_id", "key", "ts")], "left")
              .join(full, (F.col("response_id") == F.col("_full")) & (F.col("key") == F.col("_key")) & (F.col("response_ts") == F.col("_ts")), "left"))
    wrong = lambda a, b: F.coalesce(a != b, F.lit(False))
    both = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
    outcome = (F.when(F.col("_full").isNull(), "no_response")
               .when(wrong(_tag(F.col("etag")), _tag(F.col("_etag"))), "etag_mismatch")
               .when(wrong(F.col("digest"), F.col("_digest")), "digest_mismatch")
               .when(wrong(F.col("last_modified"), F.col("_last_modified")), "modified")
               .when(both("etag") | both("digest") | both("last_modified"), "resolved").otherwise("unverified"))
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    new = F.map_filter(lower(F.col("headers")), lambda k, _: k.isin(*RENEWED))
    old = F.map_filter(lower(F.col("_headers")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return joined.withColumn("outcome", outcome).select(
        "record_id", "response_id", "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(old, new)).otherwise(F.col("headers")).alias("headers"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """The pages as a crawl: each is fetched in full and asked for again later, with one kind of validator or none."""
    p, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag, digest = F.md5(html), F.sha1(html)
    day = F.concat(F.lit("day "), F.pmod(p, F.lit(28)).cast("string"))
    full = pages.select(
        (2 * p).alias("record_id"), "url", (60 * p).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"),
        digest.alias("digest"), day.alias("last_modified"), F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(html).cast("string"),
            F.lit("ETag"), tag, F.lit("Date"), F.concat(F.lit("t"), (60 * p).cast("string"))).alias("headers"))
    again = 60 * p + 600 * (1 + F.pmod(p, F.lit(5)))
    kind = F.pmod(p, F.lit(4))
    asked = pages.select(
        (2 * p + 1).alias("record_id"), F.concat(F.col("url"), F.when(p % 3 == 0, "#again").otherwise("")).alias("url"),
        again.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(kind == 0, F.concat(F.lit("W/"), tag)).when(kind == 1, F.reverse(tag)).alias("etag"),
        F.when(kind == 2, digest).alias("digest"), F.lit(None).cast("string").alias("last_modified"), F.create_map(
            F.lit("Date"), F.concat(F.lit("t"), again.cast("string")), F.lit("Server"), F.lit("new")).alias("headers"))
    return full.union(asked)


def op2_revisits(spark, sf_dir: str) -> DataFrame:
    done = resolve(crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))
    return done.select("record_id", "response_id", "outcome", F.array_join(F.array_sort(entries), "; ").alias("headers"))


OP2_SQL = r"""
WITH bare AS (SELECT page_id AS p, coalesce(html, '') AS h,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '') AS u FROM pages),
cut AS (SELECT p, h,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '\1', 'g') AS r FROM bare),
keyed AS (SELECT p, h, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '&&+', '&', 'g'),
    '\?&', '?', 'g'), '[?&]$', ''), '/(\?|$)', '\1', 'g') AS k FROM cut),
asked AS (SELECT p, h, k, 60 * p + 600 * (1 + p % 5) AS ts FROM keyed),
found AS (SELECT a.p, a.h, a.ts, max(f.p) AS q FROM asked a LEFT JOIN keyed f
    ON a.k = f.k AND (60 * f.p < a.ts OR (60 * f.p = a.ts AND 2 * f.p < 2 * a.p + 1)) GROUP BY 1, 2, 3),
checked AS (SELECT f.p, f.ts, f.q, r.h AS rh, CASE WHEN f.q IS NULL THEN 'no_response'
    WHEN f.p % 4 = 0 AND md5(f.h) <> md5(r.h) THEN 'etag_mismatch'
    WHEN f.p % 4 = 1 AND reverse(md5(f.h)) <> md5(r.h) THEN 'etag_mismatch'
    WHEN f.p % 4 = 2 AND f.h <> r.h THEN 'digest_mismatch'
    WHEN f.p % 4 = 3 THEN 'unverified' ELSE 'resolved' END AS outcome FROM found f LEFT JOIN keyed r ON f.q = r.p)
SELECT 2 * p + 1 AS record_id, 2 * q AS response_id, outcome, CASE WHEN outcome = 'resolved'
  THEN 'content-length=' || length(rh) || '; content-type=text/html; date=t' || ts || '; etag=' || md5(rh)
  ELSE 'date=t' || ts || '; server=new' END AS headers FROM checked"""
