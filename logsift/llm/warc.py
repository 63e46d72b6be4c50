"""WARC revisit resolution: as-of join of not-modified records to the latest
earlier full response of their canonical URL.

``crawl`` derives records from the pages table: each page is a full response,
and is asked again later, which the server answers with 304; some answers carry
no or a foreign entity tag.  ``resolve`` works on any such records:

* *As-of join* without gathering a URL: per (URL, time bucket) the latest
  response is aggregated, carried forward over the URL's buckets, and within a
  bucket records are ordered by time, so a URL that holds a third of all
  records is spread over its buckets.  At equal times the response with the
  larger record_id is later, and a response at the time of a revisit counts.
* *Validators*: entity tags on both sides must be equal by weak comparison
  (``W/`` does not count; an empty tag is none); without them, Last-Modified on
  both sides: the response's must not be newer than the revisit's, which repeats
  it as a rule.  Where no validator stands on both sides nothing disagrees.
* *Headers*: those that a 304 may update (``UPDATED``) come from the revisit
  where it has them, all others from the response; names are lower-cased.

Status: resolved, mismatch (validators disagree) or orphan (no earlier full
response).  Edge cases: records without URL or time are orphans and take no part
in the windows; null html is an empty body; null validators and headers are
absent ones; repeated rows are records of their own; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# headers that a 304 answer may update (RFC 9110, 15.4.5; fixed values)
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
BUCKET_S = 6 * 3600


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, ``ref`` or
    ``utm_`` parameter or trailing slash."""
    head = F.lower(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*", 0))
    head = F.regexp_replace(head, "^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "")
    rest = F.regexp_replace(rest, "([?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    rest = F.regexp_replace(rest, "&&+", "&")
    rest = F.regexp_replace(F.regexp_replace(rest, "\\?&", "?"), "[?&/]+$", "")
    return F.concat(head, rest)


def crawl(pages: DataFrame) -> DataFrame:
    """Records (record_id, kind, url, time, etag, last_modified, digest, headers)."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("id", "url", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
    t, i = F.col("id") * 60, F.col("id")
    quoted = F.concat(F.lit('"'), "digest", F.lit('"'))
    full = p.select(
        (i * 2).alias("record_id"), F.lit("response").alias("kind"), "url", t.alias("time"),
        F.when(i % 3 != 2, quoted).alias("etag"), (t - 600).alias("last_modified"), "digest",
        F.create_map(F.lit("Date"), t.cast("string"), F.lit("ETag"), quoted,
                     F.lit("Content-Length"), F.col("size").cast("string"), F.lit("Server"), F.lit("a")).alias("headers"))
    later = t + 3600 * (1 + i % 48)
    tag = (F.when(i % 7 == 1, F.concat(F.lit('"'), F.md5("url"), F.lit('"'))).when(i % 7 == 2, F.lit(""))
           .when(i % 7 == 3, F.concat(F.lit("W/"), quoted)).when(i % 7 != 0, quoted))
    # the server repeats the date of the page, or gives an older one
    modified = F.when(i % 2 == 0, F.when(i % 5 == 0, t - 1200).otherwise(t - 600))
    again = p.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("time"),
        tag.alias("etag"), modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.map_filter(F.create_map(F.lit("DATE"), later.cast("string"), F.lit("etag"), tag, F.lit("content-length"),
                                  F.lit("0")), lambda k, v: v.isNotNull()).alias("headers"))
    return full.union(again)


def weak_tag(etag: Column) -> Column:
    """An entity tag for weak comparison; none if it is empty."""
    bare = F.regexp_replace(F.trim(etag), "^W/", "")
    return F.when(~bare.isin("", '""'), bare)


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then meet the last stays."""
    return F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                                          lambda e: F.struct(F.lower(e["key"]), e["value"])))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url (canonical), refers_to, status,
    digest, headers."""
    r = records.select("record_id", "kind", "time", weak_tag(F.col("etag")).alias("etag"), "last_modified", "digest",
                       _lower_names(F.col("headers")).alias("headers"), canonical(F.col("url")).alias("url"))
    placed = F.col("url").isNotNull() & F.col("time").isNotNull()
    lost = r.where(~placed & (F.col("kind") == "revisit")).select(
        "record_id", "url", F.lit(None).cast(r.schema["record_id"].dataType).alias("refers_to"),
        F.lit("orphan").alias("status"), F.lit(None).cast("string").alias("digest"), "headers")
    r = r.where(placed).withColumn("bucket", F.floor(F.col("time") / BUCKET_S))
    thin = F.struct("time", "record_id", "etag", "last_modified", "digest", F.to_json("headers").alias("headers"))
    r = r.withColumn("full", F.when(F.col("kind") == "response", thin))
    last = r.groupBy("url", "bucket").agg(F.max("full").alias("newest"))
    by_bucket = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("newest", ignorenulls=True).over(by_bucket)).drop("newest")
    inside = Window.partitionBy("url", "bucket").orderBy("time", F.col("kind") == "revisit", "record_id").rowsBetween(
        Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    found = near.join(carried, ["url", "bucket"], "left").withColumn("f", F.coalesce("near", "carried"))
    good = F.coalesce(F.col("etag") == F.col("f.etag"), F.col("f.last_modified") <= F.col("last_modified"), F.lit(True))
    status = F.when(F.col("f").isNull(), "orphan").when(good, "resolved").otherwise("mismatch")
    old = F.from_json("f.headers", "map<string,string>")
    new = F.map_filter("headers", lambda k, v: k.isin(UPDATED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return found.withColumn("status", status).select(
        "record_id", "url", F.when(F.col("status") != "orphan", F.col("f.record_id")).alias("refers_to"), "status",
        F.when(F.col("status") == "resolved", F.col("f.digest")).alias("digest"),
        F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers")).union(lost)


def op9_warc_revisits(spark, sf_dir):
    out = resolve(crawl(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url", "refers_to", "status", "digest", *[
        F.col("headers")[h].alias(h.replace("-", "_")) for h in ("content-length", "date", "etag", "server")])


OP9_SQL = r"""
WITH p AS (SELECT page_id AS id, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size, url AS raw,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')), '^(http://[^:]*):80$|^(https://[^:]*):443$', '\1\2') AS head,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', ''),
    '([?&])(ref|utm_[a-z]+)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS rest FROM pages),
f AS (SELECT id * 2 AS rid, head || rest AS url, id * 60 AS t, digest, size, CASE WHEN id % 3 <> 2 THEN '"' || digest || '"' END AS tag,
  id * 60 - 600 AS lm FROM p),
r AS (SELECT id * 2 + 1 AS record_id, head || rest AS url, id * 60 + 3600 * (1 + id % 48) AS t,
  CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '"' || md5(raw) || '"' WHEN 2 THEN '' WHEN 3 THEN 'W/"' || digest || '"' ELSE '"' || digest || '"' END AS sent,
  CASE WHEN id % 2 = 0 THEN id * 60 - (CASE WHEN id % 5 = 0 THEN 1200 ELSE 600 END) END AS lm FROM p),
w AS (SELECT *, nullif(regexp_replace(sent, '^W/', ''), '') AS tag FROM r),
j AS (SELECT w.*, f.rid, f.tag AS ftag, f.lm AS flm, f.digest, f.size,
  row_number() OVER (PARTITION BY w.record_id ORDER BY f.t DESC, f.rid DESC) AS n FROM w LEFT JOIN f ON f.url = w.url AND f.t <= w.t),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN tag IS NOT NULL AND ftag IS NOT NULL AND tag <> ftag THEN 'mismatch'
  WHEN (tag IS NULL OR ftag IS NULL) AND flm > lm THEN 'mismatch' ELSE 'resolved' END AS status FROM j WHERE n = 1)
SELECT record_id, url, rid AS refers_to, status, CASE WHEN status = 'resolved' THEN digest END AS digest,
  CASE WHEN status = 'resolved' THEN CAST(size AS VARCHAR) ELSE '0' END AS content_length, CAST(t AS VARCHAR) AS date,
  CASE WHEN status = 'resolved' THEN coalesce(sent, '"' || digest || '"') ELSE sent END AS etag,
  CASE WHEN status = 'resolved' THEN 'a' END AS server FROM s
"""
