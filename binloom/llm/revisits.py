"""Resolution of not-modified revisit records of web archives.

A revisit stands for the latest full response before it under the same canonical URL. It counts if a validator agrees: the
entity tag (weakly compared), else the modification date, else the payload digest. Its headers are the response's, with
those that a not-modified answer may update replaced by its own.

The as-of join runs within time spans of a URL: in each span a window carries the last response on, and a revisit before
the first response of its span takes the last of the spans before, from a table of one row per URL and span. A URL with a
third of all records is dealt over its spans. Bodies are not moved.

Defined results: of responses at one time the one with the largest id is the latest; a response at the revisit's own time
is not earlier. Records without a URL or a time resolve to nothing. Null headers count as none; header names are compared
without case. Repeated rows are resolved each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Fixed: headers that describe the stored message itself, which a not-modified answer doesn't update.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "trailer", "transfer-encoding", "upgrade"]
#: Fixed: query parameters that don't name a resource.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)"
#: A URL's records of so long a time are in one task.
SPAN_SECONDS = 300


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, no scheme, fragment or tracking parameters, parameters sorted, no last slash."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"\?.*$", "")
    query = F.regexp_replace(bare, r"^[^?]*\??", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(?:=|$)")))
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """One entry per lower-case name, the last of several."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e: F.lit(True))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(last, lambda e: e["key"] == n), -1)))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, kind ('response' or 'revisit'), url, at (timestamp), digest, headers (map). One row per revisit:

    record_id, canonical_url, refers_to, status ('resolved', 'unchecked', 'mismatch' or 'missing'), headers. refers_to and
    headers are null unless resolved or unchecked (no validator on one of the two sides).
    """
    headers = _lowered(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    r = records.where("kind in ('response', 'revisit')").select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), "at", "digest", headers.alias("headers"))
    # what has no URL or no time meets nothing, and isn't gathered under a null
    named = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    lone = r.where(~named & (F.col("kind") == "revisit"))
    r = r.where(named).withColumn("span", F.floor(F.unix_seconds("at") / SPAN_SECONDS))
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "digest", "headers"))
    # by time; at one time revisits come first, so that a response isn't earlier than they are
    by = Window.partitionBy("canonical_url", "span").orderBy("at", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = r.withColumn("found", F.last(full, ignorenulls=True).over(by)).where("kind = 'revisit'")
    last = r.where("kind = 'response'").groupBy("canonical_url", "span").agg(F.max_by(F.struct("at", "record_id", "digest", "headers"), F.struct("at", "record_id")).alias("end"))
    # of each span that has revisits, the last response of the spans before
    spans = last.unionByName(r.where("kind = 'revisit'").select("canonical_url", "span").distinct(), allowMissingColumns=True).groupBy("canonical_url", "span").agg(F.first("end", ignorenulls=True).alias("end"))
    ahead = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select("canonical_url", "span", F.last("end", ignorenulls=True).over(ahead).alias("before"))
    out = here.join(before, ["canonical_url", "span"], "left")
    out = out.withColumn("found", F.coalesce("found", "before"))
    out = out.unionByName(lone, allowMissingColumns=True)

    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    pairs = [(tag(F.col("headers")), tag(F.col("found.headers"))), (F.trim(F.col("headers")["last-modified"]), F.trim(F.col("found.headers")["last-modified"])), (F.col("digest"), F.col("found.digest"))]
    agrees = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    status = F.when(F.col("found").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    usable = F.col("status").isin("resolved", "unchecked")
    own = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False))), own)
    out = out.withColumn("status", status)
    return out.select("record_id", "canonical_url", F.when(usable, F.col("found.record_id")).alias("refers_to"), "status", F.when(usable, merged).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved revisits with the body (record_id, body) of the response that each refers to."""
    return resolved.join(bodies.select(F.col("record_id").alias("refers_to"), "body"), "refers_to", "left")


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl's records made of pages: each page as a response, a revisit ten minutes before and one two hours after it.

    The revisits name the page by a variant of its URL and carry its entity tag; page ids are minutes.
    """
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("page_id") + minutes) * 60)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    full = F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Age"), F.lit("0"))
    short = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.lit("60"), F.lit("Date"), F.col("page_id").cast("string"))
    other = F.concat(F.col("url"), F.lit("#again"))
    row = lambda n, kind, minutes, url, headers: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at(minutes).alias("at"), F.lit(None).cast("string").alias("digest"), headers.alias("headers")
    )
    rows = F.array(row(0, "revisit", -10, other, short), row(1, "response", 0, F.col("url"), full), row(2, "revisit", 120, other, short))
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "canonical_url", "refers_to", "status", shown.alias("headers"))


OP9_SQL = r"""
with bare as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as b from pages),
parts as (
  select page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '') as host,
    regexp_replace(regexp_replace(regexp_replace(b, '^[^/?]*', ''), '\?.*$', ''), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_replace(b, '^[^?]*\??', ''), '&'),
      lambda p: p <> '' and not regexp_matches(p, '(?i)^(?:utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)(?:=|$)'))) as q
  from bare),
named as (
  select page_id, '"' || md5(coalesce(html, '')) || '"' as tag, cast(strlen(html) as varchar) as size,
    host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as u
  from parts),
revisits as (
  select page_id * 4 as record_id, page_id, page_id - 10 as at, u, tag from named
  union all select page_id * 4 + 2, page_id, page_id + 120, u, tag from named),
latest as (
  select r.record_id, max(n.page_id) as resp from revisits r join named n on n.u = r.u and n.page_id < r.at group by 1),
found as (
  select r.record_id, r.page_id, r.u, r.tag, n.page_id as resp, n.tag as rtag, n.size
  from revisits r left join latest l on l.record_id = r.record_id left join named n on n.page_id = l.resp)
select record_id, u as canonical_url, case when tag = rtag then resp * 4 + 1 end as refers_to,
  case when resp is null then 'missing' when tag = rtag then 'resolved' else 'mismatch' end as status,
  case when tag = rtag then 'age: 60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || cast(page_id as varchar) || chr(10) || 'etag: W/' || tag end as headers
from found
"""
