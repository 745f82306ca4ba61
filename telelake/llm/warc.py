"""WARC: what a not-modified revisit stands for.

Method: not-modified revisit resolution. A revisit whose server answered 304 has no
payload. It is joined as of its date, by canonical URL, to the latest earlier full
response. The validators are checked: an entity tag by weak comparison, else the date of
the last change. If they agree, the stored headers are updated with those that a 304 may
change, and the payload is that of the response.

The as-of join carries the last response along the records of a URL in order of time. The
records are range-partitioned on (URL, date), so a URL with a third of all records is
spread over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.plans.running import with_running

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

# Headers of a 304 that never replace stored ones (content and connection).
NOT_MERGED = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate"
    " proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
DAY = 86_400


def canonical_url(url: Column) -> Column:
    """URL without scheme, user, default port, fragment and tracking parameters.

    Host in lower case, parameters sorted, an empty path is ``/``. Null stays null.
    """
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref)="))
    return F.concat(
        F.regexp_replace(host, r":(?:80|443)?$", ""),
        F.when(path == "", "/").otherwise(path),
        F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(wanted), "&"))).otherwise(""),
    )


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of equal names the last in order of name counts."""
    pairs = F.array_sort(F.map_entries(headers))
    names = F.transform(pairs, lambda e: F.lower(e["key"]))
    last = F.filter(
        F.transform(pairs, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(names, e["i"] + 2, F.size(names)), lambda n: n == e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve(records: DataFrame) -> DataFrame:
    """Every record with ``canonical``, ``outcome``, ``refers_to``, ``headers`` and ``payload_digest``.

    ``records`` has record_id, url, date (timestamp or number), type (response, revisit),
    profile, status, headers (map of text) and payload_digest; more columns stay as they
    are. ``outcome`` is ``response`` for a full response (status 200 with a payload),
    ``resolved``, ``mismatch`` (validators differ), ``unverifiable`` (no validator on both
    sides), ``no_response`` (none earlier), and ``other`` for any other record. Only a
    resolved revisit takes over headers, digest and ``refers_to``; others keep their own.

    A response of the same instant counts as earlier. Among responses of one instant the
    largest record_id counts as latest. Null headers count as none; records without a URL
    or date find no response. Repeated rows are resolved each for itself; an empty table
    stays empty. Columns named like a result are replaced.
    """
    known = ("canonical", "outcome", "refers_to")
    base = records.drop(*[c for c in records.columns if c.lower() in known])
    names = base.columns
    none = F.create_map().cast("map<string,string>")
    base = base.withColumn("headers", _lower_keys(F.coalesce("headers", none)))
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("payload_digest").isNotNull()
    timed = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    asked = (F.col("type") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    base = base.withColumn("canonical", canonical_url(F.col("url"))).withColumn("_full", F.coalesce(full & timed, F.lit(False)))
    stored = F.when(F.col("_full"), F.struct("record_id", "headers", "payload_digest"))
    order = [F.asc("date"), F.desc("_full"), F.asc("record_id")]
    run = with_running(base, ["canonical"], order, before={"_found": stored})

    own, old = F.col("headers"), F.col("_found.headers")
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    changed = lambda h: F.element_at(h, "last-modified")
    agree = F.coalesce(tag(own) == tag(old), changed(own) == changed(old))
    outcome = (
        F.when(full, "response")
        .when(~F.coalesce(asked, F.lit(False)), "other")
        .when(F.col("_found").isNull() | ~timed, "no_response")
        .when(agree.isNull(), "unverifiable")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    allowed = F.map_filter(own, lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    done = F.col("outcome") == "resolved"
    result = {
        "headers": F.when(done, merged).otherwise(own),
        "payload_digest": F.when(done, F.col("_found.payload_digest")).otherwise(F.col("payload_digest")),
    }
    return run.withColumn("outcome", outcome).select(
        *[result[c].alias(c) if c in result else F.col(f"`{c}`") for c in names],
        "canonical",
        "outcome",
        F.when(done, F.col("_found.record_id")).alias("refers_to"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages table: a response for each page and a revisit a day later.

    The page number is the time in minutes. Every fifth revisit carries the tag of another
    version, every seventh only the date of the last change, every eleventh no validator;
    revisits come by the other scheme and bring a new Date and a Content-Length of their own.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    base = pages.select(
        page.alias("page_id"),
        "url",
        (page * 60).alias("seen"),
        F.concat(F.lit('"'), F.md5(html), F.lit('"')).alias("tag"),
        F.concat(F.lit("day "), (page % 1000).cast("string")).alias("changed"),
        F.sha1(html).alias("digest"),
        F.length(html).cast("string").alias("size"),
    )
    text = F.lit
    other = F.when(F.col("url").startswith("http:"), F.concat(text("https:"), F.substr("url", text(6)))).otherwise(
        F.concat(text("http:"), F.substr("url", text(7)))
    )
    response = F.struct(
        F.concat(text("r"), page.cast("string")).alias("record_id"),
        F.col("url").alias("url"),
        F.col("seen").alias("date"),
        text("response").alias("type"),
        text(None).cast("string").alias("profile"),
        text(200).alias("status"),
        F.create_map(
            text("ETag"), F.col("tag"), text("Last-Modified"), F.col("changed"), text("Content-Type"), text("text/html"),
            text("Content-Length"), F.col("size"), text("Date"), F.col("seen").cast("string"),
        ).alias("headers"),
        F.col("digest").alias("payload_digest"),
    )
    validators = (
        F.when(page % 11 == 0, F.create_map(text("Server"), text("s")))
        .when(page % 7 == 0, F.create_map(text("last-modified"), F.col("changed")))
        .when(page % 5 == 0, F.create_map(text("ETag"), text('"other"')))
        .otherwise(F.create_map(text("ETag"), F.concat(text("W/"), F.col("tag"))))
    )
    later = F.col("seen") + DAY
    revisit = F.struct(
        F.concat(text("v"), page.cast("string")).alias("record_id"),
        other.alias("url"),
        later.alias("date"),
        text("revisit").alias("type"),
        text(NOT_MODIFIED).alias("profile"),
        text(304).alias("status"),
        F.map_concat(validators, F.create_map(text("Date"), later.cast("string"), text("Content-Length"), text("0"))).alias("headers"),
        text(None).cast("string").alias("payload_digest"),
    )
    return base.select(F.inline(F.array(response, revisit)))


SQL = """
WITH base AS (SELECT page_id, url, page_id * 60 AS seen, '"' || md5(coalesce(html, '')) || '"' AS tag,
  'day ' || (page_id % 1000) AS changed, sha1(coalesce(html, '')) AS digest, length(coalesce(html, ''))::VARCHAR AS size FROM pages),
shaped AS (SELECT *,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS place,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS wanted FROM base),
named AS (SELECT * EXCLUDE (place, wanted),
  place || CASE WHEN len(wanted) > 0 THEN '?' || array_to_string(wanted, '&') ELSE '' END AS canonical FROM shaped),
records AS (
  SELECT 'r' || page_id AS record_id, canonical, seen AS date, 1 AS full_one, tag, changed, digest, size, page_id, tag AS own_tag,
    changed AS own_changed FROM named
  UNION ALL
  SELECT 'v' || page_id, canonical, seen + 86400, 0, NULL, NULL, NULL, NULL, page_id,
    CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE tag END,
    CASE WHEN page_id % 11 <> 0 AND page_id % 7 = 0 THEN changed END FROM named),
run AS (SELECT *, last_value(CASE WHEN full_one = 1 THEN {'id': record_id, 'tag': tag, 'changed': changed, 'digest': digest, 'size': size} END
  IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY date, full_one DESC, record_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM records),
judged AS (SELECT *, CASE WHEN full_one = 1 THEN 'response' WHEN found IS NULL THEN 'no_response'
  WHEN coalesce(own_tag = found.tag, own_changed = found.changed) IS NULL THEN 'unverifiable'
  WHEN coalesce(own_tag = found.tag, own_changed = found.changed) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM run)
SELECT record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN found.id END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN found.digest ELSE digest END AS payload_digest,
  CASE outcome
    WHEN 'response' THEN 'content-length=' || size || ';content-type=text/html;date=' || date || ';etag=' || tag || ';last-modified=' || changed
    WHEN 'resolved' THEN 'content-length=' || found.size || ';content-type=text/html;date=' || date || ';etag=' ||
      CASE WHEN own_tag IS NULL THEN found.tag ELSE 'W/' || own_tag END || ';last-modified=' || coalesce(own_changed, found.changed)
    ELSE 'content-length=0;date=' || date || CASE WHEN page_id % 11 = 0 THEN ';server=s' WHEN page_id % 7 = 0
      THEN ';last-modified=' || own_changed WHEN page_id % 5 = 0 THEN ';etag=' || own_tag ELSE ';etag=W/' || own_tag END END AS headers
FROM judged
"""
