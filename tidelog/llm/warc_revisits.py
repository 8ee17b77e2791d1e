r"""WARC: resolution of revisit records that say "not modified".

A revisit stands for the latest earlier full response (status 200) of the same canonical URL, if the validators agree:
entity tags are compared weakly when both have one, else modification dates when both have one. The response's headers
are then updated by the revisit's, but for those that a 304 may not change: hop-by-hop fields and those that describe
the stored body.

The as-of join has two levels, so that one URL with a third of all records is still many tasks' work: inside a bucket of
time the last response before a record is a running value; before it, the last one of the bucket that has any. Only
numbers of records travel there; headers are joined by them afterwards, and payloads never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

#: Header fields that a 304 response must not change (RFC 9110, 7.6.1; RFC 9111, 3.2).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
BUCKET_SECONDS = 86_400


def canonical_url(uri: Column) -> Column:
    """host/path?query of an absolute URL: without scheme, fragment, default ports, a leading www., trailing slashes and
    utm_ parameters, host in lower case, parameters sorted; null for null."""
    u = F.regexp_replace(uri, "#.*$", "")
    lead = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, lead + "([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(u, lead + "[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    params = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))


def header_fields(block: Column) -> Column:
    """array<struct<key, name, value>> of a header block: one field a line after the status line; key is the name in lower case."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("key"), F.substring_index(x, ":", 1).alias("name"), F.btrim(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("value")))


def _field(fields: Column, key: str) -> Column:
    return F.get(F.filter(fields, lambda x: x["key"] == key), F.lit(0))["value"]


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Header lines, sorted by name in lower case, then as they came: the stored ones without those that fresh replaces, and
    fresh ones that a 304 may change."""
    allowed = F.filter(fresh, lambda x: ~x["key"].isin(*KEPT_FIELDS))
    keys = F.transform(allowed, lambda x: x["key"])
    lines = lambda a: F.transform(a, lambda x, i: F.struct(x["key"].alias("k"), i.alias("i"), F.concat(x["name"], F.lit(": "), x["value"]).alias("l")))
    both = let(keys, lambda k: F.concat(lines(F.filter(stored, lambda x: ~F.array_contains(k, x["key"]))), lines(allowed)))
    return F.array_join(F.transform(F.array_sort(both), lambda x: x["l"]), "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit of records (record_id, warc_type, target_uri, warc_date timestamp, header_block): record_id, url,
    state, response_id, headers.

    state is ``resolved``, ``mismatch`` (validators differ), ``no_validator`` (none that both have) or ``no_response``.
    response_id is the latest earlier response's unless there is none; earlier is by (warc_date, record_id). headers are merged
    when resolved, null otherwise. Null URLs or dates have no response; null types and types other than ``response`` with
    status 200 and ``revisit`` have no part. Rows that repeat a record_id come each; a response that repeats one counts
    with its smallest header block. Extra columns aren't read. An empty table gives none.
    """
    r = records.select("record_id", "warc_type", F.col("warc_date").alias("at"), canonical_url(F.col("target_uri")).alias("url"), "header_block")
    full = (F.col("warc_type") == "response") & F.col("header_block").rlike(r"^HTTP/[0-9.]+ 200\b")
    r = r.where((F.col("warc_type") == "revisit") | full).withColumn("full", full)
    keyed = r.where("url IS NOT NULL AND at IS NOT NULL").select("record_id", "url", "at", "full", F.floor(F.unix_micros("at") / (BUCKET_SECONDS * 1_000_000)).alias("bucket"))
    mine = F.when(F.col("full"), F.struct("at", "record_id"))
    last_of = keyed.groupBy("url", "bucket").agg(F.max(mine).alias("last"))
    carried = last_of.select("url", "bucket", F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("at", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last(mine, ignorenulls=True).over(inside)).where("NOT full")
    found = near.join(carried, ["url", "bucket"]).select("record_id", "url", "at", F.coalesce("near", "carried")["record_id"].alias("response_id")).distinct()
    revisits = r.where("NOT full").select("record_id", "url", "at", "header_block")
    both = revisits.alias("r").join(found.alias("f"), (F.col("r.record_id") == F.col("f.record_id")) & (F.col("r.url") == F.col("f.url")) & (F.col("r.at") == F.col("f.at")), "left").select("r.*", "f.response_id")
    stored = r.where("full").groupBy(F.col("record_id").alias("response_id")).agg(F.min("header_block").alias("stored"))
    both = both.join(stored, "response_id", "left")
    both = both.withColumn("s", header_fields(F.col("stored"))).withColumn("f", header_fields(F.col("header_block")))
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    tag, date = (_field(F.col("s"), "etag"), _field(F.col("f"), "etag")), (_field(F.col("s"), "last-modified"), _field(F.col("f"), "last-modified"))
    agree = F.coalesce(weak(tag[0]) == weak(tag[1]), date[0] == date[1])
    state = F.when(F.col("response_id").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    out = both.withColumn("state", state)
    return out.select("record_id", "url", "state", "response_id", F.when(F.col("state") == "resolved", merge_headers(F.col("s"), F.col("f"))).alias("headers"))


#: Captures of a page: a response, a revisit some days later under another spelling of the URL, and one shortly before it.
_TAG = "'\"' || md5(coalesce(html, '')) || '\"'"
_CAPTURES = f"""
SELECT page_id * 4 AS record_id, 'response' AS warc_type, url AS target_uri, page_id * 60 AS s,
  'HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: ' || {_TAG} || '\r\nLast-Modified: day ' || CAST(page_id % 7 AS {{text}}) || '\r\nCache-Control: max-age=60\r\nServer: a' AS header_block FROM pages
UNION ALL
SELECT page_id * 4 + 1, 'revisit', CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '#part' WHEN 2 THEN replace(url, 'http://', 'HTTP://WWW.') ELSE replace(url, 'https://', 'http://') END,
  page_id * 60 + 86400 * (1 + page_id % 3),
  'HTTP/1.1 304 Not Modified\r\nDate: d' || CAST(page_id AS {{text}}) || CASE page_id % 6 WHEN 0 THEN '\r\nETag: "other"' WHEN 1 THEN '\r\nLast-Modified: day ' || CAST(page_id % 7 AS {{text}}) WHEN 2 THEN '' WHEN 3 THEN '\r\nETag: W/' || {_TAG} ELSE '\r\netag: ' || {_TAG} END || '\r\ncache-control: max-age=9\r\nConnection: close\r\nContent-Length: 0' FROM pages
UNION ALL
SELECT page_id * 4 + 2, 'revisit', url, page_id * 60 - 30, 'HTTP/1.1 304 Not Modified\r\nETag: ' || {_TAG} FROM pages
"""


def captures(pages: DataFrame) -> DataFrame:
    """Records made from pages (page_id, url, html), as a crawl that comes back would have them."""
    rows = pages.sparkSession.sql(_CAPTURES.replace("\r\n", "\\r\\n").replace("{text}", "STRING").replace("FROM pages", "FROM {p}"), p=pages)
    return rows.withColumn("warc_date", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


_LEAD = "^[A-Za-z][A-Za-z0-9+.-]*://"
_SQL_FIELDS = """list_transform(list_filter(regexp_split_to_array(coalesce({b}, ''), '\\r?\\n'), lambda x: regexp_matches(x, '^[^:\\s]+:')),
  lambda x: {{'key': lower(split_part(x, ':', 1)), 'name': split_part(x, ':', 1), 'value': trim(substr(x, instr(x, ':') + 1))}})"""
OP7_SQL = f"""
WITH c AS ({_CAPTURES.replace(chr(13) + chr(10), "' || chr(13) || chr(10) || '").replace("{text}", "VARCHAR")}),
u AS (SELECT *, regexp_replace(target_uri, '#.*$', '') AS u0 FROM c),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u0, '{_LEAD}([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host, regexp_replace(u0, '{_LEAD}[^/?]*', '') AS rest FROM u),
w AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS params FROM v),
r AS (SELECT record_id, warc_type, s, header_block, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url FROM w),
a AS (SELECT *, last_value(CASE WHEN warc_type = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM r),
b AS (SELECT a.record_id, a.url, a.response_id, {_SQL_FIELDS.format(b="p.header_block")} AS sf, {_SQL_FIELDS.format(b="a.header_block")} AS ff FROM a LEFT JOIN (SELECT record_id, header_block FROM r WHERE warc_type = 'response') p ON p.record_id = a.response_id WHERE a.warc_type = 'revisit'),
g AS (SELECT *, list_filter(sf, lambda x: x.key = 'etag')[1].value AS st, list_filter(ff, lambda x: x.key = 'etag')[1].value AS ft, list_filter(sf, lambda x: x.key = 'last-modified')[1].value AS sd, list_filter(ff, lambda x: x.key = 'last-modified')[1].value AS fd,
  list_filter(ff, lambda x: NOT list_contains([{", ".join(f"'{k}'" for k in KEPT_FIELDS)}], x.key)) AS ok FROM b),
e AS (SELECT *, coalesce(regexp_replace(st, '^W/', '') = regexp_replace(ft, '^W/', ''), sd = fd) AS agree, list_transform(ok, lambda x: x.key) AS ks FROM g),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN agree IS NULL THEN 'no_validator' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS state FROM e)
SELECT record_id, url, state, response_id, CASE WHEN state = 'resolved' THEN array_to_string(list_transform(list_sort(list_concat(
  list_transform(list_filter(sf, lambda x: NOT list_contains(ks, x.key)), lambda x, i: {{'k': x.key, 'i': i, 'l': x.name || ': ' || x.value}}),
  list_transform(ok, lambda x, i: {{'k': x.key, 'i': i, 'l': x.name || ': ' || x.value}}))), lambda x: x.l), chr(10)) END AS headers FROM o
"""
