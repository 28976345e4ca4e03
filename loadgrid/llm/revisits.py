"""WARC not-modified revisits: each revisit record is resolved to the latest earlier full response
of its canonical URL, if the validators agree, and the permitted headers are merged.

Input: one row per record: record_id, record_type ('response' or 'revisit'), url, ts (timestamp),
etag, last_modified, headers (map of names, in any case, to values).

Defined results: record types count without regard to case and blanks around them; a response has status 'full' and keeps its
headers as they are; a revisit has status
'resolved', 'validator_mismatch' (the latest earlier response has other validators),
'no_validator' (the revisit carries none) or 'no_response' (none is earlier; also a null url or
time); a record of any other or of no type has status 'other' and answers nothing. Only 'resolved' rows carry merged headers, their
names in lower case; of names that differ in case only the greatest (by code point) counts. Equal times: a response at the
revisit's own instant is not earlier; among responses of one instant the greatest record_id counts.
Null headers count as empty. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import written

#: Headers that a not-modified answer may not replace in the stored response: those of the body and of the connection.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")
#: Query parameters that do not change a resource.
TRACKING = "utm_[a-z]+|fbclid|gclid"
#: Length in seconds of the stretches that a URL's captures are dealt out by.
STRETCH_S = 6 * 3600


def _decoded(s: Column) -> Column:
    """Percent codes of unreserved characters as those characters, the others in capital letters."""
    def one(p: Column, i: Column) -> Column:
        code = F.upper(F.substring(p, 1, 2))
        char = F.char(F.conv(code, 16, 10).cast("int"))
        rest = F.substr(p, F.lit(3))
        good = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), good).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(F.split(s, "%"), one), "")


def canonical_url(url: Column) -> Column:
    """No scheme, fragment, user info, leading ``www.``, tracking parameters, closing slash or default port; host in lower case, percent codes only
    where they are needed, query parameters in the order of their names (those of one name in their own)."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^[^/?@]*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = _decoded(F.regexp_replace(rest, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1"))
    query = F.filter(F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), "&"), lambda x: x != "")
    named = F.array_sort(F.transform(query, lambda x, i: F.struct(F.regexp_replace(x, "=.*", "").alias("name"), i.alias("i"), x.alias("x"))))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.transform(named, lambda x: x["x"]), "&"))).otherwise(F.lit(""))
    return F.concat(host, F.regexp_replace(F.concat(F.regexp_extract(rest, r"^[^?]*", 0), tail), r"[?&/]+$", ""))


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _lowered(headers: Column) -> Column:
    """Headers by lower-case names; of names that differ in case only the greatest counts."""
    entries = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.array_sort(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n)), -1)["value"]))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with those of the update that a not-modified answer may replace or add; names in lower case."""
    permitted = F.map_filter(_lowered(update), lambda k, v: ~k.isin(*BODY_HEADERS, *HOP_HEADERS))
    kept = F.map_filter(_lowered(stored), lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def resolve(records: DataFrame, stretch_s: int = STRETCH_S) -> DataFrame:
    """(record_id, url, ts, status, response_id, headers): every record, revisits resolved.

    As-of join without one task per URL: captures are dealt out by (URL, stretch of time); inside a
    stretch a running last value finds the response, and for the revisits before the first response
    of their stretch a second, small table of one row per (URL, stretch) carries the last response
    of the stretches before. Payloads never move: the join carries ids, validators and headers.
    """
    r = records.select("record_id", "record_type", "url", "ts", "etag", "last_modified", "headers")
    r = r.withColumn("_key", canonical_url(F.col("url"))).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    r = r.withColumn("_type", F.lower(F.trim("record_type")))
    # Records that no response can match or be, for want of a URL or time, are dealt out by their id.
    r = r.withColumn("_stretch", F.coalesce(F.floor(F.col("_at") / F.lit(stretch_s * 1_000_000)), F.xxhash64("record_id", "ts")))
    r = r.withColumn("_stretch", F.when(F.col("_key").isNull(), F.xxhash64("record_id", "ts")).otherwise(F.col("_stretch")))
    full = (F.col("_type") == "response") & F.col("_key").isNotNull() & F.col("_at").isNotNull()
    answer = F.when(full, F.struct("_at", "record_id", "etag", "last_modified", "headers"))
    r = r.withColumn("_answer", answer).repartition("_key", "_stretch")
    # Order of an instant: revisits first, so that a response at the same instant is not earlier.
    order = [F.col("_at"), F.col("_answer").isNotNull(), F.col("record_id")]
    inside = Window.partitionBy("_key", "_stretch").orderBy(*order)
    r = r.withColumn("_near", F.last("_answer", ignorenulls=True).over(inside))
    top = F.max_by("_answer", F.struct(F.col("_answer._at"), F.col("_answer.record_id")))
    last = (r.filter("_answer IS NOT NULL").select("_key", "_stretch", "_answer").groupBy("_key", "_stretch").agg(top.alias("_far")))
    # A stretch without revisits asks nothing; one with revisits asks for the last response of the stretches before it.
    asks = r.filter((F.col("_type") == "revisit") & F.col("_near").isNull() & F.col("_at").isNotNull() & F.col("_key").isNotNull()).select("_key", "_stretch").distinct()
    both = (last.select("_key", "_stretch", "_far", F.lit(False).alias("_asks"))
            .unionByName(asks.select("_key", "_stretch", F.lit(None).cast(last.schema["_far"].dataType).alias("_far"), F.lit(True).alias("_asks"))))
    before = Window.partitionBy("_key").orderBy("_stretch", F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = both.withColumn("_far", F.last("_far", ignorenulls=True).over(before)).filter("_asks").select("_key", "_stretch", "_far")
    r = r.join(far, ["_key", "_stretch"], "left").withColumn("_hit", F.coalesce("_near", "_far"))
    tag = F.col("etag").isNotNull()
    agree = F.when(tag, F.coalesce(weak(F.col("etag")) == weak(F.col("_hit.etag")), F.lit(False))).otherwise(
        F.coalesce(F.col("last_modified") == F.col("_hit.last_modified"), F.lit(False)))
    status = (F.when(F.col("_type") == "response", "full").when(~F.coalesce(F.col("_type") == "revisit", F.lit(False)), "other").when(F.col("_hit").isNull() | F.col("_at").isNull(), "no_response")
              .when(~tag & F.col("last_modified").isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch"))
    r = r.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return r.select("record_id", F.col("_key").alias("url"), "ts", "status", F.when(ok, F.col("_hit.record_id")).alias("response_id"),
                    F.when(F.col("status") == "full", F.col("headers")).when(ok, merged_headers(F.col("_hit.headers"), F.col("headers"))).alias("headers"))


#: Captures of a page in the derived log, and the seconds between them.
CAPTURES, APART_S = 3, 11 * 86400


def captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: each page is captured three times, 11 days apart, the pages 97 s apart.

    The first capture and one in four of the later ones are full responses, the others revisits. A
    resource's validators change every 30 days; some records carry weak tags, some only a
    date, some no validator.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.length("html"), F.lit(0)).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))).alias("k"))
    rows = rows.withColumn("record_id", F.col("page_id") * CAPTURES + F.col("k"))
    h = F.pmod(F.col("record_id"), F.lit(1_000_003)) * 7919 % 10_007
    at = F.lit(1_700_000_000) + F.col("page_id") * 97 + F.col("k") * APART_S
    version = F.floor((at + F.length(F.regexp_extract("url", r"//([^/]+)", 1)) * 86400) / F.lit(30 * 86400))
    tag = F.concat(F.lit('"v'), version.cast("string"), F.lit('"'))
    etag = F.when(h % 11 == 0, F.lit(None)).when(h % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when(h % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("day "), (version * 30).cast("string")))
    revisit = (F.col("k") > 0) & (h % 4 > 0)
    date = at.cast("string")
    headers = F.when(revisit, F.create_map(F.lit("date"), date, F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close"),
                                          F.lit("cache-control"), F.concat(F.lit("max-age="), (h % 900).cast("string")))).otherwise(
        F.create_map(F.lit("date"), date, F.lit("content-length"), F.col("n").cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("a")))
    return rows.select("record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url", F.timestamp_seconds(at).alias("ts"),
                       etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))


def report(pages: DataFrame) -> DataFrame:
    """resolve() over the captures of ``pages`` (written first, as a capture log is), headers as one
    text in the order of their names."""
    r = resolve(written(captures(pages), "captures"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return r.select("record_id", "url", F.unix_seconds("ts").alias("captured_s"), "status", "response_id",
                    F.when(F.col("headers").isNotNull(), F.concat_ws("\n", lines)).alias("headers"))


#: DuckDB SQL of report() over ``pages``.
ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id * 3 + k AS record_id, k, url, coalesce(length(html), 0) AS n, 1700000000 + page_id * 97 + k * 11 * 86400 AS secs FROM pages, range(3) r(k)
), v AS (
  SELECT *, ((record_id % 1000003) * 7919) % 10007 AS h, floor((secs + length(regexp_extract(url, '//([^/]+)', 1)) * 86400) / (30 * 86400))::BIGINT AS version FROM c
), w AS (
  SELECT *, k > 0 AND h % 4 > 0 AS revisit,
         CASE WHEN h % 11 = 0 THEN NULL ELSE '"v' || version || '"' END AS tag,
         CASE WHEN h % 13 = 0 THEN NULL ELSE 'day ' || version * 30 END AS modified,
         regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?@]*@', '') AS u
  FROM v
), w1 AS (
  SELECT *, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(?:(?:utm_[a-z]+|fbclid|gclid)=[^&]*(?:&|$))+', '\1', 'g'), '%'), lambda p, i:
           CASE WHEN i = 1 THEN p WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN '%' || p
                WHEN regexp_matches(chr(('0x' || substr(p, 1, 2))::INTEGER), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || substr(p, 1, 2))::INTEGER) || substr(p, 3)
                ELSE '%' || upper(substr(p, 1, 2)) || substr(p, 3) END), '') AS rest
  FROM w
), w2 AS (
  SELECT *, list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'), lambda x: x <> '') AS query FROM w1
), x AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_extract(rest, '^[^?]*') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform(query, lambda q, i:
              {'name': regexp_replace(q, '=.*', ''), 'i': i, 'x': q})), lambda e: e.x), '&') ELSE '' END, '[?&/]+$', '') AS key
  FROM w2
), y AS (
  SELECT *, last_value(CASE WHEN NOT revisit THEN {'id': record_id, 'tag': tag, 'modified': modified, 'n': n} END IGNORE NULLS)
            OVER (PARTITION BY key ORDER BY secs, NOT revisit, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM x
), z AS (
  SELECT *, CASE WHEN NOT revisit THEN 'full' WHEN r IS NULL THEN 'no_response' WHEN tag IS NULL AND modified IS NULL THEN 'no_validator'
                 WHEN CASE WHEN tag IS NOT NULL THEN coalesce(tag = r.tag, false) ELSE coalesce(modified = r.modified, false) END THEN 'resolved'
                 ELSE 'validator_mismatch' END AS status
  FROM y
)
SELECT record_id, key AS url, secs AS captured_s, status, CASE WHEN status = 'resolved' THEN r.id END AS response_id,
       CASE status WHEN 'full' THEN 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || secs || chr(10) || 'server: a'
                   WHEN 'resolved' THEN 'cache-control: max-age=' || h % 900 || chr(10) || 'content-length: ' || r.n || chr(10) || 'content-type: text/html'
                                        || chr(10) || 'date: ' || secs || chr(10) || 'server: a' END AS headers
FROM z
"""
