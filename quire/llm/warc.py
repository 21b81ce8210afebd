"""Operator 3: WARC derivatives.  Each response gives a metadata record and a plain-text conversion record linked to it.

Records are rows: identifiers, named fields, the header block and the content block, so they can be filtered and joined before
``write`` puts them into WARC files.  The conversion refers to its response by identifier, target and date; the metadata record
is concurrent to it and holds the source's header lines, payload digest, title and outgoing links.  Identifiers derive from
what they identify, so a repeated run names the same records.

Defined results: a null or empty payload gives records with an empty text; without an address the target line is left out; repeated
rows give equal records; relative links are resolved against the address, fragments, scripts and mail links are left out;
addresses may stand without quotes and hold character references; a comment or script that never closes reaches to the end of the page.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.llm.common import SPACE_CHARS, col, others

#: Fixed values of the format.
VERSION, ALPHABET = "WARC/1.0", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SEVERAL = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
BREAKS = r"(?i)</?(p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|tfoot|h[1-6]|section|article|header|footer|nav|aside|main|form|blockquote|pre|figure|figcaption|title|head|body|html|address|fieldset|option|select)\b[^>]*>"
TITLE, HREF = r"(?is)<title[^>]*>(.*?)</title", r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references resolved."""
    return texts.map(lambda t: html.unescape(t).replace("\xa0", " ") if t is not None and "&" in t else t)


def base32_sha1(value: Column) -> Column:
    """``sha1:`` and the digest in base 32: forty hexadecimal digits are eight groups of twenty bits, four characters each.

    The digest and each group are bound by a lambda, so each is computed once.
    """
    four = lambda n: F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(n, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (15, 10, 5, 0)])
    groups = lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(d, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    whole = lambda d: F.concat(F.lit("sha1:"), F.array_join(F.transform(groups(d), four), ""))
    return F.get(F.transform(F.array(F.sha1(value)), whole), F.lit(0))


def record_id(*parts: Column) -> Column:
    """Identifier derived from what it identifies."""
    def shape(h: Column) -> Column:
        cut = lambda a, n: F.substring(h, a, n)
        return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))

    return F.get(F.transform(F.array(F.sha1(F.concat_ws("\n", *parts))), shape), F.lit(0))


def plain_text(payload: Column) -> Column:
    """Text of a page: lines at block elements, tags and scripts gone, references resolved, blank lines left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(payload, SEVERAL, ""), BREAKS, "\n"), r"<[^>]*>", "")
    lines = F.transform(F.split(unescaped(bare), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\x0B\f]+", " "), F.lit(SPACE_CHARS)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def links(payload: Column, uri: Column) -> Column:
    """Distinct absolute addresses that a page links to, in order."""
    root, folder = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*/", 0)
    place = lambda x: (F.when(F.rlike(x, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), x).when(F.startswith(x, F.lit("//")), F.concat(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), x))
                       .when(F.startswith(x, F.lit("/")), F.concat(root, x)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), x)))
    bare = F.transform(F.regexp_extract_all(payload, F.lit(HREF), F.lit(1)), lambda x: F.when(F.rlike(x, F.lit("^[\"']")), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    whole = F.split(unescaped(F.array_join(bare, "\x01")), "\x01")  # references are resolved for all addresses of a page at once
    found = F.filter(whole, lambda x: ~F.rlike(x, F.lit(r"(?i)^(#|$|javascript:|mailto:|data:|tel:)")))
    return F.array_distinct(F.transform(found, place))


def _header(fields: list[tuple[str, Column]]) -> Column:
    """Header lines of a record; a null field is left out."""
    return F.concat(F.lit(VERSION + "\r\n"), F.concat_ws("", *[F.concat(F.lit(f"{n}: "), v.cast("string"), F.lit("\r\n")) for n, v in fields]))


def responses(pages: DataFrame, date: str, *, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Response records (as rows) of fetched pages: what ``derive`` takes."""
    body = F.coalesce(col(payload).cast("string"), F.lit(""))
    df = pages.select(*others(pages, ["record_id", "target_uri", "date", "http_header", "payload", "payload_digest"], (uri, payload)), col(uri).cast("string").alias("target_uri"), F.lit(date).alias("date"), body.alias("payload"))
    df = df.withColumns({"payload_digest": base32_sha1(F.col("payload")),
                         "http_header": F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))})
    return df.withColumn("record_id", record_id(F.lit("response"), F.coalesce(col(key).cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest")))


def derive(resp: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Two rows per response: ``record_type`` metadata and conversion, with ``record_id``, ``refers_to``, digests, header and block."""
    df = resp.select(col(key).alias(key), "record_id", "target_uri", "date", "http_header", "payload_digest",
                     plain_text(F.col("payload")).alias("text"), links(F.col("payload"), F.coalesce("target_uri", F.lit(""))).alias("links"),
                     F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " ").alias("raw_title"))
    source = F.array_join(F.transform(F.filter(F.split("http_header", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")
    meta = F.concat(source, F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), F.trim(unescaped("raw_title")), F.lit("\r\n"),
                    F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))
    both = F.explode(F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("meta").alias("block")),
                             F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block"))))
    df = df.withColumn("meta", meta).select(key, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.size("links").cast("long").alias("n_links"), both.alias("r"))
    df = df.select(key, "refers_to", "target_uri", "date", "payload_digest", "n_links", "r.*")
    df = df.withColumns({"record_id": record_id(F.col("record_type"), F.col("refers_to")), "block_digest": base32_sha1(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    conversion = F.col("record_type") == "conversion"
    only = lambda c: F.when(conversion, c)
    header = _header([("WARC-Type", F.col("record_type")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Record-ID", F.col("record_id")),
                      ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", only(F.col("target_uri"))), ("WARC-Refers-To-Date", only(F.col("date"))),
                      ("WARC-Concurrent-To", F.when(~conversion, F.col("refers_to"))), ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Source-Payload-Digest", F.col("payload_digest")),
                      ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length"))])
    return df.withColumn("header", header)


def write(records: DataFrame, path: str) -> None:
    """Records as WARC files: header, empty line, block and two line ends, through Spark's own text writer."""
    records.select(F.concat("header", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read(spark, path: str) -> DataFrame:
    """Records of files written by ``write``: ``record_id``, ``record_type``, ``refers_to``, ``header`` and ``block``.

    Whole files are read (their size is the writer's partition); blocks are cut by their declared length, so a block may hold anything.
    """
    def cut(batches):
        for pdf in batches:
            out = []
            for data in pdf["content"]:
                at = 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    header = data[at:end + 2].decode()
                    size = int(re.search(r"(?im)^Content-Length: (\d+)", header)[1])
                    field = lambda n: (re.search(rf"(?im)^{n}: (.*?)\r$", header) or [None, None])[1]  # noqa: B023, E731
                    out.append((field("WARC-Record-ID"), field("WARC-Type"), field("WARC-Refers-To"), header, data[end + 4:end + 4 + size].decode()))
                    at = end + 8 + size
            yield pd.DataFrame(out, columns=["record_id", "record_type", "refers_to", "header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "record_id string, record_type string, refers_to string, header string, block string")


DATE = "2024-01-01T00:00:00Z"


def derivatives(pages: DataFrame) -> DataFrame:
    """Metadata and conversion record of every page."""
    return derive(responses(pages, DATE)).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_type", "content_length", "n_links", "header", "block")


def derivatives_sql() -> str:
    """The same in DuckDB's SQL (character references: those the tables hold)."""
    b32 = lambda v: f"'sha1:' || list_aggregate(list_transform(range(32), lambda k: substr('{ALPHABET}', 1 + CAST((CAST('0x' || substr(sha1({v}), 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), 'string_agg', '')"
    uid = lambda v: "'<urn:uuid:' || " + " || '-' || ".join(f"{p}substr(sha1({v}), {a}, {n})" for p, a, n in (("", 1, 8), ("", 9, 4), ("'5' || ", 14, 3), ("'a' || ", 18, 3), ("", 21, 12))) + " || '>'"
    ref = lambda v: f"replace(replace(replace(replace({v}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    nl = "chr(13) || chr(10)"
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS root,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*/') AS folder FROM pages),
q AS (SELECT *, {b32("h")} AS pd FROM p),
r AS (SELECT *, {uid("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || u || chr(10) || pd")} AS rid,
  'HTTP/1.1 200 OK|Content-Type: text/html; charset=utf-8|Content-Length: ' || octet_length(encode(h)) AS hh,
  regexp_replace(regexp_replace(regexp_replace(h, {q(SEVERAL)}, '', 'g'), {q(BREAKS)}, chr(10), 'g'), '<[^>]*>', '', 'g') AS bare,
  list_distinct_in_order AS links, trim(regexp_replace(regexp_extract(h, {q(TITLE)}, 1), '\s+', ' ', 'g')) AS title
  FROM (SELECT *, (SELECT coalesce(list(x ORDER BY i), []) FROM (SELECT x, min(i) AS i FROM (SELECT CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l
    WHEN starts_with(l, '//') THEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*:') || l WHEN starts_with(l, '/') THEN root || l
    ELSE CASE WHEN folder = '' THEN root || '/' ELSE folder END || l END AS x, i FROM (SELECT {ref("CASE WHEN l[1] IN (chr(34), chr(39)) THEN l[2:-2] ELSE l END")} AS l, i FROM (SELECT unnest(ls) AS l, unnest(range(len(ls))) AS i)) AS s
    WHERE NOT regexp_matches(l, '(?i)^(#|$|javascript:|mailto:|data:|tel:)')) GROUP BY x)) AS list_distinct_in_order
    FROM (SELECT *, regexp_extract_all(h, {q(HREF)}, 1) AS ls FROM q))),
t AS (SELECT *, array_to_string(list_filter(list_transform(string_split({ref("bare")}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\x0B\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS txt,
  array_to_string(list_transform(string_split(hh, '|'), lambda x: 'source-header: ' || x || {nl}), '') || 'source-payload-digest: ' || pd || {nl} || 'title: ' || {ref("title")} || {nl}
  || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {nl}), '') AS meta FROM r),
b AS (SELECT *, 'metadata' AS ty, 'application/warc-fields' AS ct, meta AS block FROM t UNION ALL SELECT *, 'conversion', 'text/plain', txt FROM t),
c AS (SELECT *, {uid("ty || chr(10) || rid")} AS id, {b32("block")} AS bd, CAST(octet_length(encode(block)) AS BIGINT) AS n FROM b)
SELECT page_id, ty AS record_type, id AS record_id, rid AS refers_to, url AS target_uri, pd AS payload_digest, bd AS block_digest, ct AS content_type, n AS content_length, CAST(len(links) AS BIGINT) AS n_links,
  '{VERSION}' || {nl} || 'WARC-Type: ' || ty || {nl} || coalesce('WARC-Target-URI: ' || url || {nl}, '') || 'WARC-Date: {DATE}' || {nl} || 'WARC-Record-ID: ' || id || {nl} || 'WARC-Refers-To: ' || rid || {nl}
  || CASE WHEN ty = 'conversion' THEN coalesce('WARC-Refers-To-Target-URI: ' || url || {nl}, '') || 'WARC-Refers-To-Date: {DATE}' || {nl} ELSE 'WARC-Concurrent-To: ' || rid || {nl} END
  || 'WARC-Block-Digest: ' || bd || {nl} || 'WARC-Source-Payload-Digest: ' || pd || {nl} || 'Content-Type: ' || ct || {nl} || 'Content-Length: ' || n || {nl} AS header, block FROM c"""
