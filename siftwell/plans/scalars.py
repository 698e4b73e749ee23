"""Queries of scalar functions that the other modules do not show, over the driver's tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from siftwell.functions import decoding, headers, policy, robots, urls
from siftwell.functions import html as page
from siftwell.functions import text as tx
from siftwell.functions.types import of
from siftwell.plans.registry import query
from siftwell.session import table

_HIDDEN_SQL = r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x{9F}\x{AD}\x{200B}\x{2060}\x{FEFF}]"
_LINE_SQL = rf"trim(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(t, '{_HIDDEN_SQL}', '', 'g'), '[ \t\n\f\r\x{{A0}}\x{{2007}}\x{{202F}}]', ' ', 'g'), '  +', ' ', 'g')))"


@query(rf"SELECT doc_id, {_LINE_SQL} AS clean FROM (SELECT doc_id, chr(8203) || ' ' || replace(text, ' ', chr(160) || chr(9)) || chr(7) AS t FROM documents)")
def text_inline(spark, sf_dir):
    """Texts on one line, with odd spaces and invisible characters put in."""
    t = F.concat(F.lit("​ "), F.replace("text", F.lit(" "), F.lit(" \t")), F.lit("\x07"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.INLINE.column(t).alias("clean"))


@query(rf"SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace(replace(text, ' ', chr(13) || chr(10)), '\r\n?', chr(10), 'g'), '[\f]|{_HIDDEN_SQL}', '', 'g')) AS clean FROM documents")
def text_verbatim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.VERBATIM.column(F.replace("text", F.lit(" "), F.lit("\r\n"))).alias("clean"))


@query(rf"SELECT doc_id, nullif(rtrim(substr(line, 1, 40)), '') AS value, length(line) > 40 AS cut FROM (SELECT doc_id, {_LINE_SQL} AS line FROM (SELECT doc_id, text AS t FROM documents))")
def text_limited(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.limited_column(F.col("text"), 40).alias("v")).select("doc_id", "v.*")


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM conversations)
           SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '|') AS queries FROM w WHERE len(l) > 0""")
def query_lists(spark, sf_dir):
    """Sentences of a turn as a list of queries: clean, first of equal ones."""
    found = tx.clean_queries(F.split("text", "\\."))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("q"))
    return rows.where("q is not null").select("conv_id", "turn", F.array_join("q", "|").alias("queries"))


@query(r"""SELECT event_id, 'cookie=[REDACTED],note=user ' || user_id || ' Bearer [REDACTED],url=https://e.com/?token=[REDACTED]&x=' || event_id AS fields FROM events""")
def redact_fields(spark, sf_dir):
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    fields = F.create_map(F.lit("url"), F.concat(F.lit("https://e.com/?token=t"), e, F.lit("&x="), e), F.lit("cookie"), F.concat(F.lit("c"), e), F.lit("note"), F.concat(F.lit("user "), u, F.lit(" Bearer b"), e))
    shown = F.array_sort(F.map_entries(tx.redact_map(fields)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(shown, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"))


_HREFS = ("", "#top", "javascript:go(", "mailto:a@b.c", "news:x", "http://u@h/", "/a b", "?q=1", "//other.example/x#f")


@query(f"""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([a-z]+://[^?#]*)', 1) AS bare, page_id % {len(_HREFS)} AS k FROM pages)
           SELECT page_id, CASE k WHEN 6 THEN origin || '/a b' WHEN 7 THEN bare || '?q=1' WHEN 8 THEN scheme || '//other.example/x' END AS url,
                  CASE k WHEN 6 THEN origin || '/a%20b' WHEN 7 THEN bare || '?q=1' WHEN 8 THEN scheme || '//other.example/x' END AS normalized_url,
                  ['empty', 'fragment', 'javascript', 'mailto', 'other_scheme', 'credentials', NULL, NULL, NULL][k + 1] AS reason FROM h""")
def link_reasons(spark, sf_dir):
    """What becomes of hrefs of every kind on a page."""
    href = F.element_at(F.array(*(F.lit(h) for h in _HREFS)), (F.col("page_id") % len(_HREFS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve_link_udf(href, "url").alias("l")).select("page_id", "l.*")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00') END AS naive FROM events""")
def iso_dates(spark, sf_dir):
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.date_format("ts", " yyyy-MM-dd'T'HH:mm:ss ")).when(n == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("next week")
    return table(spark, sf_dir, "events").select("event_id", headers.iso_datetime_udf(text).alias("naive"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8-sig' WHEN 3 THEN 'iso8859-1' ELSE 'utf-8' END AS charset, CASE doc_id % 4 WHEN 3 THEN strlen(text) ELSE length(text) END AS chars,
                 sha256(CASE doc_id % 4 WHEN 0 THEN chr(65279) ELSE '' END || text) AS content_sha256, CAST(strlen(text) + CASE doc_id % 4 WHEN 0 THEN 3 ELSE 0 END AS INT) AS content_length FROM documents WHERE text IS NOT NULL""")
def body_charsets(spark, sf_dir):
    """Bodies with a mark, without any, with an unknown and with a wrong charset."""
    n = F.col("doc_id") % 4
    declared = F.when(n == 1, "no-such").when(n == 3, "latin-1")
    body = F.encode(F.concat(F.when(n == 0, "﻿").otherwise(""), "text"), "UTF-8")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", headers.decode_body_udf(body, declared).alias("d"))
    return rows.select("doc_id", "d.charset", F.char_length("d.content").cast("long").alias("chars"), "d.content_sha256", "d.content_length")


@F.pandas_udf(of("binary"))
def _gzip(values: pd.Series) -> pd.Series:
    return values.map(lambda v: gzip.compress(v.encode(), 1, mtime=0))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 OR doc_id % 5 = 2 THEN 'INVALID_RESPONSE' WHEN strlen(text) > 4000 THEN 'RESPONSE_TOO_LARGE' ELSE 'OK' END AS status,
                 CASE WHEN doc_id % 5 NOT IN (1, 2) AND strlen(text) <= 4000 THEN sha256(text) END AS body_sha256 FROM documents WHERE text IS NOT NULL""")
def bounded_bodies(spark, sf_dir):
    """Compressed bodies: whole, cut short, in an unknown encoding, and plain ones; 4,000 bytes at most."""
    n = F.col("doc_id") % 5
    packed = _gzip("text")
    raw = F.when(n == 1, F.substring(packed, 1, 12)).when(n == 3, F.encode("text", "UTF-8")).otherwise(packed)
    encoding = F.when(n == 2, "br").when(n == 3, "identity").otherwise("GZIP")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", decoding.decode_udf(4000)(raw, encoding).alias("d"))
    return rows.select("doc_id", "d.status", F.sha2("d.body", 256).alias("body_sha256"))


@query("""WITH a AS (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b FROM events),
               p AS (SELECT event_id, a || '.' || b || '.3.7' AS address, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
                            OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19) AS blocked FROM a)
          SELECT event_id, address, blocked, blocked OR event_id % 7 = 0 AS host_blocked FROM p""")
def blocked_addresses(spark, sf_dir):
    """Addresses of all networks; one blocked address blocks its host."""
    address = F.concat((F.col("event_id") % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(".3.7"))
    every = F.array_compact(F.array(address, F.when(F.col("event_id") % 7 == 0, "::ffff:127.0.0.1")))
    return table(spark, sf_dir, "events").select("event_id", address.alias("address"), policy.is_blocked_udf(address).alias("blocked"), policy.any_blocked_udf(every).alias("host_blocked"))


@F.pandas_udf(of("string"))
def _title(values: pd.Series) -> pd.Series:
    return values.map(page.first_title, na_action="ignore")


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages)
           SELECT page_id, nullif(substr(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), 1, 500), '') AS title FROM t""")
def fetch_titles(spark, sf_dir):
    """The title that a fetch records, found without parsing the page."""
    return table(spark, sf_dir, "pages").select("page_id", _title("html").alias("title"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'nonsense ' || page_id ELSE regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), 'utm_[a-z]+=[^&]*&?', '', 'g'), '[?&]$', '') END AS loop_key,
                  regexp_extract(CASE WHEN url LIKE '%?%' THEN url ELSE url || '?' END, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages""")
def redirect_keys(spark, sf_dir):
    """What tells redirect loops: the canonical URL, or what is no URL as it is."""
    u = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("nonsense "), "page_id")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.loop_key(u).alias("loop_key"), F.substring_index(robots.path_udf("url"), "?", 1).alias("path"))
