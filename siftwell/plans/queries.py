"""Queries over the driver's tables and their DuckDB counterparts.

Tables stand in for the pipeline's own: ``pages`` are fetched bodies, ``documents`` extracted
texts, ``events`` search attempts, hits and job events, ``conversations`` query strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import headers, policy, robots, urls
from siftwell.functions import text as tx
from siftwell.operators import crawl, dedup, extract, jobs, search, sources
from siftwell.plans.registry import ORACLES, QUERIES, query
from siftwell.schemas import PIPELINE_STAGES
from siftwell.session import table

# -- shared inputs ------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits derived from events: request by user, query by user, provider by type."""
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("request_id", "query", "source").orderBy("idx"))
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("request_id"),
        F.col("event_id").cast("int").alias("idx"),
        F.concat(F.lit("title "), "event_id").alias("title"),
        F.concat(F.lit("https://s"), (F.col("event_id") % 97).cast("string"), F.lit(".example.com/p")).alias("url"),
        F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("query"),
        F.col("event_type").alias("source"),
    ).withColumn("rank", rank)


_HITS_SQL = """
    hits AS (
        SELECT 'r' || (user_id % 50) AS request_id, event_id AS idx, 'title ' || event_id AS title,
               'https://s' || (event_id % 97) || '.example.com/p' AS url, 'q' || (user_id % 7) AS query, event_type AS source,
               row_number() OVER (PARTITION BY user_id % 50, user_id % 7, event_type ORDER BY event_id) AS rank
        FROM events
    ),
    prov AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('error', 3)) t(source, p)),
    ordered AS (
        SELECT hits.*, CAST(substr(query, 2) AS INT) AS q, coalesce(p, 2147483647) AS p FROM hits LEFT JOIN prov USING (source)
    )"""


def _dims(spark: SparkSession, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query and provider order for every request; one provider is left out on purpose."""
    requests = hits.select("request_id").distinct()
    q = spark.createDataFrame([(f"q{i}", i) for i in range(7)], "name string, ord int")
    p = spark.createDataFrame([(n, i) for i, n in enumerate(("view", "click", "purchase", "error"))], "name string, ord int")
    return requests.join(F.broadcast(q)), requests.join(F.broadcast(p))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 11
    status = F.when(n < 4, "OK").when(n < 6, "EMPTY").when(n < 10, "FAILED").otherwise("SKIPPED_CIRCUIT_OPEN")
    category = F.when(F.col("event_id") % 2 == 0, "TIMEOUT").otherwise("NETWORK_ERROR")
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("request_id"),
        F.col("event_id").cast("int").alias("idx"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("query"),
        status.alias("status"),
        F.when(status == "OK", F.col("event_id") % 10 + 1).otherwise(0).alias("result_count"),
        (F.col("event_id") % 1000).alias("duration_ms"),
        F.when(status == "FAILED", F.struct(F.lit("PROVIDER_ERROR").alias("code"), category.alias("category"), F.lit(True).alias("retryable"))).alias("error"),
    )


_ATTEMPTS_SQL = """
    attempts AS (
        SELECT 'r' || (user_id % 50) AS request_id, event_id AS idx, event_type AS provider, 'q' || (user_id % 7) AS query,
               CASE WHEN event_id % 11 < 4 THEN 'OK' WHEN event_id % 11 < 6 THEN 'EMPTY' WHEN event_id % 11 < 10 THEN 'FAILED' ELSE 'SKIPPED_CIRCUIT_OPEN' END AS status,
               CASE WHEN event_id % 11 < 4 THEN event_id % 10 + 1 ELSE 0 END AS result_count, event_id % 1000 AS duration_ms,
               CASE WHEN event_id % 11 BETWEEN 6 AND 9 THEN CASE WHEN event_id % 2 = 0 THEN 'TIMEOUT' ELSE 'NETWORK_ERROR' END END AS category
        FROM events
    ),
    prov AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('error', 3)) t(provider, p))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the grouping's input, with every kind of flaw in some rows."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 13
    sha = F.sha2("text", 256)
    return d.select(
        F.col("doc_id").cast("int").alias("position"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), (F.col("doc_id") % 400).cast("string"), F.when(n == 1, "?utm_source=x").otherwise("")).alias("requested_url"),
        F.when(n == 2, "").when(n == 3, "ftp://nowhere").alias("final_url"),
        F.when(n == 4, "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.when(n == 5, "HTTP_ERROR").otherwise("OK").alias("fetch_status"),
        F.when(n == 6, F.lit(None)).when(n == 7, F.upper(sha)).otherwise(sha).alias("content_sha256"),
        F.when(n == 8, "").otherwise(F.col("text")).alias("text"),
        F.when(n == 9, F.lit(None)).when(n == 10, F.sha2(F.lit("x"), 256)).when(n == 8, F.lit(None)).otherwise(sha).alias("text_sha256"),
    )


_DOCUMENTS_SQL = """
    docs AS (
        SELECT doc_id AS position,
               CASE doc_id % 13 WHEN 3 THEN NULL ELSE 'https://' || source || '.example.com/' || (doc_id % 400) END AS source_identity,
               CASE doc_id % 13 WHEN 3 THEN NULL ELSE source || '.example.com' END AS host,
               CASE doc_id % 13 WHEN 4 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
               CASE doc_id % 13 WHEN 5 THEN 'HTTP_ERROR' ELSE 'OK' END AS fetch_status,
               CASE doc_id % 13 WHEN 6 THEN NULL WHEN 7 THEN upper(sha256(text)) ELSE sha256(text) END AS content_sha256,
               CASE doc_id % 13 WHEN 8 THEN '' ELSE text END AS text,
               CASE doc_id % 13 WHEN 9 THEN NULL WHEN 8 THEN NULL WHEN 10 THEN sha256('x') ELSE sha256(text) END AS text_sha256
        FROM documents
    ),
    levels AS (
        SELECT position, 'L1' AS level, 'L1:url:' || source_identity AS key, CASE WHEN source_identity IS NULL THEN 'INVALID_SOURCE_URL' END AS reason FROM docs
        UNION ALL
        SELECT position, 'L2', CASE WHEN regexp_full_match(content_sha256, '[0-9a-f]{64}') THEN 'L2:sha256:' || content_sha256 END,
               CASE WHEN content_sha256 IS NULL THEN 'NO_CONTENT_HASH' WHEN NOT regexp_full_match(content_sha256, '[0-9a-f]{64}') THEN 'INVALID_CONTENT_HASH' END FROM docs
        UNION ALL
        SELECT position, 'L3', CASE WHEN why IS NULL THEN 'L3:sha256:' || text_sha256 END, why FROM (
            SELECT *, CASE WHEN status <> 'SUCCESS' THEN 'NOT_SUCCESS'
                           WHEN text = '' THEN CASE WHEN text_sha256 IS NULL THEN 'EMPTY_TEXT' ELSE 'TEXT_HASH_MISMATCH' END
                           WHEN text_sha256 IS NULL THEN 'MISSING_TEXT_HASH' WHEN sha256(text) <> text_sha256 THEN 'TEXT_HASH_MISMATCH' END AS why FROM docs)
    ),
    members AS (
        SELECT l.level, l.key, d.* FROM levels l JOIN docs d USING (position) WHERE l.key IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY l.level, l.key) >= 2
    )"""

_URL_SQL = r"""
    bare AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages),
    parts AS (
        SELECT page_id, url, regexp_replace(b, '\?.*$', '') AS base,
               list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
                       AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'dclid', 'gbraid', 'wbraid', 'msclkid', 'yclid', 'igshid', 'mc_cid', 'mc_eid', '_ga', '_gl', 'srsltid'))) AS pairs
        FROM bare
    ),
    urls AS (SELECT page_id, url, base || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS normalized_url FROM parts)"""


# -- URL and text functions ------------------------------------------------------------------


@query(f"WITH {_URL_SQL} SELECT page_id, normalized_url FROM urls")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized_url"))


@query(f"WITH {_URL_SQL} SELECT page_id, normalized_url FROM urls")
def url_normalize_exact(spark, sf_dir):
    """The Python form of the same function, for every URL."""
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url_udf("url").alias("normalized_url"))


@query(rf"""WITH {_URL_SQL} SELECT page_id, regexp_extract(normalized_url, '://([^/?]*)', 1) AS host,
            regexp_replace(regexp_extract(normalized_url, '://([^/?]*)', 1), '^www\.', '') AS domain,
            regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM urls""")
def url_domain(spark, sf_dir):
    u = urls.normalized(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.domain(u).alias("domain"), urls.origin(F.col("url")).alias("origin"))


@query(f"WITH {_URL_SQL} SELECT normalized_url, count(*) AS n, min(page_id) AS first_page FROM urls GROUP BY normalized_url")
def url_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized_url"))
    return rows.groupBy("normalized_url").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(r"""SELECT doc_id, length(text) AS char_count, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word_count,
           CASE WHEN text <> '' THEN sha256(text) END AS text_sha256 FROM documents""")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.char_count(t).alias("char_count"), tx.word_count(t).alias("word_count"), tx.text_hash(t).alias("text_sha256")
    )


_PLAIN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(nfc_normalize(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160) || chr(8199) || chr(8239), '   ')),
    '[ \t]+\n', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), '^\n+|\n+$', '', 'g')"""


@query(f"SELECT doc_id, {_PLAIN_SQL} AS clean FROM documents")
def clean_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.PLAIN.column(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS clean FROM documents""")
def clean_block(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.BLOCK.column(F.col("text")).alias("clean"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS clean FROM conversations
           WHERE length(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) BETWEEN 3 AND 500""")
def clean_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.query_column(F.col("text")).alias("clean"))
    return rows.where("clean is not null")


@query("SELECT conv_id, turn, substr(sha256(text), 1, 16) AS query_hash, substr(sha256(text), 1, 12) AS key_hash FROM conversations")
def query_hash(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.query_hash(t).alias("query_hash"), tx.key_hash(t).alias("key_hash"))


@query(r"""WITH t AS (SELECT page_id, url || '?x=1&api_key=' || page_id || '&b=2 Bearer abc' || page_id || ' end' AS line FROM pages)
           SELECT page_id, regexp_replace(regexp_replace(line, '(?i)([?&](?:key|api_key|apikey|access_token|token)=)[^&#\s''"]+', '\1[REDACTED]', 'g'),
                  '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g') AS line FROM t""")
def redact(spark, sf_dir):
    line = F.concat("url", F.lit("?x=1&api_key="), "page_id", F.lit("&b=2 Bearer abc"), "page_id", F.lit(" end"))
    return table(spark, sf_dir, "pages").select("page_id", tx.redact_text(line).alias("line"))


@query(r"""WITH h AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Text/HTML; charset="UTF-8"' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'bad type' ELSE 'application/xhtml+xml;charset=latin1;charset=l1' END AS v,
                          CASE event_id % 3 WHEN 0 THEN '7.5' WHEN 1 THEN '-2' ELSE 'soon' END AS r FROM events)
           SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 3 THEN 'application/xhtml+xml' END AS media,
                  CASE event_id % 4 WHEN 0 THEN 'utf-8' WHEN 3 THEN 'l1' END AS charset, CASE WHEN try_cast(r AS DOUBLE) IS NOT NULL THEN greatest(try_cast(r AS DOUBLE), 0.0) END AS retry_after,
                  CASE WHEN try_cast(r AS DOUBLE) IS NULL THEN least(2.0 * pow(2, event_id % 9), 30.0) ELSE least(greatest(try_cast(r AS DOUBLE), 0.0), 30.0) END AS backoff FROM h""")
def header_parse(spark, sf_dir):
    n = F.col("event_id")
    v = F.when(n % 4 == 0, 'Text/HTML; charset="UTF-8"').when(n % 4 == 1, "text/plain").when(n % 4 == 2, "bad type").otherwise("application/xhtml+xml;charset=latin1;charset=l1")
    r = headers.retry_after(F.when(n % 3 == 0, "7.5").when(n % 3 == 1, "-2").otherwise("soon"))
    return table(spark, sf_dir, "events").select(
        "event_id", headers.media_type(v).alias("media"), headers.declared_charset(v).alias("charset"), r.alias("retry_after"), headers.backoff(r, 2.0, n % 9 + 1).alias("backoff")
    )


@query("""SELECT doc_id, length(text) - length(replace(text, 'e', '')) > 0.005 * length(text) OR length(text) - length(replace(text, 'e', '')) > 100 AS lost FROM documents""")
def charset_warnings(spark, sf_dir):
    """Replacement characters put in for one letter, so that the share varies."""
    seen = headers.charset_warnings(F.replace("text", F.lit("e"), F.lit("�")), F.lit("utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(seen, "DECODING_ERRORS").alias("lost"))


@query("""SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS parsed FROM events""")
def parse_dates(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", headers.native_date(text).alias("parsed"))


# -- policy and robots -----------------------------------------------------------------------

_CASES = (
    ("http://127.0.0.1/", None, "address not allowed", True), ("http://10.1.2.3/x", None, "address not allowed", True), ("http://8.8.8.8/", "8.8.8.8", None, False),
    ("http://2130706433/", None, "non-canonical numeric host", True), ("http://0x7f.1/", None, "non-canonical numeric host", True), ("http://localhost/", None, "local hostname", True),
    ("http://a.localhost/", None, "local hostname", True), ("http://u:p@e.com/", None, "credentials in url", False), ("ftp://e.com/", None, "scheme not allowed", False),
    ("http://e.com:8080/", None, "port not allowed", False), ("https://E.com:443/", "e.com", None, False), ("http://169.254.169.254/", None, "address not allowed", True),
)
_CASE_SQL = ", ".join(
    f"('{u}', {'NULL' if h is None else repr(h)}, {'NULL' if r is None else repr(r)}, {str(s).upper()})" for u, h, r, s in _CASES
)


@query(rf"""SELECT page_id AS id, regexp_extract(url, '://([^/?#:]*)', 1) AS host, CAST(NULL AS VARCHAR) AS reason, FALSE AS ssrf FROM pages
            UNION ALL SELECT -1 - row_number() OVER (ORDER BY u), h, r, s FROM (VALUES {_CASE_SQL}) t(u, h, r, s)""")
def policy_check(spark, sf_dir):
    cases = spark.createDataFrame([(-2 - i, u) for i, u in enumerate(sorted(c[0] for c in _CASES))], "id long, url string")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(cases)
    return rows.select("id", policy.lexical_check(F.col("url")).alias("c")).select("id", "c.*")


@query(rf"""SELECT page_id AS id, regexp_extract(url, '://([^/?#:]*)', 1) AS host, CAST(NULL AS VARCHAR) AS reason, FALSE AS ssrf FROM pages
            UNION ALL SELECT -1 - row_number() OVER (ORDER BY u), h, r, s FROM (VALUES {_CASE_SQL}) t(u, h, r, s)""")
def policy_check_exact(spark, sf_dir):
    cases = spark.createDataFrame([(-2 - i, u) for i, u in enumerate(sorted(c[0] for c in _CASES))], "id long, url string")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(cases)
    return rows.select("id", policy.check_url_udf("url").alias("c")).select("id", "c.*")


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nAllow: /fr/\n\nUser-agent: other\nDisallow: /\n"


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) || CASE WHEN url LIKE '%?%' THEN regexp_replace(regexp_extract(url, '(\?.*)$', 1), '#.*$', '') ELSE '' END AS path FROM pages),
            r AS (SELECT * FROM (VALUES ('^/en/.*', '/en/', FALSE), ('^/en/1.*', '/en/1', TRUE), ('^/.*\.html$', '/*.html$', FALSE), ('^/fr/.*', '/fr/', TRUE)) t(rx, pattern, allow)),
            m AS (SELECT page_id, arg_max(allow, length(pattern) * 2 + allow::INT) AS allowed FROM p JOIN r ON regexp_full_match(path, substr(rx, 2)) GROUP BY page_id)
       SELECT page_id, coalesce(allowed, TRUE) AS allowed FROM p LEFT JOIN m USING (page_id)""")
def robots_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), robots.path_udf("url").alias("path"))
    files = pages.select("origin").distinct().withColumn("text", F.lit(_ROBOTS))
    return robots.decide(pages, robots.rules_table(files), "siftwell").select("page_id", "allowed")


# -- search merge and status ---------------------------------------------------------------


@query(f"""WITH {_HITS_SQL},
    g AS (
        SELECT request_id, url, min((q, p, rank, idx)) AS first, arg_min(title, (q, p, rank, idx)) AS title, count(*) AS occurrences,
               list(source ORDER BY q, p, rank, idx) AS ss, list(query ORDER BY q, p, rank, idx) AS qs FROM ordered GROUP BY request_id, url
    )
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY first) - 1 AS position, url, title, occurrences,
           array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: list_position(ss, ss[i]) = i), lambda i: ss[i]), ',') AS providers,
           array_to_string(list_transform(list_filter(range(1, len(qs) + 1), lambda i: list_position(qs, qs[i]) = i), lambda i: qs[i]), ',') AS queries
    FROM g""")
def search_merge(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    q, p = _dims(spark, hits)
    merged = search.merge(hits, q, p)
    return merged.select(
        "request_id", "position", "result.url", "result.title", "occurrences", F.array_join("providers", ",").alias("providers"), F.array_join("queries", ",").alias("queries")
    )


@query(f"""WITH {_HITS_SQL} SELECT request_id, position, url FROM (
        SELECT request_id, url, row_number() OVER (PARTITION BY request_id ORDER BY min((q, p, rank, idx))) - 1 AS position FROM ordered GROUP BY request_id, url)
    WHERE position < 30""")
def select_prefix(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    q, p = _dims(spark, hits)
    return search.select_prefix(search.merge(hits, q, p), 30).select("request_id", "position", "result.url")


@query(f"WITH {_HITS_SQL} SELECT request_id, url, min(idx) AS idx FROM hits GROUP BY request_id, url")
def first_hits(spark, sf_dir):
    return search.first_hits(_hits(spark, sf_dir)).select("request_id", "url", "idx")


@query(f"WITH {_HITS_SQL} SELECT request_id, count(*) - count(DISTINCT url) AS duplicates FROM hits GROUP BY request_id")
def duplicate_count(spark, sf_dir):
    return search.duplicate_count(_hits(spark, sf_dir))


@query(f"""WITH {_ATTEMPTS_SQL}, r AS (SELECT DISTINCT request_id FROM attempts),
    dim AS (SELECT request_id, provider, p FROM r, (SELECT * FROM prov UNION ALL SELECT 'unused', 4)),
    c AS (SELECT request_id, provider, count(*) AS attempts, count(*) FILTER (status = 'OK') AS succeeded, count(*) FILTER (status = 'EMPTY') AS empty, count(*) FILTER (status = 'FAILED') AS failed,
                 count(*) FILTER (status = 'SKIPPED_CIRCUIT_OPEN') AS skipped, sum(result_count) AS result_count, sum(duration_ms) AS duration_ms,
                 array_to_string(list_sort(list_distinct(list(category))), ',') AS error_categories FROM attempts GROUP BY 1, 2)
    SELECT request_id, provider, CASE WHEN attempts IS NULL THEN 'NOT_CALLED' WHEN succeeded + empty + failed = 0 THEN 'SKIPPED' WHEN failed = succeeded + empty + failed THEN 'FAILED'
           WHEN failed > 0 THEN 'PARTIAL' WHEN succeeded > 0 THEN 'SUCCESS' ELSE 'EMPTY' END AS status, coalesce(succeeded + empty + failed, 0) AS calls, coalesce(succeeded, 0) AS succeeded,
           coalesce(empty, 0) AS empty, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, CAST(coalesce(result_count, 0) AS BIGINT) AS result_count,
           CAST(coalesce(duration_ms, 0) AS BIGINT) AS duration_ms, coalesce(error_categories, '') AS error_categories FROM dim LEFT JOIN c USING (request_id, provider)""")
def provider_status(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    names = spark.createDataFrame([(n, i) for i, n in enumerate(("view", "click", "purchase", "error", "unused"))], "name string, ord int")
    dim = attempts.select("request_id").distinct().join(F.broadcast(names))
    return search.provider_status(attempts, dim).drop("ord").withColumn("error_categories", F.array_join("error_categories", ","))


@query(f"""WITH {_ATTEMPTS_SQL}, n AS (SELECT a.*, p FROM attempts a JOIN prov USING (provider)),
    c AS (SELECT request_id, query, min(p) FILTER (result_count > 0) AS chosen FROM n GROUP BY 1, 2)
    SELECT n.request_id, n.idx FROM n JOIN c USING (request_id, query) WHERE chosen IS NULL OR p <= chosen""")
def fallback_replay(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    q, p = _dims(spark, attempts)
    return search.fallback(attempts, q, p).select("request_id", "idx")


@query(f"""WITH {_ATTEMPTS_SQL}, i AS (SELECT *, sum(CASE WHEN status IN ('OK', 'EMPTY') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id, provider ORDER BY idx) AS island FROM attempts),
    r AS (SELECT *, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id, provider, island ORDER BY idx) AS run FROM i)
    SELECT request_id, idx, coalesce(lag(run) OVER (PARTITION BY request_id, provider ORDER BY idx), 0) >= 3 AS open_before FROM r""")
def circuit_breaker(spark, sf_dir):
    return search.breaker(_attempts(spark, sf_dir), 3).select("request_id", "idx", "open_before")


@query(f"""WITH {_ATTEMPTS_SQL} SELECT request_id, provider, category, min(idx) AS idx FROM attempts WHERE category IS NOT NULL GROUP BY 1, 2, 3""")
def provider_errors(spark, sf_dir):
    return search.provider_errors(_attempts(spark, sf_dir)).select("request_id", "provider", "category", "idx")


@query(f"""WITH {_ATTEMPTS_SQL}, o AS (SELECT request_id AS job_id, query, bool_or(status IN ('OK', 'EMPTY')) AS ok FROM attempts GROUP BY 1, 2)
    SELECT job_id, count(*) FILTER (ok) AS covered, count(*) AS planned, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'COMPLETE' WHEN count(*) FILTER (ok) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS coverage
    FROM o GROUP BY job_id""")
def coverage(spark, sf_dir):
    a = _attempts(spark, sf_dir).groupBy(F.col("request_id").alias("job_id"), "query").agg(F.bool_or(F.col("status").isin("OK", "EMPTY")).alias("ok"))
    return search.coverage_summary(a.withColumn("status", F.when(F.col("ok"), "COVERED").otherwise("FAILED")))


# -- duplicate groups --------------------------------------------------------------------------

_GROUP_COLUMNS = ("level", "key", "representative")


def _flat_groups(found: DataFrame) -> DataFrame:
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("members", "source_identities", "hosts", "warnings")}
    return found.select(*_GROUP_COLUMNS, *joined.values())


@query("""SELECT 'L3' AS level, 'L3:sha256:' || sha256(text) AS key, min(doc_id) AS representative, array_to_string(list(doc_id ORDER BY doc_id), ',') AS members, count(*) AS n
          FROM documents WHERE text <> '' GROUP BY text HAVING count(*) >= 2""")
def dedup_l3_groups(spark, sf_dir):
    """Exact-duplicate groups of documents: the flagship query."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    rows = d.select(
        F.col("doc_id").alias("position"), F.lit(None).cast("string").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.lit("SUCCESS").alias("status"),
        F.lit("OK").alias("fetch_status"), F.lit(None).cast("string").alias("content_sha256"), "text", F.when(F.col("text") != "", sha).alias("text_sha256"),
    )
    found = dedup.groups(rows, levels=("L3",), sources=False)
    return found.select("level", "key", "representative", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "n")


@query(f"""WITH {_DOCUMENTS_SQL}
    SELECT level, key, min(position) AS representative, array_to_string(list(position ORDER BY position), ',') AS members,
           coalesce(array_to_string(list_transform(list_filter(range(1, len(list(source_identity ORDER BY position)) + 1), lambda i: list_position(list(source_identity ORDER BY position), list(source_identity ORDER BY position)[i]) = i), lambda i: list(source_identity ORDER BY position)[i]), ','), '') AS source_identities,
           coalesce(array_to_string(list_transform(list_filter(range(1, len(list(host ORDER BY position)) + 1), lambda i: list_position(list(host ORDER BY position), list(host ORDER BY position)[i]) = i), lambda i: list(host ORDER BY position)[i]), ','), '') AS hosts,
           concat_ws(',', CASE WHEN level = 'L1' AND count(DISTINCT content_sha256) > 1 THEN 'SOURCE_CONTENT_DIFFERS' END,
                          CASE WHEN level = 'L1' AND count(DISTINCT fetch_status) > 1 THEN 'MIXED_FETCH_STATUS' END,
                          CASE WHEN level = 'L2' AND count(DISTINCT coalesce(text_sha256, '-')) > 1 THEN 'RAW_DUPLICATE_TEXT_DIFFERS' END,
                          CASE WHEN level <> 'L1' AND count(DISTINCT source_identity) > 1 THEN 'CROSS_SOURCE_DUPLICATE' END) AS warnings
    FROM members GROUP BY level, key""")
def dedup_groups(spark, sf_dir):
    return _flat_groups(dedup.groups(_documents(spark, sf_dir)))


@query(f"""WITH {_DOCUMENTS_SQL}, j AS (SELECT *, 'j' || (position % 50) AS job_id FROM levels WHERE key IS NOT NULL), g AS (SELECT job_id, level, key, min(position) AS representative, count(*) AS n FROM j GROUP BY 1, 2, 3 HAVING count(*) > 1)
           SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY level, representative) - 1 AS ord FROM g""")
def dedup_order(spark, sf_dir):
    """Groups of each of fifty jobs in their order."""
    d = _documents(spark, sf_dir).withColumn("job_id", F.concat(F.lit("j"), (F.col("position") % 50).cast("string")))
    return dedup.ordered(dedup.groups(d, ["job_id"]), ["job_id"]).select("job_id", "level", "key", "representative", "n", "ord")


@query(f"WITH {_DOCUMENTS_SQL} SELECT level, key, position, min(position) OVER (PARTITION BY level, key) AS representative FROM members")
def dedup_members(spark, sf_dir):
    return dedup.group_members(_documents(spark, sf_dir))


@query(f"WITH {_DOCUMENTS_SQL} SELECT position, level, reason FROM levels WHERE key IS NULL")
def dedup_exclusions(spark, sf_dir):
    return dedup.exclusions(_documents(spark, sf_dir))


@query(f"""WITH {_DOCUMENTS_SQL} SELECT position, level, reason AS code FROM levels WHERE reason IN ('INVALID_SOURCE_URL', 'INVALID_CONTENT_HASH', 'TEXT_TOO_LONG', 'MISSING_TEXT_HASH', 'TEXT_HASH_MISMATCH')""")
def dedup_errors(spark, sf_dir):
    return dedup.errors(_documents(spark, sf_dir))


@query(f"""WITH {_DOCUMENTS_SQL}, g AS (SELECT level, count(DISTINCT key) AS groups, count(*) AS grouped_documents FROM members GROUP BY level)
    SELECT level, count(*) AS documents, coalesce(any_value(groups), 0) AS groups, coalesce(any_value(grouped_documents), 0) AS grouped_documents, count(reason) AS exclusions,
           count(*) FILTER (reason IN ('INVALID_SOURCE_URL', 'INVALID_CONTENT_HASH', 'TEXT_TOO_LONG', 'MISSING_TEXT_HASH', 'TEXT_HASH_MISMATCH')) AS errors
    FROM levels LEFT JOIN g USING (level) GROUP BY level""")
def dedup_stats(spark, sf_dir):
    return dedup.stats(_documents(spark, sf_dir))


@query(f"WITH {_DOCUMENTS_SQL} SELECT position, source_identity, host, status, fetch_status, content_sha256, text_sha256 FROM docs")
def dedup_refs(spark, sf_dir):
    return dedup.refs(_documents(spark, sf_dir)).select("position", "source_identity", "host", "status", "fetch_status", "content_sha256", "text_sha256")


# -- fetch rules, jobs, stages --------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 600 IN (301, 302, 303, 307, 308) THEN CASE WHEN event_id % 2 = 0 THEN 'REDIRECT' ELSE 'INVALID_RESPONSE' END
           WHEN event_id % 600 < 200 OR event_id % 600 >= 300 THEN 'HTTP_ERROR' WHEN event_id % 3 = 0 THEN 'UNSUPPORTED_CONTENT_TYPE'
           WHEN event_id % 5 = 0 THEN 'INVALID_RESPONSE' WHEN event_id * 1000 > 5242880 THEN 'RESPONSE_TOO_LARGE' ELSE 'OK' END AS status FROM events""")
def response_rules(spark, sf_dir):
    n = F.col("event_id")
    status = crawl.header_status(
        n % 600, F.when(n % 2 == 0, "/next"), F.when(n % 3 == 0, "image/png").otherwise("text/html; charset=utf-8"), F.when(n % 5 == 0, "br"), (n * 1000).cast("string")
    )
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
          a AS (SELECT 'c' || user_id || '.' || (i // 2) AS crawl_id, i % 2 + 1 AS attempt, event_id FROM n),
          l AS (SELECT crawl_id, max(attempt) AS attempts, arg_max(event_id, attempt) AS e FROM a GROUP BY crawl_id)
          SELECT crawl_id, CASE WHEN attempts > 1 AND e % 4 IN (0, 1) THEN 'RETRY_EXHAUSTED' WHEN e % 4 = 0 THEN 'CONNECTION_ERROR' WHEN e % 4 = 1 THEN 'HTTP_ERROR' WHEN e % 4 = 2 THEN 'OK' ELSE 'DNS_ERROR' END AS status,
                 attempts, CASE WHEN attempts > 1 AND e % 4 = 0 THEN 'CONNECTION_ERROR' WHEN attempts > 1 AND e % 4 = 1 THEN 'HTTP_ERROR' END AS cause FROM l""")
def retry_outcome(spark, sf_dir):
    """Each user's events in turn are the attempts of fetches, two to a fetch."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    k = F.col("event_id") % 4
    status = F.when(k == 0, "CONNECTION_ERROR").when(k == 1, "HTTP_ERROR").when(k == 2, "OK").otherwise("DNS_ERROR")
    rows = table(spark, sf_dir, "events").withColumn("i", i).select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("."), F.floor(F.col("i") / 2).cast("string")).alias("crawl_id"),
        (F.col("i") % 2 + 1).alias("attempt"),
        status.alias("status"),
        F.when(k == 1, 503).alias("http_status"),
    )
    return crawl.final_attempts(rows).select("crawl_id", "status", "attempts", "cause")


_STATES = ("QUEUED", "PLANNING", "SEARCHING", "CRAWLING", "NORMALIZING", "COMPLETED")


@query("""WITH e AS (SELECT 'j' || user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id FROM events),
          s AS (SELECT job_id, seq, ['QUEUED', 'PLANNING', 'SEARCHING', 'CRAWLING', 'NORMALIZING', 'COMPLETED'][CASE WHEN event_id % 17 = 0 THEN 1 + event_id % 6 ELSE 1 + (seq - 1) % 6 END] AS state FROM e),
          l AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS previous FROM s),
          ok AS (SELECT * FROM (VALUES ('QUEUED', 'PLANNING'), ('PLANNING', 'SEARCHING'), ('SEARCHING', 'CRAWLING'), ('CRAWLING', 'NORMALIZING'), ('NORMALIZING', 'COMPLETED')) t(a, b))
          SELECT job_id, seq, previous, state FROM l LEFT JOIN ok ON previous = a AND state = b WHERE a IS NULL AND NOT (previous IS NULL AND state = 'QUEUED')""")
def transition_check(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    names = F.array(*(F.lit(s) for s in _STATES))
    rows = table(spark, sf_dir, "events").withColumn("seq", seq)
    place = F.when(F.col("event_id") % 17 == 0, F.col("event_id") % 6).otherwise((F.col("seq") - 1) % 6).cast("int")
    rows = rows.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), "seq", F.get(names, place).alias("state"))
    return jobs.illegal_transitions(rows, PIPELINE_STAGES)


@query("""SELECT event_id, CASE WHEN c THEN 'CANCELLED' WHEN stop IS NOT NULL THEN CASE WHEN covered > 0 THEN 'PARTIAL' ELSE 'FAILED' END WHEN covered = 0 THEN 'FAILED' WHEN covered = 3 THEN 'COMPLETED' ELSE 'PARTIAL' END AS status,
                 CASE WHEN NOT c AND covered = 0 THEN coalesce(stop, 'ALL_SEARCH_PROVIDERS_FAILED') END AS error,
                 CASE WHEN NOT c AND covered > 0 THEN coalesce(stop, CASE WHEN errors > 0 THEN 'PROVIDER_FAILURES' END) END AS warning
          FROM (SELECT event_id, event_id % 7 = 0 AS c, CASE event_id % 5 WHEN 0 THEN 'JOB_DEADLINE_EXCEEDED' WHEN 1 THEN 'SEARCH_STAGE_TIMEOUT' END AS stop, event_id % 4 AS covered, event_id % 3 AS errors FROM events)""")
def search_conclusion(spark, sf_dir):
    n = F.col("event_id")
    stop = F.when(n % 5 == 0, "JOB_DEADLINE_EXCEEDED").when(n % 5 == 1, "SEARCH_STAGE_TIMEOUT")
    end = jobs.search_conclusion(n % 7 == 0, stop, n % 4, F.lit(3), n % 3)
    return table(spark, sf_dir, "events").select("event_id", end.alias("e")).select("event_id", "e.*")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'CANCELLED' WHEN event_id % 7 = 0 OR (event_id % 5 > 0 AND event_id % 3 = 0) THEN 'FAILED' WHEN event_id % 2 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
                 CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'DEDUP_FAILED' WHEN event_id % 5 > 0 AND event_id % 3 = 0 THEN 'NO_DOCUMENTS' END END AS error,
                 CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN concat_ws(',', CASE WHEN event_id % 4 > 0 THEN 'FETCH_FAILURES' END, CASE WHEN event_id % 6 > 0 THEN 'EXTRACTION_DEGRADED' END, CASE WHEN event_id % 8 > 0 THEN 'DEDUP_CONTRACT_ERRORS' END) ELSE '' END AS warnings FROM events""")
def pipeline_conclusion(spark, sf_dir):
    n = F.col("event_id")
    end = jobs.pipeline_conclusion(n % 11 == 0, n % 7 == 0, n % 4, n % 6, n % 8, n % 5, n % 3, n % 2 == 0)
    rows = table(spark, sf_dir, "events").select("event_id", end.alias("e"))
    return rows.select("event_id", "e.status", "e.error", F.array_join("e.warnings", ",").alias("warnings"))


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN 'k' || (event_id % 40) END AS key, 'q' || (event_id % 80) AS query, event_id AS arrival FROM events),
          f AS (SELECT *, first_value(id) OVER w AS fid, first_value(query) OVER w AS fq FROM r WINDOW w AS (PARTITION BY key ORDER BY arrival))
          SELECT id, CASE WHEN key IS NULL THEN id WHEN fq = query THEN fid END AS job, key IS NOT NULL AND fq <> query AS conflict, substr(sha256(key), 1, 12) AS key_hash FROM f""")
def idempotency(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        n.alias("id"), F.when(n % 3 > 0, F.concat(F.lit("k"), (n % 40).cast("string"))).alias("key"), F.concat(F.lit("q"), (n % 80).cast("string")).alias("query"),
        F.lit("en").alias("language"), F.lit(None).cast("string").alias("country"), n.alias("arrival"),
    )
    return jobs.idempotent_requests(rows).select("id", "job", "conflict", "key_hash")


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as a selection of twenty jobs and as recorded fetches: some failed, some timed out, some missing."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id") % 10
    job = F.concat(F.lit("j"), (F.col("page_id") % 20).cast("string"))
    selection = pages.select(
        job.alias("job_id"), F.col("page_id").cast("int").alias("position"), F.struct(F.col("url").alias("url"), F.col("url").alias("original_url")).alias("result"),
        F.array(F.lit("view")).alias("providers"), F.array(F.lit("q")).alias("queries"),
    )
    fetched = extract.fetches_from_pages(pages.where(n != 7)).withColumn("job_id", F.concat(F.lit("j"), (F.col("position") % 20).cast("string")))
    k = F.col("position") % 10
    hop = F.struct(F.col("requested_url").alias("url"), F.lit(302).alias("http_status"), F.when(k == 5, "https://elsewhere.example/").otherwise("/next").alias("location"), F.lit(None).cast("string").alias("connected_ip"))
    late = sources.timeout_kind(F.col("requested_url"), F.lit(None).cast("string"), F.array(hop), F.col("position") % 3 == 0)
    fetched = fetched.withColumns({"status": F.when(k == 3, "HTTP_ERROR").when(k.isin(5, 6), "FETCH_TIMEOUT").otherwise("OK"), "http_status": F.when(k == 3, 404).when(~k.isin(5, 6), 200)})
    fetched = fetched.withColumn("timeout_kind", F.when(F.col("status") == "FETCH_TIMEOUT", late))
    fetched = fetched.withColumns({c: F.when(F.col("status") == "OK", F.col(c)) for c in ("content", "content_sha256")})
    return selection, fetched


def _replay_sql() -> str:
    return f"""{_URL_SQL}, {_PAGES_SQL},
    recorded AS (
        SELECT 'j' || (r.position % 20) AS job_id, r.position, r.url, r.text, r.html, u.normalized_url, r.position % 10 AS k,
               CASE r.position % 10 WHEN 7 THEN NULL WHEN 3 THEN 'HTTP_ERROR' WHEN 5 THEN 'FETCH_TIMEOUT' WHEN 6 THEN 'FETCH_TIMEOUT' ELSE 'OK' END AS fetch_status,
               CASE WHEN r.position % 10 = 5 THEN 'cross_host_redirect' WHEN r.position % 10 = 6 AND r.position % 3 = 0 THEN 'deadline_capped' WHEN r.position % 10 = 6 THEN 'other' END AS timeout_kind
        FROM rendered r JOIN urls u ON u.page_id = r.position
    ),
    leveled AS (
        SELECT job_id, position, 'L1' AS level, 'L1:url:' || normalized_url AS key FROM recorded WHERE k <> 7
        UNION ALL SELECT job_id, position, 'L2', 'L2:sha256:' || sha256(html) FROM recorded WHERE fetch_status = 'OK'
        UNION ALL SELECT job_id, position, 'L3', 'L3:sha256:' || sha256(text) FROM recorded WHERE fetch_status = 'OK' AND text <> ''
    ),
    grouped AS (SELECT * FROM leveled QUALIFY count(*) OVER (PARTITION BY job_id, level, key) > 1)"""


def _map_text(column: str) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


# -- extraction: SQL for the shape that the pages of these tables have -------------------------------


def _plain_sql(x: str) -> str:
    """Character references of the pages, decoded."""
    for name, character in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{character}', 'g')"
    return x


def _line_sql(x: str) -> str:
    """Text on one line."""
    hidden = r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x{9F}\x{AD}\x{200B}\x{2060}\x{FEFF}]"
    return rf"trim(nfc_normalize(regexp_replace(regexp_replace({x}, '{hidden}', '', 'g'), '[ \t\n\f\r\x{{A0}}\x{{2007}}\x{{202F}}]+', ' ', 'g')))"


def _chars_sql(x: str) -> str:
    """Characters of markup's text."""
    return f"length({_plain_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')")})"


# The article if it has 200 characters or a quarter of the body's text, else the body without its furniture.
# Furniture with half of the text or more stays.
_PAGES_SQL = rf"""
    part AS (
        SELECT page_id AS position, url, html, regexp_extract(html, '(?s)<body>(.*)$', 1) AS body, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article,
               regexp_extract(html, '(?s)<nav>(.*)</nav>', 1) AS nav, regexp_extract(html, '(?s)<footer>(.*)</footer>', 1) AS footer,
               regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad
        FROM pages
    ),
    measured AS (
        SELECT *, {_chars_sql("article")} AS a, {_chars_sql("body")} AS b, {_chars_sql("nav")} AS n, {_chars_sql("footer")} AS f, '<p>' || {_line_sql(_plain_sql("regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1
        FROM part
    ),
    chosen AS (
        SELECT *, CASE WHEN a > 0 AND (a >= 200 OR a >= 0.25 * b) THEN 'ARTICLE' ELSE 'BODY' END AS content_source,
               CASE WHEN h1 = '<p>' THEN '' ELSE replace(h1, '<p>', '<p># ') END || regexp_replace(article, '(?s)^.*?</h1>', '<p>') AS main
        FROM measured
    ),
    blocks AS (
        SELECT *, content_source = 'BODY' AND 2 * n >= b AS with_nav, content_source = 'BODY' AND 2 * f >= b AS with_footer,
               list_transform(string_split_regex(CASE content_source WHEN 'BODY' THEN ad || '<p>' || main || CASE WHEN 2 * f >= b THEN '<p>' || footer ELSE '' END ELSE main END, '</?p>'),
                   lambda x: trim(array_to_string(list_transform(string_split(x, '<br>'), lambda y: {_line_sql(_plain_sql("regexp_replace(y, '<[^>]*>', '', 'g')"))}), chr(10)), chr(10))) AS found,
               list_transform(regexp_extract_all(nav, '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: '- ' || {_line_sql(_plain_sql("x"))}) AS items
        FROM chosen
    ),
    texts AS (
        SELECT *, array_to_string(list_filter(list_concat(CASE WHEN with_nav THEN [array_to_string(items, chr(10))] ELSE [] END, found), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks
    ),
    rendered AS (
        SELECT position, url, html, content_source, text, {_line_sql(_plain_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
               lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS claimed_language,
               concat_ws(',', CASE WHEN content_source = 'BODY' OR a < 0.25 * b THEN 'LOW_CONFIDENCE_MAIN_CONTENT' END, CASE WHEN with_nav OR with_footer THEN 'BOILERPLATE_GUARD' END,
                              CASE WHEN text <> '' AND length(text) < 200 THEN 'THIN_CONTENT' END) AS warnings,
               CASE content_source WHEN 'BODY' THEN CASE WHEN with_nav THEN 0 ELSE n END + CASE WHEN with_footer THEN 0 ELSE f END ELSE 0 END AS furniture
        FROM texts
    )"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_documents(extract.fetches_from_pages(table(spark, sf_dir, "pages")))


@query(rf"""WITH {_PAGES_SQL}
            SELECT position, CASE WHEN text = '' THEN 'EMPTY' ELSE 'SUCCESS' END AS status, warnings, content_source, title, 'TITLE_TAG' AS title_source, text, length(text) AS char_count,
                   len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS word_count, CASE WHEN text <> '' THEN sha256(text) END AS text_sha256, claimed_language FROM rendered""")
def extract_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "position", "status", F.array_join("warnings", ",").alias("warnings"), "content_source", "title", "title_source", "text", "char_count", "word_count", "text_sha256", "claimed_language"
    )


@query(f"WITH {_PAGES_SQL} SELECT position, CASE WHEN title <> '' THEN 'TITLE_TAG' ELSE 'H1' END AS title_source, claimed_language, content_source, CAST(furniture AS INT) AS boilerplate_chars FROM rendered")
def page_facts(spark, sf_dir):
    removed = F.coalesce(F.try_element_at("removed_chars", F.lit("boilerplate")), F.lit(0)).alias("boilerplate_chars")
    return _pages(spark, sf_dir).select("position", "title_source", "claimed_language", "content_source", removed)


@query(r"""WITH raw AS (SELECT page_id AS position, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, string_split(html, '<article>')[1] AS head, string_split(html, '<article>')[2] AS tail FROM pages),
                a AS (SELECT position, origin, unnest(regexp_extract_all(head || tail, '(?s)<a href="[^"]*">.*?</a>')) AS tag, generate_subscripts(regexp_extract_all(head || tail, '(?s)<a href="[^"]*">.*?</a>'), 1) AS i FROM raw),
                l AS (SELECT position, i, origin || regexp_extract(tag, 'href="([^"]*)"', 1) AS url, regexp_extract(tag, '>(.*)</a>', 1) AS text FROM a),
                d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY position, url ORDER BY i) = 1)
           SELECT position, CAST(row_number() OVER (PARTITION BY position ORDER BY i) - 1 AS INT) AS ord, url, text FROM d""")
def link_table(spark, sf_dir):
    return extract.links(_pages(spark, sf_dir)).select("position", "ord", "url", "text")


@query("""SELECT page_id AS position, '{"declared_charset":"' || regexp_extract(html, '<meta charset="([^"]*)"', 1) || '"}' AS metadata FROM pages""")
def page_metadata(spark, sf_dir):
    return extract.metadata_json(_pages(spark, sf_dir))


@query(f"WITH {_PAGES_SQL} SELECT position AS page_id, claimed_language AS language, 'HTML_LANG' AS language_source FROM rendered")
def claimed_language(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("position").alias("page_id"), F.col("claimed_language").alias("language"), "language_source")


# -- recorded jobs: counters, records and groups over extracted pages ----------------------------------


@query(f"""WITH {_replay_sql()}, h AS (SELECT job_id, fetch_status, count(*) AS n FROM recorded WHERE fetch_status IS NOT NULL GROUP BY 1, 2),
           e AS (SELECT job_id, CASE WHEN fetch_status <> 'OK' THEN 'NOT_FETCHED' WHEN text = '' THEN 'EMPTY' ELSE 'SUCCESS' END AS s, count(*) AS n FROM recorded WHERE k <> 7 GROUP BY 1, 2),
           w AS (SELECT job_id, count(*) AS admitted, sum(position * 7 % 100) AS total, max(position * 7 % 100) AS longest FROM recorded WHERE k NOT IN (7, 9) GROUP BY job_id)
           SELECT r.job_id, count(*) AS selected, CAST(replace(r.job_id, 'j', '') AS BIGINT) AS not_selected, count(fetch_status) AS fetched, count(*) FILTER (fetch_status = 'OK') AS fetch_ok,
                  count(*) FILTER (fetch_status <> 'OK') AS fetch_failed, count(*) FILTER (fetch_status = 'FETCH_TIMEOUT') AS fetch_timeout,
                  count(*) FILTER (timeout_kind = 'cross_host_redirect') AS fetch_timeout_cross_host_redirect, count(*) FILTER (timeout_kind = 'deadline_capped') AS fetch_timeout_deadline_capped,
                  count(*) FILTER (timeout_kind = 'other') AS fetch_timeout_other, count(*) FILTER (k <> 7) AS extracted, count(*) FILTER (k = 7) AS not_run, CAST(0 AS BIGINT) AS interrupted,
                  CAST(0 AS BIGINT) AS fetched_not_extracted, CAST(sum(CASE WHEN fetch_status = 'OK' THEN length(text) ELSE 0 END) AS BIGINT) AS text_chars,
                  coalesce((SELECT string_agg(fetch_status || '=' || n, ',' ORDER BY fetch_status) FROM h WHERE h.job_id = r.job_id), '') AS fetch_status_counts,
                  coalesce((SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM e WHERE e.job_id = r.job_id), '') AS extraction_status_counts,
                  coalesce(any_value(admitted), 0) AS admitted, CAST(coalesce(any_value(total), 0) AS BIGINT) AS admission_wait_ms_total, coalesce(any_value(longest), 0) AS admission_wait_ms_max,
                  CAST(replace(r.job_id, 'j', '') AS INT) % 2 = 1 AS deadline_hit
           FROM recorded r LEFT JOIN w USING (job_id) GROUP BY r.job_id""")
def crawl_stats(spark, sf_dir):
    selection, fetched = _replay(spark, sf_dir)
    recs = sources.run_replay(selection, fetched)["records"]
    number = F.replace("job_id", F.lit("j"), F.lit("")).cast("long")
    waits = fetched.where("position % 10 <> 9").select("job_id", (F.col("position").cast("long") * 7 % 100).alias("wait_ms"))
    jobs_ = selection.select("job_id").distinct()
    stats = sources.crawl_stats(recs, waits, jobs_.select("job_id", number.alias("not_selected")), jobs_.where(number % 2 == 1))
    return stats.withColumns({c: _map_text(c) for c in ("fetch_status_counts", "extraction_status_counts")})


@query(f"""WITH {_replay_sql()}, g AS (SELECT job_id, position, string_agg(level || '=' || key, ',' ORDER BY level) AS group_keys FROM grouped GROUP BY 1, 2)
           SELECT job_id, position, url, CASE WHEN k = 7 THEN 'NOT_RUN' ELSE 'EXTRACTED' END AS state, fetch_status, CASE WHEN k = 3 THEN 404 WHEN fetch_status = 'OK' THEN 200 END AS http_status,
                  CASE WHEN k = 7 THEN NULL WHEN fetch_status <> 'OK' THEN 'NOT_FETCHED' WHEN text = '' THEN 'EMPTY' ELSE 'SUCCESS' END AS document_status, timeout_kind,
                  CAST(CASE WHEN fetch_status = 'OK' THEN length(text) ELSE 0 END AS INT) AS text_chars, coalesce(group_keys, '') AS group_keys
           FROM recorded LEFT JOIN g USING (job_id, position)""")
def source_records(spark, sf_dir):
    selection, fetched = _replay(spark, sf_dir)
    views = sources.run_replay(selection, fetched)["views"]
    return views.select("job_id", "position", "url", "state", "fetch_status", "http_status", "document_status", "timeout_kind", "text_chars", _map_text("group_keys").alias("group_keys"))


@query(f"""WITH {_DOCUMENTS_SQL}, j AS (SELECT 'j' || (position % 50) AS job_id, * FROM levels WHERE key IS NOT NULL AND position // 50 % 7 <> 3)
           SELECT job_id, level, key, min(position) AS representative, string_agg(position, ',' ORDER BY position) AS members FROM j GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def group_views(spark, sf_dir):
    """Groups as source positions, though some sources of a job have no document."""
    d = _documents(spark, sf_dir).withColumn("job_id", F.concat(F.lit("j"), (F.col("position") % 50).cast("string"))).where("position div 50 % 7 <> 3")
    found = sources.group_views(d)
    return found.select("job_id", "level", "key", "representative", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"""WITH {_replay_sql()}, s AS (SELECT job_id, count(*) AS urls_total, count(fetch_status) AS urls_done, count(*) FILTER (fetch_status <> 'OK') AS fetch_failed, count(fetch_status) AS documents FROM recorded GROUP BY 1),
           n AS (SELECT job_id, count(DISTINCT level || key) AS groups FROM grouped GROUP BY 1)
           SELECT s.*, coalesce(groups, 0) AS groups FROM s LEFT JOIN n USING (job_id)""")
def pipeline_counts(spark, sf_dir):
    run = sources.run_replay(*_replay(spark, sf_dir))
    return sources.pipeline_counts(run["stats"], run["groups"])


# The rest of the queries register themselves.
from siftwell.plans import control, scalars  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "control", "scalars"]
