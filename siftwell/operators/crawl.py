"""Recorded HTTP exchanges to fetch results: response rules, redirects, robots, retries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import headers, urls
from siftwell.functions.decoding import ENCODINGS, decode_udf
from siftwell.schemas import FETCH_CATEGORY

# Fixed values.
PAGE_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
REDIRECTS = (301, 302, 303, 307, 308)
MAX_BODY = 5 * 1024 * 1024
ROBOTS_BODY = 512 * 1024
MAX_REDIRECTS = 5
RETRIED = ("CONNECTION_ERROR", "CONNECT_TIMEOUT")
RETRIED_HTTP = (429, 502, 503, 504)
ROBOTS_UNREACHABLE = ("DNS_ERROR", "CONNECTION_ERROR", "CONNECT_TIMEOUT", "TLS_ERROR")


def header_status(code: Column, location: Column, content_type: Column, encoding: Column, length: Column, max_body: int = MAX_BODY, page: bool = True) -> Column:
    """What the head of a response decides: REDIRECT, a final status, or OK if the body is to be read."""
    name = F.lower(F.trim(F.coalesce(encoding, F.lit("identity"))))
    wire = max_body + max_body // 10 + 65_536
    declared = F.when(length.rlike(r"\A[0-9]+\z"), length.try_cast("decimal(38,0)"))
    limit = F.when(name.isin("", "identity"), max_body).otherwise(wire)
    decided = F.when(code.isin(*REDIRECTS), F.when(F.coalesce(location, F.lit("")) == "", "INVALID_RESPONSE").otherwise("REDIRECT")).when(
        (code < 200) | (code >= 300), "HTTP_ERROR"
    )
    if page:
        decided = decided.when(~F.coalesce(headers.media_type(content_type).isin(*PAGE_TYPES), F.lit(False)), "UNSUPPORTED_CONTENT_TYPE")
    return decided.when(~name.isin(*ENCODINGS), "INVALID_RESPONSE").when(declared > limit, "RESPONSE_TOO_LARGE").otherwise("OK")


def read_responses(responses: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    """Responses ``url, http_status, headers MAP, body BINARY`` with status, type, text and hashes.

    Only bodies that the head lets through reach Python.
    """
    h = F.col("headers")
    head = responses.withColumn(
        "status", header_status(F.col("http_status"), h["location"], h["content-type"], h["content-encoding"], h["content-length"], max_body)
    )
    wire = F.octet_length("body")
    over = (F.col("status") == "OK") & (wire > max_body + max_body // 10 + 65_536)
    head = head.withColumn("status", F.when(over, "RESPONSE_TOO_LARGE").otherwise(F.col("status")))
    body = F.when(F.col("status") == "OK", F.col("body"))
    read = head.withColumn("_d", decode_udf(max_body)(body, h["content-encoding"]))
    read = read.withColumn("status", F.when(F.col("status") == "OK", F.col("_d.status")).otherwise(F.col("status")))
    good = F.col("status") == "OK"
    read = read.withColumn("_t", headers.decode_body_udf(F.when(good, F.col("_d.body")), headers.declared_charset(h["content-type"])))
    return read.select(
        *(c for c in responses.columns if c not in ("headers", "body")),
        "status",
        headers.media_type(h["content-type"]).alias("content_type"),
        "_t.charset",
        "_t.content",
        "_t.content_sha256",
        "_t.content_length",
        F.when(good, wire).alias("wire_bytes"),
        F.when(F.col("status") == "HTTP_ERROR", headers.retry_after(h["retry-after"])).alias("retry_after_s"),
        category(F.col("status")).alias("category"),
    )


def category(status: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FETCH_CATEGORY.items() if v))
    return F.try_element_at(known, status)


def should_retry(status: Column, http_status: Column, attempt: Column, retries: int = 1) -> Column:
    transient = status.isin(*RETRIED) | (status.eqNullSafe("HTTP_ERROR") & F.coalesce(http_status.isin(*RETRIED_HTTP), F.lit(False)))
    return transient & (attempt <= retries)


def final_attempts(attempts: DataFrame, retries: int = 1) -> DataFrame:
    """The result of each fetch from its attempts ``crawl_id, attempt, status, http_status``.

    The last attempt counts; if it still asks for a retry, the result is RETRY_EXHAUSTED with its
    own status as the cause.
    """
    last = attempts.groupBy("crawl_id").agg(F.max_by(F.struct("status", "http_status"), "attempt").alias("r"), F.max("attempt").alias("attempts"))
    status, code = F.col("r.status"), F.col("r.http_status")
    spent = should_retry(status, code, F.lit(0)) & (F.col("attempts") > retries)
    return last.select(
        "crawl_id",
        F.when(spent, "RETRY_EXHAUSTED").otherwise(status).alias("status"),
        code.alias("http_status"),
        "attempts",
        F.when(spent, status).alias("cause"),
    )


def redirect_outcome(hops: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """Follow recorded hops ``crawl_id, hop, url, location`` (hop 0 first; a null location ends).

    Checks per step are a downgrade to http, a loop by canonical URL, then the limit. The fold is
    one window pass in hop order.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("crawl_id").orderBy("hop")
    target = urls.join_url_udf(F.col("location"), F.col("url"))
    seen = F.collect_set("_key").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hops.withColumn("_key", urls.loop_key(F.col("url"))).withColumn("target", F.when(F.col("location").isNotNull(), target))
    rows = rows.withColumn("_seen", seen)
    problem = (
        F.when(F.col("location").isNull(), "OK")
        .when(F.col("target").isNull(), "POLICY_BLOCKED")
        .when(F.lower("url").startswith("https://") & F.col("target").startswith("http://"), "POLICY_BLOCKED")
        .when(F.col("hop") >= most, "REDIRECT_LIMIT")
        .when(F.array_contains("_seen", F.col("target")), "REDIRECT_LOOP")
    )
    rows = rows.withColumn("outcome", problem)
    return rows.where("outcome is not null").groupBy("crawl_id").agg(
        F.min_by("outcome", "hop").alias("outcome"), F.min_by(F.coalesce("target", "url"), "hop").alias("final_url"), F.min("hop").alias("redirects")
    )


def robots_entry(status: Column, http_status: Column) -> Column:
    """How a robots.txt fetch counts: PARSED, UNAVAILABLE_ALLOW, a network failure, or disallow."""
    return (
        F.when(status == "SSRF_BLOCKED", "SSRF_BLOCKED")
        .when(status.isin(*ROBOTS_UNREACHABLE), "NETWORK_FAILURE")
        .when(status == "OK", "PARSED")
        .when((status == "HTTP_ERROR") & http_status.between(400, 499), "UNAVAILABLE_ALLOW")
        .otherwise("UNREACHABLE_DISALLOW")
    )


def robots_gate(entry: Column, allowed_by_rules: Column, network_status: Column) -> Column:
    """``struct(outcome, allowed, page_status)``; a null page status lets the page be fetched."""
    allowed = F.when(entry == "PARSED", F.coalesce(allowed_by_rules, F.lit(True))).otherwise(entry == "UNAVAILABLE_ALLOW")
    outcome = F.when(entry == "PARSED", F.when(allowed, "ALLOWED").otherwise("DISALLOWED")).when(entry == "UNAVAILABLE_ALLOW", entry).when(
        entry != "SSRF_BLOCKED", "UNREACHABLE_DISALLOW"
    )
    page = F.when(entry == "SSRF_BLOCKED", entry).when(entry == "NETWORK_FAILURE", network_status).when(~allowed, "ROBOTS_BLOCKED")
    return F.struct(outcome.alias("outcome"), allowed.alias("allowed"), page.alias("page_status"))


def cached_robots(fetches: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Fetches with the robots entry of their origin that has not expired at ``now``."""
    live = cache.where(F.col("expires") > now)
    return fetches.withColumn("origin", urls.origin(F.col("requested_url"))).join(live, "origin", "left")
