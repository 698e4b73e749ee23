"""Explicit schemas and closed vocabularies."""

from __future__ import annotations

HIT = (
    "title string, url string, original_url string, snippet string, source string, published_at timestamp, "
    "rank int, query string, metadata map<string,string>"
)
HITS = f"request_id string, idx int, {HIT}"
ERROR = "struct<provider:string,code:string,category:string,message:string,retryable:boolean>"
ATTEMPTS = (
    f"request_id string, idx int, provider string, query string, status string, result_count int, duration_ms int, tries int, error {ERROR}"
)
HOP = "struct<url:string,http_status:int,location:string,connected_ip:string>"
FETCHES = (
    "job_id string, position int, crawl_id string, requested_url string, final_url string, status string, http_status int, "
    "content_type string, charset string, content_length int, wire_bytes int, content string, title string, content_sha256 string, "
    f"redirect_chain array<{HOP}>, resolved_ip string, robots struct<robots_url:string,outcome:string,allowed:boolean>, attempts int, "
    "fetched_at timestamp, duration_ms int, error struct<code:string,category:string,message:string,cause:string>"
)
EVENTS = "job_id string, seq int, type string, at timestamp, data map<string,string>"

# Statuses, reasons and codes.
FETCH_CATEGORY = {
    "OK": None,
    "POLICY_BLOCKED": "POLICY_BLOCKED",
    "SSRF_BLOCKED": "POLICY_BLOCKED",
    "ROBOTS_BLOCKED": "POLICY_BLOCKED",
    "DNS_ERROR": "NETWORK_ERROR",
    "CONNECTION_ERROR": "NETWORK_ERROR",
    "CONNECT_TIMEOUT": "TIMEOUT",
    "READ_TIMEOUT": "TIMEOUT",
    "FETCH_TIMEOUT": "TIMEOUT",
    "TLS_ERROR": "NETWORK_ERROR",
    "REDIRECT_LIMIT": "INVALID_RESPONSE",
    "REDIRECT_LOOP": "INVALID_RESPONSE",
    "HTTP_ERROR": "INVALID_RESPONSE",
    "UNSUPPORTED_CONTENT_TYPE": "INVALID_RESPONSE",
    "RESPONSE_TOO_LARGE": "INVALID_RESPONSE",
    "INVALID_RESPONSE": "INVALID_RESPONSE",
    "RETRY_EXHAUSTED": "NETWORK_ERROR",
}
EXTRACTION_STATUSES = ("SUCCESS", "PARTIAL", "EMPTY", "UNSUPPORTED", "FAILED", "NOT_FETCHED")
LEVELS = ("L1", "L2", "L3")
ERROR_REASONS = (
    "INVALID_SOURCE_URL",
    "INVALID_CONTENT_HASH",
    "TEXT_TOO_LONG",
    "MISSING_TEXT_HASH",
    "TEXT_HASH_MISMATCH",
    "TEXT_HASH_UNVERIFIABLE",
)
STAGES = ("PLANNING", "SEARCHING", "CRAWLING", "EXTRACTING", "NORMALIZING", "VERIFYING")
SEARCH_STAGES = ("PLANNING", "SEARCHING")
PIPELINE_STAGES = ("PLANNING", "SEARCHING", "CRAWLING", "NORMALIZING")
OUTCOMES = ("COMPLETED", "PARTIAL", "FAILED", "CANCELLED")
JOB_ERROR_CATEGORY = {
    "SEARCH_STAGE_TIMEOUT": "TIMEOUT",
    "JOB_DEADLINE_EXCEEDED": "TIMEOUT",
    "CANCELLED": "CANCELLED",
    "CRAWL_STAGE_TIMEOUT": "TIMEOUT",
    "FETCH_FAILURES": "FETCH_ERROR",
    "NO_DOCUMENTS": "FETCH_ERROR",
    "EXTRACTION_DEGRADED": "EXTRACTION_ERROR",
}
