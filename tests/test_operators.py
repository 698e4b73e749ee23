"""Grouping, search, crawl and job operators on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftwell.operators import crawl, dedup, jobs, search, sources
from siftwell.schemas import PIPELINE_STAGES, SEARCH_STAGES
from siftwell.sources import providers


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def doc(position, url="https://e.com/a", text="x", final=None, **over):
    row = {
        "position": position, "requested_url": url, "final_url": final, "status": "SUCCESS", "fetch_status": "OK", "content_sha256": sha("raw" + (text or "")),
        "text": text, "text_sha256": sha(text) if text else None,
    }
    return row | over


SCHEMA = "position int, requested_url string, final_url string, status string, fetch_status string, content_sha256 string, text string, text_sha256 string"


def documents(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def found(df):
    return {(r.level, r.representative): r for r in df.collect()}


def test_levels_are_independent(spark):
    df = documents(spark, doc(0, "https://a.com/", "t1"), doc(1, "https://a.com/?utm_x=1", "t2"), doc(2, "https://b.com/", "t2"))
    got = found(dedup.groups(df))
    assert got["L1", 0].members == [0, 1] and got["L1", 0].warnings == ["SOURCE_CONTENT_DIFFERS"]
    assert got["L3", 1].members == [1, 2] and got["L3", 1].warnings == ["CROSS_SOURCE_DUPLICATE"]
    assert got["L3", 1].hosts == ["a.com", "b.com"] and set(got) == {("L1", 0), ("L2", 1), ("L3", 1)}


def test_null_text_hash_counts_as_a_value(spark):
    same = sha("raw")
    df = documents(spark, doc(0, content_sha256=same), doc(1, text="", content_sha256=same, status="EMPTY"))
    assert "RAW_DUPLICATE_TEXT_DIFFERS" in found(dedup.groups(df))["L2", 0].warnings


def test_exclusions_and_errors(spark):
    df = documents(
        spark, doc(0, "ftp://x"), doc(1, content_sha256=None), doc(2, content_sha256="A" * 64), doc(3, status="PARTIAL"), doc(4, text=""), doc(5, text="", text_sha256=sha("q")),
        doc(6, text_sha256=None), doc(7, text_sha256=sha("other")), doc(8, final=""), doc(9, content_sha256=sha("h") + "\n"),
    )
    got = {(r.position, r.level): r.reason for r in dedup.exclusions(df).collect()}
    assert got == {
        (0, "L1"): "INVALID_SOURCE_URL", (1, "L2"): "NO_CONTENT_HASH", (2, "L2"): "INVALID_CONTENT_HASH", (3, "L3"): "NOT_SUCCESS", (4, "L3"): "EMPTY_TEXT",
        (5, "L3"): "TEXT_HASH_MISMATCH", (6, "L3"): "MISSING_TEXT_HASH", (7, "L3"): "TEXT_HASH_MISMATCH", (9, "L2"): "INVALID_CONTENT_HASH",
    }
    assert dedup.errors(df).count() == 6


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_do_not_depend_on_partitioning(spark, parts):
    df = documents(spark, *(doc(i, f"https://e.com/{i % 3}", f"t{i % 5}") for i in range(30)))
    got = sorted((r.level, r.key, r.members) for r in dedup.groups(df.repartition(parts)).collect())
    assert got == sorted((r.level, r.key, r.members) for r in dedup.groups(df).collect())


def test_stats_have_every_level(spark):
    got = {r.level: (r.groups, r.grouped_documents) for r in dedup.stats(documents(spark, doc(0), doc(1, "https://z.com/", "other"))).collect()}
    assert got == {"L1": (0, 0), "L2": (0, 0), "L3": (0, 0)}
    with pytest.raises(TypeError):
        dedup.document_set(spark.range(1))


def hits(spark, *rows):
    return spark.createDataFrame([("r", i, u, u, q, s, k) for i, (u, q, s, k) in enumerate(rows)], "request_id string, idx int, title string, url string, query string, source string, rank int")


def dims(spark, *names):
    return spark.createDataFrame([("r", n, i) for i, n in enumerate(names)], "request_id string, name string, ord int")


def test_merge_orders_and_collects(spark):
    h = hits(spark, ("u2", "q2", "p1", 1), ("u1", "q1", "p2", 2), ("u2", "q1", "p2", 1), ("u3", "q9", "p1", 1))
    got = search.merge(h, dims(spark, "q1", "q2"), dims(spark, "p1", "p2")).orderBy("position").collect()
    assert [(r.result.url, r.providers, r.queries, r.occurrences) for r in got] == [("u2", ["p2", "p1"], ["q1", "q2"], 2), ("u1", ["p2"], ["q1"], 1), ("u3", ["p1"], ["q9"], 1)]
    assert [r.url for r in search.first_hits(h).orderBy("idx").collect()] == ["u2", "u1", "u3"]


def test_breaker_skips_do_not_close_it(spark):
    rows = [("r", i, "p", s) for i, s in enumerate(["FAILED", "FAILED", "SKIPPED_CIRCUIT_OPEN", "FAILED", "EMPTY", "FAILED"])]
    got = search.breaker(spark.createDataFrame(rows, "request_id string, idx int, provider string, status string"), 2).orderBy("idx").collect()
    assert [r.open_before for r in got] == [False, False, True, True, True, False]


def test_provider_json(spark):
    body = '{"id":"i","results":[{"title":" T ","url":"notaurl"},{"title":"B","url":"https://E.com","snippet":"","date":"2024-01-02","last_updated":"x"}]}'
    df = spark.createDataFrame([("r", "q", body)], "request_id string, query string, body string")
    (r,) = providers.perplexity_hits(df).collect()
    assert (r.rank, r.url, r.snippet, r.metadata) == (2, "https://e.com/", None, {"provider_request_id": "i", "last_updated": "x"})
    google = '{"items":[{"title":"T","link":"https://e.com/x","displayLink":"e","pagemap":{"metatags":[{"a":"b"},{"og:published_time":"2024-01-02"}]}}]}'
    (g,) = providers.google_hits(df.withColumn("body", F.lit(google))).collect()
    assert g.published_at.isoformat() == "2024-01-02T00:00:00" and g.metadata == {"display_link": "e"}
    assert providers.google_hits(df.withColumn("body", F.lit("{}"))).count() == 0


def test_response_errors(spark):
    df = spark.createDataFrame([(401, "{}"), (429, "{}"), (503, "{}"), (404, "{}"), (302, "{}"), (200, "{"), (200, "{}")], "c int, b string")
    got = [r.e and r.e.category for r in df.select(providers.response_error(F.col("c"), F.col("b")).alias("e")).collect()]
    assert got == ["AUTH_ERROR", "RATE_LIMITED", "PROVIDER_UNAVAILABLE", "INVALID_REQUEST", "INVALID_RESPONSE", "INVALID_RESPONSE", None]


def test_provider_settings():
    assert providers.provider_status({"perplexity_api_key": "x"}, ("perplexity", "google", "z")) == [
        ("perplexity", "CONFIGURED", []), ("google", "REQUIRES_CONFIGURATION", ["GOOGLE_API_KEY", "GOOGLE_CSE_ID"]), ("z", "UNKNOWN_PROVIDER", []),
    ]
    with pytest.raises(ValueError):
        providers.configured({})


def test_redirects(spark):
    rows = [
        ("ok", 0, "https://e.com/a", "/b"), ("ok", 1, "https://e.com/b", None), ("loop", 0, "https://e.com/a", "/b"), ("loop", 1, "https://e.com/b", "/a"),
        ("down", 0, "https://e.com/a", "http://e.com/b"), *(("long", i, f"https://e.com/{i}", f"/{i + 1}") for i in range(7)),
    ]
    got = {r.crawl_id: (r.outcome, r.redirects) for r in crawl.redirect_outcome(spark.createDataFrame(rows, "crawl_id string, hop int, url string, location string")).collect()}
    assert got == {"ok": ("OK", 1), "loop": ("REDIRECT_LOOP", 1), "down": ("POLICY_BLOCKED", 0), "long": ("REDIRECT_LIMIT", 5)}


def test_read_responses(spark):
    rows = [("u", 200, {"content-type": "text/html; charset=latin-1"}, b"\xe9"), ("v", 404, {"retry-after": "3"}, b""), ("w", 200, {"content-type": "text/html", "content-encoding": "gzip"}, b"zz")]
    got = {r.url: r for r in crawl.read_responses(spark.createDataFrame(rows, "url string, http_status int, headers map<string,string>, body binary")).collect()}
    assert (got["u"].content, got["u"].status) == ("é", "OK")
    assert (got["v"].status, got["v"].retry_after_s, got["v"].category) == ("HTTP_ERROR", 3.0, "INVALID_RESPONSE")
    assert got["w"].status == "INVALID_RESPONSE"


def test_transitions():
    assert jobs.allowed_targets(SEARCH_STAGES, "QUEUED") == {"PLANNING", "CANCELLED", "FAILED"}
    assert jobs.allowed_targets(SEARCH_STAGES, "SEARCHING") == {"COMPLETED", "PARTIAL", "FAILED", "CANCELLED"}
    assert jobs.allowed_targets(PIPELINE_STAGES, "SEARCHING") == {"CRAWLING", "CANCELLED", "FAILED"}
    assert not jobs.allowed_targets(SEARCH_STAGES, "COMPLETED") and not jobs.allowed_targets(SEARCH_STAGES, "CRAWLING")


def test_decision_tables(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    null, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    after = one(jobs.after_search(no, F.lit("SEARCH_STAGE_TIMEOUT"), F.lit(1), F.lit(2), F.lit(0)))
    assert (after.status, after.warning, after.degraded) == (None, "SEARCH_STAGE_TIMEOUT", True)
    assert one(jobs.after_search(no, null, F.lit(0), F.lit(2), F.lit(1))).status == "FAILED"
    assert one(jobs.after_crawl(F.lit("CRAWLING"), yes, F.lit("CRAWL_FAILED"), null, F.lit(0)))[:3] == ("CANCELLED", None, "CRAWL_FAILED")
    assert one(jobs.after_crawl(F.lit("CRAWLING"), no, null, F.lit("JOB_DEADLINE"), F.lit(0)))[:2] == ("FAILED", "JOB_DEADLINE_EXCEEDED")
    assert one(jobs.crawl_outcome(F.lit("STAGE_TIMEOUT"), null)).code == "CRAWL_STAGE_TIMEOUT"
    assert one(jobs.valid_stages(F.array(F.lit("SEARCHING"), F.lit("PLANNING")))) is False
    assert one(jobs.valid_plan(F.array(F.lit("a"), F.lit(" a ")))) is False
    assert one(jobs.error_category(F.lit("NO_DOCUMENTS"))) == "FETCH_ERROR"
    assert [s.stage for s in one(jobs.stage_outcomes(PIPELINE_STAGES, F.lit("SEARCHING")))] == ["CRAWLING", "NORMALIZING"]


def test_admission_order(spark):
    rows = [("x", "j1", p, h) for p, h in enumerate(["a", "a", "b"])] + [("x", "j2", 0, "a")]
    got = jobs.admission_order(spark.createDataFrame(rows, "pool string, job_id string, position int, host string"), 2, 1, 2).orderBy("granted").collect()
    assert [(r.job_id, r.position, r["round"]) for r in got] == [("j1", 0, 1), ("j1", 2, 1), ("j2", 0, 2), ("j1", 1, 3)]


def test_timeout_kind(spark):
    df = spark.createDataFrame([("https://a.com/x", None, [("https://a.com/x", 302, "https://b.com/", None)]), ("https://a.com/x", None, [])], "r string, f string, c array<struct<url:string,http_status:int,location:string,connected_ip:string>>")
    got = [r.k for r in df.select(sources.timeout_kind(F.col("r"), F.col("f"), F.col("c"), F.lit(True)).alias("k")).collect()]
    assert got == ["cross_host_redirect", "deadline_capped"]
