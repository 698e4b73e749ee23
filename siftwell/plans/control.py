"""Queries of search, fetch and job rules, and of views, over recorded events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import urls
from siftwell.operators import admission, crawl, jobs, search, sources, views
from siftwell.plans.queries import _ATTEMPTS_SQL, _HITS_SQL, _attempts, _dims, _hits
from siftwell.plans.registry import query
from siftwell.schemas import PIPELINE_STAGES
from siftwell.session import table
from siftwell.sources import providers


def _n():
    return F.col("event_id")



def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# -- searches -------------------------------------------------------------------------------


@query(f"WITH {_ATTEMPTS_SQL} SELECT request_id, idx, p FROM attempts LEFT JOIN prov USING (provider)")
def fanout(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    return search.fanout(attempts, _dims(spark, attempts)[1]).select("request_id", "idx", "p")


@query("""WITH a AS (SELECT 'r' || (event_id // 3) AS request_id, event_id, event_id % 11 BETWEEN 6 AND 10 AS bad FROM events WHERE event_id % 11 <> 4 AND event_id % 11 <> 5)
          SELECT request_id FROM a GROUP BY request_id HAVING bool_and(bad)""")
def all_failed(spark, sf_dir):
    """Requests (here of three calls at most) without hits in which no call answered."""
    attempts = _attempts(spark, sf_dir).withColumn("request_id", F.expr("'r' || idx div 3")).where("idx % 11 not in (4, 5)")
    return search.all_failed(attempts, attempts.where("result_count > 0"))


@query(f"WITH {_ATTEMPTS_SQL} SELECT request_id, idx, 'PROVIDER_ERROR' AS code, category FROM attempts WHERE category IS NOT NULL")
def attempt_errors(spark, sf_dir):
    return search.attempt_errors(_attempts(spark, sf_dir)).select("request_id", "idx", "code", "category")


@query(f"""WITH {_ATTEMPTS_SQL} SELECT request_id, idx, provider, status, CASE WHEN status = 'SKIPPED_CIRCUIT_OPEN' THEN 0 ELSE 1 END AS tries, result_count,
           CASE WHEN category IS NOT NULL THEN provider || '/PROVIDER_ERROR/' || category || '/true' END AS error FROM attempts""")
def attempt_records(spark, sf_dir):
    found = views.attempt_records(_attempts(spark, sf_dir))
    e = F.col("error")
    shown = F.when(e.isNotNull(), F.concat_ws("/", e["provider"], e["code"], e["category"], e["retryable"].cast("string")))
    return found.select("request_id", "idx", "provider", "status", "tries", "result_count", shown.alias("error"))


@query(f"""WITH {_ATTEMPTS_SQL}, d AS (SELECT request_id AS job_id, query, CAST(substr(query, 2) AS INT) AS i, bool_or(status IN ('OK', 'EMPTY')) AS ok FROM attempts GROUP BY 1, 2, 3),
           p AS (SELECT job_id, i FROM (SELECT DISTINCT job_id FROM d), range(0, 8) t(i))
           SELECT p.job_id, p.i AS index, CASE WHEN d.job_id IS NULL THEN CASE WHEN p.i = 7 THEN 'INTERRUPTED' ELSE 'NOT_RUN' END WHEN ok THEN 'COVERED' ELSE 'FAILED' END AS status FROM p LEFT JOIN d USING (job_id, i)""")
def stopped_coverage(spark, sf_dir):
    """Eight planned queries of each request after a stop; those without an outcome were not run, the last was under way."""
    a = _attempts(spark, sf_dir)
    planned = a.select(F.col("request_id").alias("job_id")).distinct().withColumn("index", F.explode(F.expr("sequence(0, 7)"))).withColumn("query", F.concat(F.lit("q"), "index"))
    done = search.query_outcomes(a.select(F.col("request_id").alias("job_id"), "query").distinct(), a).withColumn("index", F.substring("query", 2, 9).cast("int"))
    begun = planned.where("index = 7").select("job_id", "index", F.lit(None).cast("string").alias("status"), F.lit(True).alias("started"))
    outcomes = done.select("job_id", "index", "status", F.lit(True).alias("started")).unionByName(begun)
    return search.coverage(planned, outcomes, True).select("job_id", "index", "status")


@query(f"""WITH {_ATTEMPTS_SQL}, d AS (SELECT request_id AS job_id, CAST(substr(query, 2) AS INT) AS i, CASE WHEN bool_or(status IN ('OK', 'EMPTY')) THEN 'COVERED' ELSE 'FAILED' END AS s FROM attempts GROUP BY 1, 2)
           SELECT job_id, string_agg(i || '=' || s, ',' ORDER BY i) AS outcomes FROM d GROUP BY job_id""")
def outcome_lists(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    done = search.query_outcomes(a.select(F.col("request_id").alias("job_id"), "query").distinct(), a).select("job_id", F.substring("query", 2, 9).cast("int").alias("index"), "status")
    found = views.outcomes_in_order(done)
    return found.select("job_id", F.array_join(F.transform("outcomes", lambda o: F.concat_ws("=", o["index"].cast("string"), o["status"])), ",").alias("outcomes"))


@query(f"WITH {_HITS_SQL} SELECT request_id, greatest(count(DISTINCT url) - 30, 0) AS not_selected FROM hits GROUP BY request_id")
def not_selected(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return search.not_selected(search.merge(hits, *_dims(spark, hits)), 30)


_BODY_SQL = """
    b AS (SELECT event_id, 'q' || (user_id % 7) AS query, unnest(range(0, 3)) AS place FROM events),
    h AS (SELECT event_id, place + 1 AS rank, 'T' || event_id AS title, 'https://h' || (event_id % 97) || '.example/p' || place AS url FROM b WHERE place <> 1)"""


def _answers(spark, sf_dir, link: str, one: str):
    """Recorded answers of three entries each; the second one's URL is none."""
    entry = [F.struct(F.concat(F.lit(" T"), _n(), F.lit(" ")).alias("title"), (F.lit("not a url") if i == 1 else F.concat(F.lit("HTTPS://H"), _n() % 97, F.lit(f".example/p{i}#x"))).alias(link), F.lit("").alias("snippet"), F.date_format("ts", "yyyy-MM-dd").alias("date")) for i in range(3)]
    body = F.to_json(F.struct(F.concat(F.lit("id"), _n()).alias("id"), F.array(*entry).alias(one)))
    return _events(spark, sf_dir).select(_n().cast("string").alias("request_id"), F.concat(F.lit("q"), F.col("user_id") % 7).alias("query"), body.alias("body"))


@query(f"WITH {_BODY_SQL} SELECT CAST(event_id AS VARCHAR) AS request_id, rank, title, url, CAST(NULL AS VARCHAR) AS snippet, CAST(date_trunc('day', ts) AS TIMESTAMP) AS published_at, 'id' || event_id AS provider_request_id FROM h JOIN events USING (event_id)")
def perplexity_hits(spark, sf_dir):
    """Answers to hits: entries without a usable URL go, ranks stay."""
    found = providers.perplexity_hits(_answers(spark, sf_dir, "url", "results"))
    return found.select("request_id", "rank", "title", "url", "snippet", "published_at", F.col("metadata")["provider_request_id"].alias("provider_request_id"))


@query(f"WITH {_BODY_SQL} SELECT CAST(event_id AS VARCHAR) AS request_id, rank, title, url FROM h")
def google_hits(spark, sf_dir):
    return providers.google_hits(_answers(spark, sf_dir, "link", "items")).select("request_id", "rank", "title", "url")


@query("""SELECT event_id, CASE WHEN c IN (401, 403) THEN 'AUTH_ERROR' WHEN c = 429 THEN 'RATE_LIMITED' WHEN c >= 500 THEN 'PROVIDER_UNAVAILABLE' WHEN c >= 400 THEN 'INVALID_REQUEST'
                 WHEN c < 200 OR c >= 300 THEN 'INVALID_RESPONSE' WHEN event_id % 2 = 1 THEN 'INVALID_RESPONSE' END AS category, coalesce(c = 429 OR c >= 500, FALSE) AS retryable
          FROM (SELECT event_id, event_id % 600 AS c FROM events)""")
def answer_errors(spark, sf_dir):
    error = providers.response_error(_n() % 600, F.when(_n() % 2 == 1, "{").otherwise("{}"))
    return _events(spark, sf_dir).select("event_id", error["category"].alias("category"), F.coalesce(error["retryable"], F.lit(False)).alias("retryable"))


# -- fetches --------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS hop, user_id % 4 AS k FROM events QUALIFY hop <= CASE user_id % 4 WHEN 0 THEN 2 ELSE 9 END),
               h AS (SELECT user_id, k, max(hop) AS last FROM f GROUP BY 1, 2)
          SELECT 'c' || user_id AS crawl_id, CASE WHEN k = 0 THEN CASE WHEN last < 2 THEN NULL ELSE 'OK' END WHEN k = 1 THEN CASE WHEN last >= 5 THEN 'REDIRECT_LIMIT' END
                 WHEN k = 2 THEN CASE WHEN last >= 1 THEN 'REDIRECT_LOOP' END ELSE 'POLICY_BLOCKED' END AS outcome
          FROM h WHERE NOT (k = 0 AND last < 2) AND NOT (k = 1 AND last < 5) AND NOT (k = 2 AND last < 1)""")
def redirect_walks(spark, sf_dir):
    """Each user's events as the hops of one fetch that ends, runs on, turns back, or goes to plain http."""
    from pyspark.sql import Window

    hop = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("hop")
    k, site = F.col("user_id") % 4, F.concat(F.lit("https://u"), "user_id", F.lit(".example/"))
    rows = _events(spark, sf_dir).select("user_id", k.alias("k"), site.alias("site"), hop).where("hop <= if(k = 0, 2, 9)")
    path = F.when(F.col("k") == 2, F.col("hop") % 2).otherwise(F.col("hop"))
    after = F.when(F.col("k") == 2, (F.col("hop") + 1) % 2).otherwise(F.col("hop") + 1)
    location = F.when((F.col("k") == 0) & (F.col("hop") == 2), None).when(F.col("k") == 3, F.concat(F.lit("http://u"), "user_id", F.lit(".example/"))).otherwise(F.concat(F.lit("/"), after.cast("string")))
    hops = rows.select(F.concat(F.lit("c"), "user_id").alias("crawl_id"), "hop", F.concat("site", path.cast("string")).alias("url"), location.alias("location"))
    return crawl.redirect_outcome(hops).select("crawl_id", "outcome")


@query("""WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'SSRF_BLOCKED' WHEN 1 THEN 'NETWORK_FAILURE' WHEN 2 THEN 'PARSED' WHEN 3 THEN 'UNAVAILABLE_ALLOW' ELSE 'UNREACHABLE_DISALLOW' END AS entry, event_id % 4 = 0 AS rules FROM events)
          SELECT event_id, entry, CASE entry WHEN 'PARSED' THEN CASE WHEN rules THEN 'ALLOWED' ELSE 'DISALLOWED' END WHEN 'UNAVAILABLE_ALLOW' THEN entry WHEN 'SSRF_BLOCKED' THEN NULL ELSE 'UNREACHABLE_DISALLOW' END AS outcome,
                 entry = 'UNAVAILABLE_ALLOW' OR (entry = 'PARSED' AND rules) AS allowed,
                 CASE entry WHEN 'SSRF_BLOCKED' THEN entry WHEN 'NETWORK_FAILURE' THEN 'DNS_ERROR' WHEN 'UNAVAILABLE_ALLOW' THEN NULL WHEN 'PARSED' THEN CASE WHEN NOT rules THEN 'ROBOTS_BLOCKED' END ELSE 'ROBOTS_BLOCKED' END AS page_status FROM e""")
def robots_gate(spark, sf_dir):
    """How robots.txt fetches count, and what that means for a page."""
    k = _n() % 6
    status = F.when(k == 0, "SSRF_BLOCKED").when(k == 1, "DNS_ERROR").when(k == 2, "OK").when(k.isin(3, 4), "HTTP_ERROR").otherwise("READ_TIMEOUT")
    entry = crawl.robots_entry(status, F.when(k == 3, 404).when(k == 4, 503))
    rows = _events(spark, sf_dir).select("event_id", entry.alias("entry"), (_n() % 4 == 0).alias("rules"), status.alias("s"))
    return rows.select("event_id", "entry", crawl.robots_gate(F.col("entry"), F.col("rules"), F.col("s")).alias("g")).select("event_id", "entry", "g.*")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages), o AS (SELECT origin, min(page_id) AS first FROM p GROUP BY origin)
           SELECT page_id, origin, CASE WHEN first % 3 > 0 THEN 'PARSED' END AS entry FROM p JOIN o USING (origin)""")
def robots_cache(spark, sf_dir):
    """Pages with the entry of their origin that has not expired."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("requested_url"))
    now = F.lit("2024-01-02").cast("timestamp")
    cache = pages.groupBy(urls.origin(F.col("requested_url")).alias("origin")).agg(F.min("page_id").alias("first"))
    cache = cache.select("origin", F.lit("PARSED").alias("entry"), F.when(F.col("first") % 3 > 0, "2024-01-03").otherwise("2024-01-01").cast("timestamp").alias("expires"))
    return crawl.cached_robots(pages, cache, now).select("page_id", "origin", "entry")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cross_host_redirect' WHEN 1 THEN 'cross_host_redirect' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'deadline_capped' ELSE 'other' END
                 ELSE CASE WHEN event_id % 3 = 0 THEN 'deadline_capped' ELSE 'other' END END AS kind FROM events""")
def timeout_kinds(spark, sf_dir):
    k = _n() % 4
    site = F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example/"))
    hop = F.struct(site.alias("url"), F.lit(302).alias("http_status"), F.when(k == 0, "https://elsewhere.example/").otherwise("/next").alias("location"), F.lit(None).cast("string").alias("connected_ip"))
    kind = sources.timeout_kind(site, F.when(k == 1, "https://final.example/").when(k == 2, site), F.array(hop), _n() % 3 == 0)
    return _events(spark, sf_dir).select("event_id", kind.alias("kind"))


@query("""WITH s AS (SELECT user_id, 'j' || user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_id FROM events)
          SELECT job_id, CAST(position AS INT) AS position, 'c' || event_id AS crawl_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'x' || event_id END AS fetched FROM s WHERE event_id % 13 = 0 OR event_id % 17 = 0""")
def crawl_mismatches(spark, sf_dir):
    """Documents that are not of the fetch at their place, or have none."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int").alias("position")
    rows = _events(spark, sf_dir).select(F.concat(F.lit("j"), "user_id").alias("job_id"), place, "event_id")
    fetches = rows.where("event_id % 13 <> 0").select("job_id", "position", F.concat(F.when(F.col("event_id") % 17 == 0, "x").otherwise("c"), "event_id").alias("crawl_id"))
    documents = rows.select("job_id", "position", F.concat(F.lit("c"), "event_id").alias("crawl_id"))
    return sources.join_mismatches(fetches, documents).withColumnRenamed("_fetch_crawl", "fetched")


@query("""WITH d AS (SELECT 'j' || (doc_id % 20) AS job_id, doc_id AS position, sum(length(text)) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS chars FROM documents)
          SELECT job_id, CAST(min(position) AS INT) AS position, CAST(max(chars) AS BIGINT) AS chars FROM d WHERE chars > 20000 GROUP BY job_id""")
def text_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("j"), F.col("doc_id") % 20).alias("job_id"), F.col("doc_id").cast("int").alias("position"), "text")
    return sources.over_budget(d, 20_000)


# -- jobs -----------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN e IS NOT NULL THEN 'FAILED' WHEN stop IN ('CANCELLED', 'FINALIZED', 'JOB_DEADLINE') THEN 'INTERRUPTED' WHEN stop = 'STAGE_TIMEOUT' THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
                 CASE WHEN e IS NOT NULL THEN e WHEN stop = 'JOB_DEADLINE' THEN 'JOB_DEADLINE_EXCEEDED' WHEN stop = 'STAGE_TIMEOUT' THEN 'CRAWL_STAGE_TIMEOUT' END AS code
          FROM (SELECT event_id, ['CANCELLED', 'FINALIZED', 'JOB_DEADLINE', 'STAGE_TIMEOUT', NULL][1 + event_id % 5] AS stop, CASE WHEN event_id % 7 = 0 THEN 'CRAWL_FAILED' END AS e FROM events)""")
def crawl_outcome(spark, sf_dir):
    stop = F.get(F.array(*(F.lit(x) for x in ("CANCELLED", "FINALIZED", "JOB_DEADLINE", "STAGE_TIMEOUT", None))), (_n() % 5).cast("int"))
    return _events(spark, sf_dir).select("event_id", jobs.crawl_outcome(stop, F.when(_n() % 7 == 0, "CRAWL_FAILED")).alias("o")).select("event_id", "o.status", "o.code")


@query("""SELECT event_id, CASE WHEN cancelled OR covered = 0 THEN CASE WHEN cancelled THEN 'CANCELLED' ELSE 'FAILED' END WHEN stop = 'JOB_DEADLINE_EXCEEDED' THEN 'PARTIAL' END AS status,
                 CASE WHEN cancelled OR covered = 0 THEN NULL WHEN stop IS NOT NULL THEN stop WHEN errors > 0 THEN 'PROVIDER_FAILURES' END AS warning,
                 coalesce(stop = 'SEARCH_STAGE_TIMEOUT', FALSE) OR covered < 3 AS degraded
          FROM (SELECT event_id, event_id % 7 = 0 AS cancelled, CASE event_id % 5 WHEN 0 THEN 'JOB_DEADLINE_EXCEEDED' WHEN 1 THEN 'SEARCH_STAGE_TIMEOUT' END AS stop, event_id % 4 AS covered, event_id % 3 AS errors FROM events)""")
def after_search(spark, sf_dir):
    stop = F.when(_n() % 5 == 0, "JOB_DEADLINE_EXCEEDED").when(_n() % 5 == 1, "SEARCH_STAGE_TIMEOUT")
    return _events(spark, sf_dir).select("event_id", jobs.after_search(_n() % 7 == 0, stop, _n() % 4, F.lit(3), _n() % 3).alias("a")).select("event_id", "a.*")


@query("""SELECT event_id, CASE WHEN stored = 'FAILED' THEN stored WHEN cancelled THEN 'CANCELLED' WHEN e IS NOT NULL THEN 'FAILED' WHEN stop = 'JOB_DEADLINE' THEN CASE WHEN usable > 0 THEN 'PARTIAL' ELSE 'FAILED' END END AS status,
                 CASE WHEN stored <> 'FAILED' AND NOT cancelled THEN CASE WHEN e IS NOT NULL THEN e WHEN stop = 'JOB_DEADLINE' AND usable = 0 THEN 'JOB_DEADLINE_EXCEEDED' END END AS error,
                 coalesce(stop = 'STAGE_TIMEOUT', FALSE) AS degraded
          FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'FAILED' ELSE 'CRAWLING' END AS stored, event_id % 7 = 0 AS cancelled, CASE WHEN event_id % 5 = 0 THEN 'CRAWL_FAILED' END AS e,
                       CASE event_id % 3 WHEN 0 THEN 'JOB_DEADLINE' WHEN 1 THEN 'STAGE_TIMEOUT' END AS stop, event_id % 2 AS usable FROM events)""")
def after_crawl(spark, sf_dir):
    stop = F.when(_n() % 3 == 0, "JOB_DEADLINE").when(_n() % 3 == 1, "STAGE_TIMEOUT")
    stored = F.when(_n() % 11 == 0, "FAILED").otherwise("CRAWLING")
    found = jobs.after_crawl(stored, _n() % 7 == 0, F.when(_n() % 5 == 0, "CRAWL_FAILED"), stop, _n() % 2)
    return _events(spark, sf_dir).select("event_id", found.alias("a")).select("event_id", "a.status", "a.error", "a.degraded")


_STAGES_SQL = "['PLANNING', 'SEARCHING', 'CRAWLING', 'NORMALIZING']"


@query(f"""WITH e AS (SELECT event_id, CAST(1 + event_id % 4 AS INT) AS i FROM events)
           SELECT event_id, array_to_string(list_transform({_STAGES_SQL}[i + 1:], lambda s: s || '=NOT_RUN'), ',') AS skipped, {_STAGES_SQL}[i] AS stage, CAST(i - 1 AS INT) AS stage_index, 4 AS total_stages FROM e""")
def stage_walk(spark, sf_dir):
    """What an early end leaves out, and how far a job is."""
    reached = F.get(F.array(*(F.lit(s) for s in PIPELINE_STAGES)), (_n() % 4).cast("int"))
    left = F.transform(jobs.stage_outcomes(PIPELINE_STAGES, reached), lambda s: F.concat_ws("=", s["stage"], s["status"]))
    at = jobs.progress(reached, PIPELINE_STAGES, F.array(F.lit("COVERED")))
    return _events(spark, sf_dir).select("event_id", F.array_join(left, ",").alias("skipped"), at["stage"].alias("stage"), at["stage_index"].alias("stage_index"), at["total_stages"].alias("total_stages"))


@query(f"""WITH {_ATTEMPTS_SQL}, d AS (SELECT request_id AS job_id, query, bool_or(status IN ('OK', 'EMPTY')) AS ok FROM attempts GROUP BY 1, 2)
           SELECT job_id, CAST(count(*) AS INT) AS queries_total, CAST(count(*) AS INT) AS queries_done, CAST(count(*) FILTER (NOT ok) AS INT) AS queries_failed FROM d GROUP BY job_id""")
def search_progress(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    done = search.query_outcomes(a.select(F.col("request_id").alias("job_id"), "query").distinct(), a).groupBy("job_id").agg(F.collect_list("status").alias("s"))
    p = jobs.progress(F.lit("SEARCHING"), PIPELINE_STAGES, F.col("s"))
    return done.select("job_id", p.alias("p")).select("job_id", "p.queries_total", "p.queries_done", "p.queries_failed")


_CODES = ("SEARCH_STAGE_TIMEOUT", "CANCELLED", "FETCH_FAILURES", "EXTRACTION_DEGRADED", "NO_DOCUMENTS", "DEDUP_FAILED", "PROVIDER_FAILURES")
_CATEGORIES = ("TIMEOUT", "CANCELLED", "FETCH_ERROR", "EXTRACTION_ERROR", "FETCH_ERROR", "INTERNAL_ERROR", "PROVIDER_ERROR")


@query(f"""WITH e AS (SELECT event_id, {list(_CODES)}[1 + event_id % 8] AS code, {list(_CATEGORIES)}[1 + event_id % 8] AS category FROM events)
           SELECT event_id, code, CASE WHEN code IS NOT NULL THEN category END AS category, CASE WHEN code IS NULL THEN NULL WHEN event_id % 2 = 0 THEN 'p/X/TIMEOUT' ELSE '' END AS provider_errors FROM e""")
def error_views(spark, sf_dir):
    """Errors as they are shown; what providers said only where results are."""
    code = F.get(F.array(*(F.lit(c) for c in _CODES), F.lit(None).cast("string")), (_n() % 8).cast("int"))
    said = F.when(_n() % 2 == 0, F.array(F.struct(F.lit("p").alias("provider"), F.lit("X").alias("code"), F.lit("TIMEOUT").alias("category"), F.lit("hidden").alias("message"))))
    v = views.error_view(code, F.lit("SEARCHING"), F.lit("m"), said)
    return _events(spark, sf_dir).select("event_id", v["code"].alias("code"), v["category"].alias("category"), F.array_join(F.transform(v["provider_errors"], lambda e: F.concat_ws("/", e["provider"], e["code"], e["category"])), ",").alias("provider_errors"))


@query("""WITH v AS (SELECT 'j' || user_id AS job_id, event_id, ['QUEUED', 'PLANNING', 'SEARCHING', 'COMPLETED', 'FAILED'][1 + event_id % 5] AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
          SELECT job_id, status, CASE WHEN status IN ('PLANNING', 'SEARCHING') THEN status END AS stage, CASE WHEN status IN ('COMPLETED', 'FAILED') AND event_id % 2 = 0 THEN 'COMPLETE:' || (event_id % 9) END AS summary,
                 CASE WHEN status = 'FAILED' THEN 'NO_DOCUMENTS/FETCH_ERROR/CRAWLING' END AS error, CASE WHEN event_id % 3 = 0 THEN 'CANCELLED' ELSE '' END AS warnings FROM v""")
def job_views(spark, sf_dir):
    """The newest version of each job as a caller sees it."""
    status = F.get(F.array(*(F.lit(s) for s in ("QUEUED", "PLANNING", "SEARCHING", "COMPLETED", "FAILED"))), (_n() % 5).cast("int"))
    stored = _events(spark, sf_dir).select(
        F.concat(F.lit("j"), "user_id").alias("id"), _n().alias("version"), F.lit("q").alias("query"), status.alias("status"), F.array(*(F.lit(s) for s in PIPELINE_STAGES)).alias("stages"),
        F.lit(False).alias("cancel_requested"), *(F.col("ts").alias(c) for c in ("created_at", "started_at", "completed_at", "deadline_at")), F.when(_n() % 2 == 0, "COMPLETE").alias("coverage"), (_n() % 9).alias("results"),
        F.when(status == "FAILED", "NO_DOCUMENTS").alias("error_code"), F.lit("CRAWLING").alias("error_step"), F.when(_n() % 3 == 0, F.array(F.lit("CANCELLED"))).otherwise(F.array().cast("array<string>")).alias("warning_codes"),
    )
    e, r = F.col("error"), F.col("result_summary")
    return views.job_views(views.latest(stored)).select(
        "job_id", "status", "stage", F.when(r.isNotNull(), F.concat_ws(":", r["coverage"], r["results"].cast("string"))).alias("summary"),
        F.when(e.isNotNull(), F.concat_ws("/", e["code"], e["category"], e["step"])).alias("error"), F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"),
    )


@query(f"""WITH {_HITS_SQL}, g AS (SELECT request_id, url, min((q, p, rank, idx)) AS first, arg_min(title, (q, p, rank, idx)) AS title, count(*) AS n FROM ordered GROUP BY 1, 2),
           i AS (SELECT request_id, string_agg('"url":"' || url || '","title":"' || title || '"', ';' ORDER BY first) AS results FROM g GROUP BY 1)
           SELECT request_id, results FROM i""")
def results_views(spark, sf_dir):
    """One JSON document for each request, here of its items' addresses and titles."""
    hits, attempts = _hits(spark, sf_dir), _attempts(spark, sf_dir)
    queries, dims = _dims(spark, hits)
    items = views.result_items(search.merge(hits, queries, dims))
    outcomes = search.query_outcomes(queries.select(F.col("request_id").alias("job_id"), F.col("name").alias("query"), "ord"), None)
    outcomes = outcomes.select(F.col("job_id").alias("request_id"), F.col("ord").alias("index"), "status")
    found = views.results_view(items, search.provider_status(attempts, dims), outcomes)
    return found.select("request_id", F.array_join(F.regexp_extract_all("body", F.lit(r'("url":"[^"]*","title":"[^"]*")'), F.lit(1)), ";").alias("results"))


@query("""SELECT event_id, '{"data":' || CASE WHEN event_id % 2 = 0 THEN '{"status":"OK"}' ELSE 'null' END || ',"error":' || CASE WHEN event_id % 2 = 1 THEN '{"code":"NOT_FOUND"}' ELSE 'null' END || ',"meta":{"request_id":"r' || event_id || '"}}' AS body FROM events""")
def envelopes(spark, sf_dir):
    data = F.when(_n() % 2 == 0, F.struct(F.lit("OK").alias("status")))
    error = F.when(_n() % 2 == 1, F.struct(F.lit("NOT_FOUND").alias("code")))
    return _events(spark, sf_dir).select("event_id", views.envelope(data, F.concat(F.lit("r"), _n()), error).alias("body"))


@query("""WITH f AS (SELECT 'j' || (user_id % 300) AS job_id, event_id, CASE event_id % 5 WHEN 0 THEN 'SIGNAL' WHEN 1 THEN 'CANCELLED' ELSE 'FAILURE' END AS kind FROM events)
          SELECT job_id, arg_min(kind, (kind <> 'SIGNAL', event_id)) AS kind, arg_min('e' || event_id, (kind <> 'SIGNAL', event_id)) AS code FROM f WHERE kind <> 'CANCELLED' GROUP BY job_id""")
def first_failures(spark, sf_dir):
    kind = F.when(_n() % 5 == 0, "SIGNAL").when(_n() % 5 == 1, "CANCELLED").otherwise("FAILURE")
    rows = _events(spark, sf_dir).select(F.concat(F.lit("j"), F.col("user_id") % 300).alias("job_id"), _n().alias("seq"), kind.alias("kind"), F.concat(F.lit("e"), _n()).alias("code"))
    return views.first_failure(rows)


@query("""SELECT event_id, NOT (event_id % 5 IN (0, 1, 2)) AS request, event_id % 4 <> 0 AS plan, event_id % 3 <> 0 AS stages FROM events""")
def validity(spark, sf_dir):
    """Requests, plans and stage lists, sound and broken."""
    k = _n() % 5
    text = F.when(k == 0, "ab").when(k == 1, "a\x00bc").otherwise("a  good\tquery")
    language = F.when(k == 2, "english").when(k == 3, "en")
    plan = F.when(_n() % 4 == 0, F.array(F.lit("a"), F.lit(" a "))).otherwise(F.array(F.lit("a"), F.lit("b")))
    stages = F.when(_n() % 3 == 0, F.array(F.lit("SEARCHING"), F.lit("PLANNING"))).otherwise(F.array(F.lit("PLANNING"), F.lit("CRAWLING")))
    return _events(spark, sf_dir).select("event_id", jobs.valid_request(text, language, F.lit("DE")).alias("request"), jobs.valid_plan(plan).alias("plan"), jobs.valid_stages(stages).alias("stages"))


@query("""WITH e AS (SELECT 'j' || user_id AS job_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT job_id, event_id, seq FROM e""")
def event_numbers(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.concat(F.lit("j"), "user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), _n().alias("arrival"))
    return jobs.number_events(rows).select("job_id", "event_id", "seq")


@query("""WITH a AS (SELECT 'p' || user_id AS pool, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
          SELECT pool, 'j' || (i % 2) AS job_id, CAST(i AS INT) AS position, CAST(CASE WHEN i % 2 = 0 THEN i // 2 * 2 ELSE i // 2 * 2 + 1 END AS DOUBLE) AS at, CAST(i % 2 AS DOUBLE) AS waited, 1 AS in_flight FROM a""")
def admission_replay(spark, sf_dir):
    """Two jobs ask at the same time for the one slot: they take turns, a second each."""
    from pyspark.sql import Window

    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i")
    asked = _events(spark, sf_dir).select(F.concat(F.lit("p"), "user_id").alias("pool"), i)
    begin = (F.floor(F.col("i") / 2) * 2).cast("double")
    row = [F.col("pool"), F.concat(F.lit("j"), F.col("i") % 2).alias("job_id"), F.col("i").cast("int").alias("position"), F.lit("h").alias("host")]
    ask = asked.select(*row, begin.alias("at"), (F.col("i") * 2 + 1000000).cast("long").alias("seq"), F.lit("ask").alias("kind"))
    free = asked.select(*row, (begin + F.col("i") % 2 + 1).alias("at"), F.col("i").cast("long").alias("seq"), F.lit("release").alias("kind"))
    return admission.replay(ask.unionByName(free), 1, 1, 1).select("pool", "job_id", "position", "at", "waited", "in_flight")
