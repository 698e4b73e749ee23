"""Control plane, streams, fetcher and logging."""

import http.client
import http.server
import json
import logging
import threading
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell.api import Api
from siftwell.config import Settings
from siftwell.engine import Engine, EngineError, Job, JobStore, fixed_plan
from siftwell.functions import policy, sql
from siftwell.operators import jobs, search, views
from siftwell.operators.admission import Admission, Budget, Gate
from siftwell.schemas import PIPELINE_STAGES, SEARCH_STAGES
from siftwell.sources import crawler, logs, providers
from siftwell.streaming import events


def test_store_transitions_and_versions():
    store = JobStore()
    job, new = store.create(Job("a", "query", None, None, SEARCH_STAGES), "k")
    assert new and store.create(Job("b", "query", None, None, SEARCH_STAGES), "k") == (job, False)
    with pytest.raises(EngineError, match="key was used"):
        store.create(Job("c", "other", None, None, SEARCH_STAGES), "k")
    running = store.claim("a", "w")
    with pytest.raises(EngineError, match="not queued"):
        store.claim("a", "w")
    with pytest.raises(EngineError, match="changed meanwhile"):
        store.save(job, status="SEARCHING")
    with pytest.raises(EngineError, match="to COMPLETED"):
        store.save(running, status="COMPLETED")
    assert store.request_cancel("a").cancel_requested
    assert [e[1] for e in store.events] == [1, 2, 3]


def test_engine_runs_and_cancels(spark):
    hit = spark.createDataFrame([("r", 0, "t", "https://e.com/", "https://e.com/", "q", "p", 1)], "request_id string, idx int, title string, url string, original_url string, query string, source string, rank int")
    dim = spark.createDataFrame([("r", "q", 0)], "request_id string, name string, ord int")
    engine = Engine(spark)
    job = engine.submit(" a  query ")
    assert job.query == "a query" and engine.health() == {"queued": 1, "running": 0}
    with pytest.raises(EngineError, match="not finished"):
        engine.get_results(job.id)
    assert engine.run(job.id, hit, dim, dim.withColumnRenamed("x", "y")).status == "COMPLETED"
    assert engine.get_results(job.id)["results"].count() == 1
    assert engine.cancel(job.id) == 409
    assert engine.cancel(engine.submit("another").id) == 200
    with pytest.raises(EngineError):
        engine.submit("x")


def inputs(spark, urls=("https://e.com/", "https://f.com/"), statuses=("OK", "FAILED")):
    hit = "request_id string, idx int, title string, url string, original_url string, query string, source string, rank int"
    hits = spark.createDataFrame([("r", i, "t", u, u, "q", "p", i + 1) for i, u in enumerate(urls)], hit)
    dim = spark.createDataFrame([("r", "q", 0)], "request_id string, name string, ord int")
    error = "struct<provider:string,code:string,category:string,retryable:boolean>"
    rows = [("r", i, "p", "q", s, 1, 5, ("p", "X", "TIMEOUT", True) if s == "FAILED" else None) for i, s in enumerate(statuses)]
    attempts = spark.createDataFrame(rows, f"request_id string, idx int, provider string, query string, status string, result_count int, duration_ms int, error {error}")
    page = "<html><head><title>T</title></head><body><article><p>" + "word " * 100 + "</p></article></body></html>"
    fetched = [("r", i, f"c{i}", u, u, "OK", 200, "text/html", "utf-8", page, "0" * 64) for i, u in enumerate(urls)]
    fetches = spark.createDataFrame(fetched, "job_id string, position int, crawl_id string, requested_url string, final_url string, status string, http_status int, content_type string, charset string, content string, content_sha256 string")
    return {"hits": hits, "queries": dim, "providers": dim, "attempts": attempts, "fetches": fetches}


def test_engine_ends_jobs_by_the_decision_tables(spark):
    engine = Engine(spark)
    given = inputs(spark)
    warned = engine.run(engine.submit("abc").id, **given)
    assert (warned.status, warned.warnings, warned.coverage) == ("COMPLETED", ("PROVIDER_FAILURES",), "COMPLETE")
    empty = given | {"hits": given["hits"].where("false"), "attempts": None}
    assert engine.run(engine.submit("abc").id, **empty).status == "COMPLETED"
    failed = engine.run(engine.submit("abc").id, **inputs(spark, statuses=("FAILED",)))
    assert (failed.status, failed.error, failed.error_step) == ("FAILED", "ALL_SEARCH_PROVIDERS_FAILED", "SEARCHING")
    broken = engine.run(engine.submit("abc").id, **given | {"hits": given["hits"].drop("url")})
    assert (broken.status, broken.error) == ("FAILED", "INTERNAL_ERROR")
    unplanned = Engine(spark, planner=lambda job: 1 / 0)
    assert unplanned.run(unplanned.submit("abc").id, **given).error == "INTERNAL_ERROR"


def test_engine_runs_the_whole_pipeline(spark):
    engine = Engine(spark, pipeline=True)
    given = inputs(spark)
    job = engine.run(engine.submit("abc").id, **given)
    assert (job.status, job.warnings) == ("COMPLETED", ("PROVIDER_FAILURES",))
    assert [s for s, *_ in job.stage_outcomes] == ["CRAWLING", "NORMALIZING"] and dict(job.counts)["documents"] == 2 and dict(job.counts)["groups"] == 2
    none = given | {"fetches": given["fetches"].withColumn("status", F.lit("HTTP_ERROR")).withColumn("content", F.lit(None).cast("string"))}
    job = engine.run(engine.submit("abc").id, **none)
    assert (job.status, job.error, set(job.warnings)) == ("FAILED", "NO_DOCUMENTS", {"PROVIDER_FAILURES", "FETCH_FAILURES"})
    job = Engine(spark, pipeline=True, group=lambda d: 1 / 0)
    job = job.run(job.submit("abc").id, **given)
    assert (job.status, job.error) == ("FAILED", "DEDUP_FAILED")
    small = Engine(spark, pipeline=True, settings=Settings(max_urls=1, max_text_chars=300, max_total_text_chars=300))
    assert small.run(small.submit("abc").id, **given).error == "PIPELINE_BUDGET_EXCEEDED"


def test_engine_deadlines_conflicts_and_interrupts(spark):
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    given = inputs(spark)

    def late(job):
        now[0] += timedelta(seconds=1000)
        return fixed_plan(job)

    engine = Engine(spark, JobStore(clock=lambda: now[0]), pipeline=True, planner=late)
    job = engine.run(engine.submit("abc").id, **given)
    assert (job.status, job.error) == ("FAILED", "JOB_DEADLINE_EXCEEDED")

    class Slow(JobStore):
        def save(self, job, event="saved", **changes):
            if changes.get("status") == "CRAWLING":
                now[0] += timedelta(seconds=1000)
            return super().save(job, event, **changes)

    engine = Engine(spark, Slow(clock=lambda: now[0]), pipeline=True)
    job = engine.run(engine.submit("abc").id, **given)
    assert (job.status, job.error) == ("FAILED", "JOB_DEADLINE_EXCEEDED")

    class Busy(JobStore):
        conflicts = 2

        def save(self, job, event="saved", **changes):
            if event == "plan_created" and self.conflicts:
                self.conflicts -= 1
                super().save(self.get(job.id), "other")
            return super().save(job, event, **changes)

    engine = Engine(spark, Busy())
    assert engine.run(engine.submit("abc").id, **given).status == "COMPLETED"

    class Cancels(JobStore):
        def save(self, job, event="saved", **changes):
            if event == "completed":
                self.request_cancel(job.id)
            return super().save(job, event, **changes)

    engine = Engine(spark, Cancels())
    assert engine.run(engine.submit("abc").id, **given).status == "CANCELLED"

    def interrupt(job):
        raise KeyboardInterrupt

    engine = Engine(spark, planner=interrupt)
    job = engine.submit("abc")
    with pytest.raises(KeyboardInterrupt):
        engine.run(job.id, **given)
    assert (engine.get(job.id).status, engine.get(job.id).error) == ("FAILED", "RUNNER_INTERRUPTED")


def test_store_versions_are_rows(spark):
    store = JobStore()
    engine = Engine(spark, store)
    job = engine.run(engine.submit("abc").id, **inputs(spark))
    table = store.version_table(spark)
    assert jobs.version_gaps(table).count() == 0 and jobs.version_gaps(table.where("version <> 2")).count() == 1
    other = JobStore()
    other.restore(table)
    assert other.get(job.id).status == "COMPLETED" and other.get(job.id).version == job.version
    (view,) = views.job_views(views.latest(table)).collect()
    assert (view.job_id, view.stage, view.result_summary.results, [w.code for w in view.warnings]) == (job.id, None, 2, ["PROVIDER_FAILURES"])
    assert [e[1] for e in store.events] == list(range(1, len(store.events) + 1))


def test_api(spark):
    engine = Engine(spark, pipeline=True)
    given = inputs(spark)
    server = Api(engine, lambda job: given).serve(0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, **head):
        c = http.client.HTTPConnection("127.0.0.1", server.server_port)
        c.request(method, path, body if isinstance(body, (bytes, type(None))) else json.dumps(body), {k.replace("_", "-"): v for k, v in head.items()})
        r = c.getresponse()
        return r.status, json.loads(r.read()), r.headers

    status, made, _ = call("POST", "/research", {"query": " a  b c "}, Idempotency_Key="k", X_Request_Id="me")
    assert status == 202 and made["meta"] == {"request_id": "me", "idempotent_replay": False}
    path = f"/research/{made['data']['job_id']}"
    assert call("POST", "/research", {"query": "a b c"}, Idempotency_Key="k")[0] == 200
    assert call("POST", "/research", {"query": "other"}, Idempotency_Key="k")[1]["error"]["reason"] == "IDEMPOTENCY_KEY_REUSED"
    engine.started[made["data"]["job_id"]].result(120)
    job = call("GET", path)[1]["data"]
    assert (job["status"], job["query"], job["progress"]["documents"]) == ("COMPLETED", "a b c", 2)
    results = call("GET", f"{path}/results")[1]["data"]
    assert [s["state"] for s in results["sources"]] == ["EXTRACTED"] * 2 and "content" not in results["sources"][0]
    assert call("POST", f"{path}/cancel")[1]["error"]["reason"] == "JOB_ALREADY_FINISHED"
    assert call("GET", "/research/" + "0" * 32)[0] == 404 and call("GET", "/none")[0] == 404 and call("POST", path)[0] == 405
    assert call("POST", "/research", b"{")[0] == 422 and call("POST", "/research", b"x" * 20_000)[0] == 413
    wrong = call("POST", "/research", {"query": 5, "language": "secret-value", "x": 1})[1]["error"]["details"]["errors"]
    assert {tuple(e["loc"]) for e in wrong} == {("body", "query"), ("body", "language"), ("body", "x")} and "secret-value" not in str(wrong)
    assert call("GET", "/health")[1]["data"]["jobs"] == {"queued": 0, "running": 0}
    server.shutdown()
    engine.shutdown()


def test_settings():
    with pytest.raises(ValueError, match="text budget"):
        Settings(max_urls=31)
    s = Settings(secrets={"google_api_key": "hidden", "x": None})
    assert (s.per_job, s.bodies) == (3, 11) and "hidden" not in str(s.summary()) + repr(s)
    assert {c["name"]: c["status"] for c in s.summary()["credentials"]} == {"GOOGLE_API_KEY": "CONFIGURED", "X": "MISSING"}


def test_gate_and_budget():
    gate = Gate(Admission(1, 1, 1))
    first = gate.acquire("a", 0, "h")
    assert gate.acquire("b", 0, "h", deadline=gate.clock() + 0.05) is None
    waiting = []
    thread = threading.Thread(target=lambda: waiting.append(gate.acquire("b", 1, "h")))
    thread.start()
    gate.release(first)
    gate.release(first)
    thread.join(5)
    assert waiting[0].position == 1 and gate.state.most["all", None] == 1
    budget = Budget(1)
    assert budget.acquire() and not budget.acquire(deadline=budget.clock() + 0.05)
    budget.release()
    assert budget.acquire() and (budget.held, budget.most) == (1, 1)
    with pytest.raises(ValueError):
        Admission(0, 1, 1)


def run_stream(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def written(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_breaker_agrees_with_batch(spark, tmp_path):
    rows = [(p, i, s) for p in ("x", "y") for i, s in enumerate(["FAILED"] * 3 + ["SKIPPED_CIRCUIT_OPEN", "EMPTY", "FAILED", "OK"])]
    stream = written(spark, rows, "provider string, idx long, status string", tmp_path / "in")
    batch = search.breaker(spark.createDataFrame([("r", *r) for r in rows], "request_id string, provider string, idx long, status string"), 3)
    got = {(r.provider, r.idx): r.open_before for r in run_stream(spark, events.breaker(stream, 3), "breaks")}
    assert got == {(r.provider, r.idx): r.open_before for r in batch.collect()}


def test_stream_windows_and_first_documents(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=20 * i), "p", "FAILED" if i % 2 else "OK", f"h{i % 3}") for i in range(9)] + [(start + timedelta(days=9), "p", "OK", "h9")]
    schema = "at timestamp, provider string, status string, text_sha256 string"
    windows = run_stream(spark, events.attempt_windows(written(spark, rows, schema, tmp_path / "in")), "windows")
    assert sorted((r.attempts, r.failed) for r in windows) == [(3, 1), (3, 1), (3, 2)]
    firsts = run_stream(spark, events.first_documents(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "firsts")
    assert {r.text_sha256 for r in firsts} == {"h0", "h1", "h2", "h9"} and len(firsts) == 4


def test_stream_of_robots_entries(spark, tmp_path):
    t = datetime(2024, 1, 1)
    steps = [(0, "page", None), (1, "entry", "PARSED"), (2, "page", None), (11, "page", None), (12, "entry", "UNREACHABLE_DISALLOW"), (13, "page", None)]
    rows = [("o", t + timedelta(seconds=s), i, kind, outcome) for i, (s, kind, outcome) in enumerate(steps)]
    stream = written(spark, rows, "origin string, at timestamp, seq long, kind string, outcome string", tmp_path / "in")
    got = {r.seq: r.outcome for r in run_stream(spark, events.robots_ttl(stream, 10), "entries")}
    assert got == {0: None, 2: "PARSED", 3: None, 5: None}


def test_stream_of_missed_sources(spark, tmp_path):
    t, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)
    schema = "job_id string, position int, at timestamp, kind string, deadline timestamp"
    rows = [("j", p, t, "selected", end) for p in range(3)] + [("j", p, t + timedelta(seconds=1), "started", end) for p in range(2)] + [("j", 0, t + timedelta(seconds=2), "captured", end)]
    written(spark, rows, schema, tmp_path / "in")
    time.sleep(1.1)
    stream = written(spark, [("k", 0, t + timedelta(hours=1), "selected", t + timedelta(hours=9))], schema, tmp_path / "in")
    got = {(r.job_id, r.position): r.state for r in run_stream(spark, events.missed_sources(stream), "missed")}
    assert got == {("j", 1): "INTERRUPTED", ("j", 2): "NOT_RUN"}


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select normalize_url('HTTP://E.com') as u, clean_inline(' a  b ') as c, check_url('http://10.0.0.1/').reason as r, is_blocked_address('8.8.8.8') as b").first()
    assert tuple(row) == ("http://e.com/", "a b", "address not allowed", False)
    found = spark.sql("select * from extract_links('<body><a href=\"/x\">X</a><a href=\"#y\">Y</a></body>', 'https://e.com/')").collect()
    assert [(r.ord, r.url, r.text) for r in found] == [(0, "https://e.com/x", "X")]


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [("j", 1, "QUEUED"), ("j", 2, "PLANNING"), ("j", 3, "CRAWLING"), ("k", 1, "PLANNING")]
    spark.createDataFrame(rows, "job_id string, seq int, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, seq int, state string").parquet(str(tmp_path / "in"))
    run = events.illegal_transitions(stream, PIPELINE_STAGES).writeStream.format("memory").queryName("bad").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.job_id, r.seq) for r in spark.table("bad").collect()} == {("j", 3), ("k", 1)}


def test_capture_replaces_a_repeated_batch(spark, tmp_path):
    spark.createDataFrame([("j", 0, "x"), ("j", 1, "y")], "job_id string, position int, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, position int, state string").parquet(str(tmp_path / "in"))
    for n in (1, 2):
        events.capture(stream, str(tmp_path / "out"), str(tmp_path / f"ck{n}")).trigger(availableNow=True).start().awaitTermination(120)
    got = events.captured(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert len(got) == 2


class _Pages(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        body, code, head = b"", 200, {"Content-Type": "text/html; charset=latin-1"}
        if self.path == "/robots.txt":
            body = b"User-agent: *\nDisallow: /private"
        elif self.path == "/go":
            code, head = 302, {"Location": "/page?b=2&a=1&utm_source=x"}
        elif self.path == "/loop":
            code, head = 302, {"Location": "/loop"}
        elif self.path.startswith("/far"):
            code, head = 302, {"Location": f"/far{len(self.path)}{'x' * len(self.path)}"}
        elif self.path == "/out":
            code, head = 302, {"Location": "ftp://elsewhere/"}
        elif self.path == "/png":
            head = {"Content-Type": "image/png"}
        elif self.path == "/missing":
            code = 404
        elif self.path == "/busy":
            code, head = 503, {"Retry-After": "0"}
        elif self.path == "/drip":
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            for _ in range(100):
                self.wfile.write(b"x")
                self.wfile.flush()
                time.sleep(0.05)
            return
        else:
            body = b"<title> A &amp;  B </title><p>h\xe9"
        self.send_response(code)
        for k, v in head.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def loopback():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def send(url, timeout_s, most):
        return crawler.request(url, timeout_s, most, blocked=lambda a: False)

    def check(url):
        return policy.check_url(url) if url.startswith("ftp:") else ("localhost", None, False)

    return server, f"http://localhost:{server.server_port}", lambda **more: crawler.Fetcher(**{"spacing_s": 0, "check": check, "send": send, **more})


def test_fetcher_follows_targets_as_given_and_ends_in_time():
    server, base, make = loopback()
    _Pages.asked.clear()
    got = {p: crawler.assemble(base + p, make().fetch(base + p)) for p in ("/page", "/go", "/loop", "/far", "/out", "/busy")}
    assert {p: r["status"] for p, r in got.items()} == {"/page": "OK", "/go": "OK", "/loop": "REDIRECT_LOOP", "/far": "REDIRECT_LIMIT", "/out": "POLICY_BLOCKED", "/busy": "RETRY_EXHAUSTED"}
    assert "/page?b=2&a=1&utm_source=x" in _Pages.asked and got["/go"]["final_url"].endswith("/page?b=2&a=1&utm_source=x")
    page = got["/page"]
    assert (page["title"], page["charset"], page["content"][-1], page["attempts"]) == ("A & B", "iso8859-1", "é", 1)
    assert page["robots"] == {"robots_url": f"{base}/robots.txt", "outcome": "ALLOWED", "allowed": True}
    assert len(got["/far"]["redirect_chain"]) == 6 and got["/go"]["redirect_chain"][0]["location"].startswith("/page?")
    assert (got["/busy"]["attempts"], got["/busy"]["error"]["cause"], got["/busy"]["error"]["category"]) == (2, "HTTP_ERROR", "NETWORK_ERROR")
    started = time.monotonic()
    assert make(timeout_s=0.6).fetch(base + "/drip")["status"] == "FETCH_TIMEOUT" and time.monotonic() - started < 3
    assert make().fetch(base + "/page", deadline=0.0)["status"] == "FETCH_TIMEOUT"
    assert make(spacing_s=9, timeout_s=0.5).fetch(base + "/page")["status"] == "FETCH_TIMEOUT"
    server.shutdown()


def test_connect_timeouts_are_retried(monkeypatch):
    def slow(address, timeout):
        raise TimeoutError

    monkeypatch.setattr(crawler.socket, "create_connection", slow)
    assert crawler.request("http://e.com/", 5, 100, blocked=lambda a: False, lookup=lambda h, p: ["8.8.8.8"])["status"] == "CONNECT_TIMEOUT"
    fetcher = crawler.Fetcher(spacing_s=0, check=lambda u: ("e.com", None, False), send=lambda u, t, m: {"status": "CONNECT_TIMEOUT", "message": "x"}, sleep=lambda s: None)
    fetcher.robots["http://e.com"] = ("UNAVAILABLE_ALLOW", None, 1e18)
    got = fetcher.fetch("http://e.com/")
    assert (got["status"], got["cause"], got["attempts"]) == ("RETRY_EXHAUSTED", "CONNECT_TIMEOUT", 2)


def test_fetch_rows(spark):
    def make():
        return crawler.Fetcher(send=lambda u, t, m: {"status": "DNS_ERROR", "message": "none"}, sleep=lambda s: None)

    targets = spark.createDataFrame([("j", 0, ("http://a.example/", "http://a.example/")), ("j", 1, ("http://10.0.0.1/", "http://10.0.0.1/"))], "job_id string, position int, result struct<url:string,original_url:string>")
    run = crawler.collect_sources(targets.withColumns({"providers": F.array(F.lit("p")), "queries": F.array(F.lit("q"))}), make)
    assert {r.position: r.status for r in run["fetches"].collect()} == {0: "DNS_ERROR", 1: "SSRF_BLOCKED"}
    assert {r.state for r in run["records"].collect()} == {"EXTRACTED"} and run["mismatches"].count() == 0
    assert set(views.fetch_records(run["fetches"]).columns) & {"content", "title"} == set()


def test_provider_calls_are_retried_and_bounded():
    answers = iter([(503, None, None), (200, '{"results": [{}]}', None)])
    got = providers.call_with_retry(lambda: next(answers), sleep=lambda s: None)
    assert (got["status"], got["tries"], got["result_count"]) == ("OK", 2, 1)
    got = providers.call_with_retry(lambda: (429, None, None), retries=2, sleep=lambda s: None)
    assert (got["status"], got["tries"], got["error"]) == ("FAILED", 3, ("PROVIDER_RATE_LIMITED", "RATE_LIMITED", True))
    assert providers.call_with_retry(lambda: (401, None, None), sleep=lambda s: None)["tries"] == 1
    assert providers.call_with_retry(lambda: (200, "{}", None))["status"] == "EMPTY"
    slow = providers.call_with_retry(lambda: time.sleep(1) or (200, "{}", None), retries=0, timeout_s=0.05)
    assert slow["error"] == ("PROVIDER_TIMEOUT", "TIMEOUT", True)


class _Search(http.server.BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        self.rfile.read(int(self.headers["Content-Length"]))
        body = b'{"id": "i", "results": [{"title": "T", "url": "https://E.com/x", "snippet": "s"}]}'
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_search_source_gives_attempts_and_hits(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(providers.SearchSource)
    options = {"queries": '["a", "b"]', "providers": "perplexity", "perplexity_api_key": "x", "request_id": "r", "perplexity_endpoint": f"http://127.0.0.1:{server.server_port}/search"}
    answers = spark.read.format("siftwell_search").options(**options).load()
    attempts = providers.attempts_of(answers).collect()
    server_hits = providers.answers_to_hits(answers).collect()
    server.shutdown()
    assert [(r.idx, r.query, r.status, r.result_count) for r in sorted(attempts)] == [(0, "a", "OK", 1), (1, "b", "OK", 1)]
    assert {(r.query, r.url) for r in server_hits} == {("a", "https://e.com/x"), ("b", "https://e.com/x")}


def test_fetcher_over_loopback():
    server, base, make = loopback()
    fetcher = make()
    got = {p: fetcher.fetch(base + p) for p in ("/page", "/go", "/loop", "/png", "/missing", "/private/x")}
    server.shutdown()
    assert {p: r["status"] for p, r in got.items()} == {
        "/page": "OK", "/go": "OK", "/loop": "REDIRECT_LOOP", "/png": "UNSUPPORTED_CONTENT_TYPE", "/missing": "HTTP_ERROR", "/private/x": "ROBOTS_BLOCKED",
    }
    assert got["/go"]["final_url"].startswith(base + "/page?") and got["/page"]["body"].endswith(b"<p>h\xe9")
    assert crawler.request(base + "/page", 5, 100)["status"] == "SSRF_BLOCKED"
    assert crawler.Fetcher().fetch("http://10.0.0.1/")["status"] == "SSRF_BLOCKED"


def test_logs_hide_secrets():
    record = logging.LogRecord("x", logging.INFO, "", 0, "got https://e.com/?api_key=abc", None, None)
    record.fields = {"token": "t", "n": {"cookie": "c", "u": "Bearer abc"}}
    line = logs.JsonLines().format(record)
    assert "abc" not in line and '"t"' not in line and '"c"' not in line
