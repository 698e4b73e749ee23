"""The control plane: a job store with compare-and-set, and a façade over the operators.

One small store holds jobs (no table has transactional single-row updates); everything with rows
in it is a DataFrame plan over a job's inputs. How a job ends is not decided here: the engine feeds
counts to the decision tables of ``operators.jobs``, the same expressions that judge recorded jobs.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftwell.config import Settings
from siftwell.functions.text import clean_query
from siftwell.operators import dedup, jobs, search, sources
from siftwell.operators.jobs import allowed_targets
from siftwell.schemas import JOB_ERROR_CATEGORY, OUTCOMES, PIPELINE_STAGES, SEARCH_STAGES, STAGES
from siftwell.session import once

JOB_TIMEOUT_S = 600
CONFLICT_RETRIES = 3
MOST_QUERIES = 8


class EngineError(Exception):
    """``code``, HTTP ``status``, and a message, reason and details without any input in them."""

    def __init__(self, code: str, status: int, message: str, reason: str | None = None, details: dict | None = None) -> None:
        super().__init__(message)
        self.code, self.status, self.reason, self.details = code, status, reason, details

    def body(self) -> dict:
        more = {"reason": self.reason, "details": self.details}
        return {"error": {"code": self.code, "message": str(self)} | {k: v for k, v in more.items() if v}}


class Cancelled(Exception):
    """A cancel request that was recorded while a stage worked."""


@dataclass(frozen=True)
class Plan:
    planner: str
    queries: tuple[str, ...]
    language: str | None = None
    country: str | None = None


@dataclass(frozen=True)
class Job:
    id: str
    query: str
    language: str | None
    country: str | None
    stages: tuple[str, ...]
    status: str = "QUEUED"
    version: int = 1
    created_at: datetime | None = None
    started_at: datetime | None = None
    completed_at: datetime | None = None
    deadline_at: datetime | None = None
    worker: str | None = None
    cancel_requested: bool = False
    plan: Plan | None = None
    coverage: str | None = None
    counts: tuple[tuple[str, int], ...] = ()
    stage_outcomes: tuple[tuple[str, str, str | None], ...] = ()
    error: str | None = None
    error_step: str | None = None
    warnings: tuple[str, ...] = ()

    @property
    def terminal(self) -> bool:
        return self.status in OUTCOMES


def fixed_plan(job: Job) -> Plan:
    """The job's own query, in its language and country."""
    return Plan("fixed-v1", (job.query,), job.language, job.country)


JOB_TABLE = (
    "id string, query string, language string, country string, stages array<string>, status string, version int, created_at timestamp, started_at timestamp, "
    "completed_at timestamp, deadline_at timestamp, worker string, cancel_requested boolean, coverage string, error_code string, error_step string, warning_codes array<string>, results int"
)


@dataclass
class JobStore:
    """Jobs by id, with all their versions, idempotency keys and an event log per job."""

    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    jobs: dict[str, Job] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    versions: list[Job] = field(default_factory=list)
    logs: dict[str, list[tuple[str, int, str, datetime, dict]]] = field(default_factory=lambda: defaultdict(list))
    lock: threading.RLock = field(default_factory=threading.RLock)

    @property
    def events(self) -> list[tuple[str, int, str, datetime, dict]]:
        return [e for log in self.logs.values() for e in log]

    def append_event(self, job_id: str, kind: str, **data) -> None:
        with self.lock:
            log = self.logs[job_id]
            log.append((job_id, len(log) + 1, kind, self.clock(), {k: str(v) for k, v in data.items()}))

    def _put(self, job: Job, kind: str, **data) -> Job:
        self.jobs[job.id] = job
        self.versions.append(job)
        self.append_event(job.id, kind, state=job.status, **data)
        return job

    def create(self, job: Job, key: str | None = None) -> tuple[Job, bool]:
        """The job and whether it is new; a used key gives its job back if it asks for the same."""
        if tuple(s for s in STAGES if s in job.stages) != job.stages or not job.stages:
            raise ValueError("stages must be distinct and in canonical order")
        with self.lock:
            if key is not None and key in self.keys:
                held = self.jobs[self.keys[key]]
                if (held.query, held.language, held.country) != (job.query, job.language, job.country):
                    raise EngineError("IDEMPOTENCY_CONFLICT", 409, "the key was used for another request", "IDEMPOTENCY_KEY_REUSED")
                return held, False
            if key is not None:
                self.keys[key] = job.id
            return self._put(replace(job, created_at=self.clock()), "created"), True

    def get(self, job_id: str) -> Job:
        with self.lock:
            if job_id not in self.jobs:
                raise EngineError("JOB_NOT_FOUND", 404, "no such job", "JOB_NOT_FOUND")
            return self.jobs[job_id]

    def save(self, job: Job, event: str = "saved", **changes) -> Job:
        """Store changes if ``job`` is the current version and the transition is allowed."""
        with self.lock:
            held = self.get(job.id)
            if held.version != job.version:
                raise EngineError("VERSION_CONFLICT", 409, "the job was changed meanwhile")
            if {"stages", "query", "language", "country"} & changes.keys():
                raise ValueError("a request cannot be changed")
            target = changes.get("status", held.status)
            if target != held.status and target not in allowed_targets(held.stages, held.status):
                raise EngineError("INVALID_TRANSITION", 409, f"{held.status} to {target}")
            return self._put(replace(held, version=held.version + 1, **changes), event)

    def claim(self, job_id: str, worker: str, timeout_s: float = JOB_TIMEOUT_S) -> Job:
        with self.lock:
            job = self.get(job_id)
            if job.status != "QUEUED":
                raise EngineError("NOT_CLAIMABLE", 409, "the job is not queued")
            now = self.clock()
            return self.save(job, "claimed", status=job.stages[0], worker=worker, started_at=now, deadline_at=now + timedelta(seconds=timeout_s))

    def request_cancel(self, job_id: str) -> Job:
        """Queued jobs end at once, running ones are flagged, ended ones stay as they are."""
        with self.lock:
            job = self.get(job_id)
            if job.terminal or job.cancel_requested:
                return job
            if job.status == "QUEUED":
                return self.save(job, "cancelled", status="CANCELLED", completed_at=self.clock())
            return self.save(job, "cancel_requested", cancel_requested=True)

    def log_table(self, spark: SparkSession) -> DataFrame:
        rows = [(j, s, k, t.replace(tzinfo=None), d) for j, s, k, t, d in self.events]
        return spark.createDataFrame(rows, "job_id string, seq int, type string, at timestamp, data map<string,string>")

    def version_table(self, spark: SparkSession) -> DataFrame:
        """Every stored version, as rows that a table of jobs can append."""

        def plain(t: datetime | None) -> datetime | None:
            return t and t.replace(tzinfo=None)

        rows = [
            (
                j.id, j.query, j.language, j.country, list(j.stages), j.status, j.version, plain(j.created_at), plain(j.started_at), plain(j.completed_at),
                plain(j.deadline_at), j.worker, j.cancel_requested, j.coverage, j.error, j.error_step, list(j.warnings), dict(j.counts).get("results_unique"),
            )
            for j in self.versions
        ]
        return spark.createDataFrame(rows, JOB_TABLE)

    def restore(self, versions: DataFrame) -> None:
        """Take over the jobs of a table of versions; plans, keys and results are not in it."""
        with self.lock:
            for r in jobs.current_jobs(versions).collect():
                at = {c: r[c] and r[c].replace(tzinfo=UTC) for c in ("created_at", "started_at", "completed_at", "deadline_at")}
                job = Job(
                    r["id"], r["query"], r["language"], r["country"], tuple(r["stages"]), r["status"], r["version"], worker=r["worker"], cancel_requested=r["cancel_requested"],
                    coverage=r["coverage"], error=r["error_code"], error_step=r["error_step"], warnings=tuple(r["warning_codes"]), **at,
                )
                self._put(job, "restored")


def cancel_status(after: Job, before: Job) -> int:
    """The HTTP status of a cancel request."""
    return 409 if before.terminal else 200 if after.status == "CANCELLED" else 202


@dataclass
class _Run:
    """What a run has found so far."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    outcomes: list[tuple[str, str, str | None]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    coverage: str | None = None
    covered: int = 0
    usable: int = 0
    degraded: bool = False


class Engine:
    """Submit, run, inspect and cancel research jobs over recorded or live inputs.

    ``planner`` (job to plan), ``store`` (a ``JobStore`` or its like) and ``group`` (documents to
    ``groups`` and ``errors``) are parameters.
    """

    def __init__(self, spark: SparkSession, store: JobStore | None = None, pipeline: bool = False, most_urls: int = sources.MAX_URLS, settings: Settings | None = None, planner: Callable[[Job], Plan] = fixed_plan, group=None) -> None:
        self.spark, self.store, self.most_urls, self.planner = spark, store or JobStore(), most_urls, planner
        self.settings = settings or Settings()
        self.group = group or (lambda documents: {"groups": dedup.groups(documents, ["job_id"]), "errors": dedup.errors(documents, ["job_id"])})
        self.stages = PIPELINE_STAGES if pipeline else SEARCH_STAGES
        self.results: dict[str, dict[str, DataFrame]] = {}
        self.pool = ThreadPoolExecutor(self.settings.concurrent_jobs)
        self.started: dict[str, Future] = {}

    # -- requests ---------------------------------------------------------------------------

    def submit(self, query: str, language: str | None = None, country: str | None = None, key: str | None = None) -> Job:
        return self.create(query, language, country, key)[0]

    def create(self, query: str, language: str | None = None, country: str | None = None, key: str | None = None) -> tuple[Job, bool]:
        clean = clean_query(query)
        if clean is None:
            raise EngineError("INVALID_REQUEST", 422, "query: 3 to 500 characters without control characters")
        waiting = sum(not j.terminal for j in self.store.jobs.values())
        if waiting >= self.settings.concurrent_jobs + self.settings.queued_jobs and (key is None or key not in self.store.keys):
            raise EngineError("CAPACITY_EXHAUSTED", 503, "too many jobs", "CAPACITY_EXHAUSTED")
        return self.store.create(Job(uuid.uuid4().hex, clean, language, country, self.stages), key)

    def start(self, job_id: str, **inputs) -> Future:
        """Run the job on one of the engine's threads."""
        self.started[job_id] = self.pool.submit(self.run, job_id, **inputs)
        return self.started[job_id]

    def cancel(self, job_id: str) -> int:
        """Record the cancel first, then stop what the job has in flight."""
        before = self.store.get(job_id)
        after = self.store.request_cancel(job_id)
        if after.cancel_requested and not after.terminal:
            self.spark.sparkContext.cancelJobGroup(job_id)
        return cancel_status(after, before)

    def get(self, job_id: str) -> Job:
        return self.store.get(job_id)

    def get_results(self, job_id: str) -> dict[str, DataFrame]:
        job = self.store.get(job_id)
        if not job.terminal:
            raise EngineError("JOB_NOT_FINISHED", 409, "the job is not finished", "JOB_NOT_FINISHED", {"status": job.status})
        if job_id not in self.results:
            raise EngineError("JOB_FAILED", 409, "the job has no results", "JOB_FAILED", {"status": job.status, "error": job.error})
        return self.results[job_id]

    def view(self, job_id: str) -> dict:
        """The job as a caller sees it."""
        j = self.store.get(job_id)
        shown = {k: v for k, v in asdict(j).items() if k in ("query", "status", "cancel_requested", "created_at", "started_at", "deadline_at")}

        def problem(code: str, step: str | None) -> dict:
            return {"code": code, "category": JOB_ERROR_CATEGORY.get(code, "INTERNAL_ERROR"), "step": step}

        counts = dict(j.counts)
        own = ("queries_total", "queries_done", "queries_failed", "results_unique") + (("urls_total", "urls_done", "fetch_failed", "documents", "groups") if "CRAWLING" in j.stages else ())
        return shown | {
            "job_id": j.id, "stage": j.status if j.status in j.stages else None, "stages": list(j.stages), "finished_at": j.completed_at,
            "progress": {k: counts.get(k, 0) for k in own} if counts else None,
            "result_summary": {"coverage": j.coverage, "results": counts.get("results_unique", 0)} if j.terminal and j.coverage else None,
            "error": problem(j.error, j.error_step) if j.error else None, "warnings": [problem(w, None) for w in j.warnings],
        }

    def health(self) -> dict:
        states = [j.status for j in self.store.jobs.values()]
        return {"queued": states.count("QUEUED"), "running": sum(s not in ("QUEUED", *OUTCOMES) for s in states)}

    # -- running ----------------------------------------------------------------------------

    def run(self, job_id: str, hits: DataFrame, queries: DataFrame, providers: DataFrame, fetches: DataFrame | None = None, attempts: DataFrame | None = None) -> Job:
        """Run the job's stages over ``hits`` (with the ``attempts`` they came from) and ``fetches``.

        Without ``attempts`` every query counts as answered, be its answer empty.
        """
        job = self.store.claim(job_id, "engine", self.settings.job_timeout_s)
        run = _Run()
        try:
            return self._stages(job, run, hits, queries, providers, fetches, attempts)
        except Cancelled:
            return self._finish(self.store.get(job_id), run, "CANCELLED")
        except BaseException:
            self._finish(self.store.get(job_id), run, "FAILED", "RUNNER_INTERRUPTED")
            raise

    def _decide(self, table: Column) -> Row:
        return self.spark.range(1).select(table.alias("d")).first()["d"]

    def _seconds_left(self, job: Job) -> float:
        return (job.deadline_at - self.store.clock()).total_seconds()

    def _save(self, job: Job, event: str = "saved", **changes) -> Job:
        """Store changes though others write as well: again on the newest version, unless the job ended or is to end."""
        for attempt in range(CONFLICT_RETRIES + 1):
            if job.terminal:
                return job
            try:
                return self.store.save(job, event, **changes)
            except EngineError as e:
                if e.code != "VERSION_CONFLICT" or attempt == CONFLICT_RETRIES:
                    raise
            job = self.store.get(job.id)
            if job.cancel_requested and not job.terminal and changes.get("status") != "CANCELLED":
                raise Cancelled
        return job

    @contextmanager
    def _limited(self, job: Job, stage_s: float, job_code: str, stage_code: str):
        """Work in the job's group; ``stop`` tells what cut it short, if anything did."""
        left = self._seconds_left(job)
        limit, code = (left, job_code) if left <= stage_s else (stage_s, stage_code)
        state: dict = {"stop": code if limit <= 0 else None, "error": None}
        sc = self.spark.sparkContext

        def expire() -> None:
            state["stop"] = code
            sc.cancelJobGroup(job.id)

        timer = threading.Timer(max(limit, 0.001), expire)
        sc.setJobGroup(job.id, "research job", True)
        timer.start()
        try:
            yield state
        except Exception as e:  # noqa: BLE001  a stage's failure is the job's outcome
            if self.store.get(job.id).cancel_requested:
                state["stop"] = "CANCELLED"
            elif state["stop"] is None:
                state["error"] = e
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _enter(self, job: Job, run: _Run, stage: str) -> Job:
        """The next stage, or the end of a job that is to end before it."""
        job = self.store.get(job.id)
        if job.terminal:
            return job
        if job.cancel_requested:
            return self._finish(job, run, "CANCELLED")
        if self._seconds_left(job) <= 0:
            useful = run.covered if job.status == "SEARCHING" else run.usable if job.status not in ("PLANNING", "QUEUED") else 0
            if useful:
                return self._finish(job, run, "PARTIAL", warning="JOB_DEADLINE_EXCEEDED")
            return self._finish(job, run, "FAILED", "JOB_DEADLINE_EXCEEDED")
        return self._save(job, "stage_started", status=stage, counts=tuple(run.counts.items()))

    def _stages(self, job, run, hits, queries, providers, fetches, attempts) -> Job:
        try:
            plan = self.planner(job)
            if not 1 <= len(plan.queries) <= MOST_QUERIES or len(set(plan.queries)) != len(plan.queries):
                raise ValueError("a plan has one to eight distinct queries")
        except Exception:  # noqa: BLE001
            return self._finish(job, run, "FAILED", "INTERNAL_ERROR")
        job = self._save(job, "plan_created", plan=plan)
        job = self._enter(job, run, "SEARCHING")
        if not job.terminal:
            job = self._search(job, run, hits, queries, providers, attempts)
        if not job.terminal and "CRAWLING" in job.stages:
            job = self._enter(job, run, "CRAWLING")
            if not job.terminal:
                job = self._crawl(job, run, fetches)
            if not job.terminal:
                job = self._enter(job, run, "NORMALIZING")
            if not job.terminal:
                job = self._normalize(job, run)
        return job

    def _search(self, job: Job, run: _Run, hits, queries, providers, attempts) -> Job:
        counts: dict = {}
        with self._limited(job, self.settings.search_stage_timeout_s, "JOB_DEADLINE_EXCEEDED", "SEARCH_STAGE_TIMEOUT") as state:
            if state["stop"] is None:
                run.tables["results"] = once(search.merge(hits, queries, providers))
                planned = queries.select(F.col("request_id").alias("job_id"), F.col("name").alias("query"))
                found = search.query_outcomes(planned, attempts)
                run.tables["outcomes"] = found
                row = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "COVERED").alias("covered")).first()
                errors = search.provider_errors(attempts).count() if attempts is not None else 0
                counts = {"planned": row["n"], "covered": row["covered"], "errors": errors, "results": run.tables["results"].count()}
        if state["error"] is not None:
            return self._finish(self.store.get(job.id), run, "FAILED", "INTERNAL_ERROR")
        covered, planned = counts.get("covered", 0), counts.get("planned", len(job.plan.queries))
        run.covered, run.coverage = covered, "COMPLETE" if covered == planned and covered else "PARTIAL" if covered else "NONE"
        run.counts |= {"queries_total": planned, "queries_done": planned if counts else 0, "queries_failed": counts.get("errors", 0) and planned - covered, "results_unique": counts.get("results", 0)}
        job = self.store.get(job.id)
        known = [F.lit(job.cancel_requested), F.lit(state["stop"]).cast("string"), F.lit(covered), F.lit(planned), F.lit(counts.get("errors", 0))]
        end = self._decide(jobs.search_conclusion(*known))
        if "CRAWLING" not in job.stages:
            return self._finish(job, run, end["status"], end["error"], end["warning"])
        after = self._decide(jobs.after_search(*known))
        if after["status"] is not None:
            return self._finish(job, run, after["status"], end["error"], after["warning"])
        run.degraded = run.degraded or after["degraded"]
        run.warnings += [after["warning"]] if after["warning"] else []
        return job

    def _crawl(self, job: Job, run: _Run, fetches) -> Job:
        code = None
        with self._limited(job, self.settings.crawl_stage_timeout_s, "JOB_DEADLINE", "STAGE_TIMEOUT") as state:
            if state["stop"] is None and fetches is not None:
                selection = search.select_prefix(run.tables["results"], self.most_urls).withColumnRenamed("request_id", "job_id")
                found = sources.run_replay(selection, fetches)
                over = sources.over_budget(found["documents"], self.settings.max_total_text_chars)
                row = sources.pipeline_counts(found["stats"]).agg(*(F.sum(c).alias(c) for c in ("urls_total", "urls_done", "fetch_failed", "documents"))).first()
                run.usable = sources.usable(found["documents"]).agg(F.sum("usable")).first()[0] or 0
                run.counts |= {k: int(v or 0) for k, v in row.asDict().items()}
                run.counts["degraded"] = found["documents"].where(F.col("status").isin(*jobs.DEGRADED)).count()
                run.tables |= found
                code = None if over.isEmpty() else "PIPELINE_BUDGET_EXCEEDED"
        code = "CRAWL_FAILED" if state["error"] is not None else code
        stop, job = state["stop"], self.store.get(job.id)
        outcome = self._decide(jobs.crawl_outcome(F.lit(stop).cast("string"), F.lit(code).cast("string")))
        run.outcomes.append((outcome["stage"], outcome["status"], outcome["code"]))
        after = self._decide(jobs.after_crawl(F.lit(job.status), F.lit(job.cancel_requested), F.lit(code).cast("string"), F.lit(stop).cast("string"), F.lit(run.usable)))
        run.warnings += [after["warning"]] if after["warning"] else []
        if after["status"] is not None:
            return self._finish(job, run, after["status"], after["error"])
        run.degraded = run.degraded or after["degraded"]
        return job

    def _normalize(self, job: Job, run: _Run) -> Job:
        broken = 0
        with self._limited(job, self._seconds_left(job), "JOB_DEADLINE", "JOB_DEADLINE") as state:
            if "documents" in run.tables:
                run.tables |= self.group(run.tables["documents"])
                run.counts["groups"] = run.tables["groups"].count()
                broken = run.tables["errors"].count()
        failed, job = state["error"] is not None or state["stop"] is not None, self.store.get(job.id)
        run.outcomes.append(("NORMALIZING", "FAILED" if state["error"] is not None else "INTERRUPTED" if failed else "COMPLETED", "DEDUP_FAILED" if state["error"] is not None else None))
        c = run.counts
        known = [job.cancel_requested, failed, c.get("fetch_failed", 0), c.get("degraded", 0), broken, c.get("urls_total", 0), run.usable, run.degraded]
        end = self._decide(jobs.pipeline_conclusion(*map(F.lit, known)))
        run.warnings += list(end["warnings"])
        return self._finish(job, run, end["status"], end["error"])

    def _finish(self, job: Job, run: _Run, status: str, error: str | None = None, warning: str | None = None) -> Job:
        """The last write. A job that ends PARTIAL early passes its other stages without running them."""
        if job.terminal:
            return job
        step, warnings = job.status, tuple(run.warnings) + ((warning,) if warning else ())
        try:
            while status in ("COMPLETED", "PARTIAL") and job.status != job.stages[-1]:
                following = job.stages[job.stages.index(job.status) + 1]
                if following in ("CRAWLING", "NORMALIZING"):
                    run.outcomes.append((following, "NOT_RUN", None))
                job = self._save(job, "stage_skipped", status=following)
                if job.terminal:
                    return job
            if run.tables:
                self.results[job.id] = run.tables
            kind = {"FAILED": "failed", "CANCELLED": "cancelled"}.get(status, "completed")
            return self._save(
                job, kind, status=status, completed_at=self.store.clock(), error=error, error_step=step if error else None, warnings=warnings,
                coverage=run.coverage, counts=tuple(run.counts.items()), stage_outcomes=tuple(run.outcomes),
            )
        except Cancelled:
            # A cancel that was recorded meanwhile wins.
            return self._finish(self.store.get(job.id), run, "CANCELLED")

    def shutdown(self) -> None:
        """Stop what runs; jobs that wait stay queued."""
        for job_id, future in self.started.items():
            if not future.done() and not future.cancel():
                self.spark.sparkContext.cancelJobGroup(job_id)
        self.pool.shutdown(wait=True, cancel_futures=True)
