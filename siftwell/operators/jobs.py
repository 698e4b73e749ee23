"""Job logs and outcomes: transitions, versions, and the decision tables of each stage."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.schemas import JOB_ERROR_CATEGORY, OUTCOMES, STAGES

DEGRADED = ("PARTIAL", "EMPTY", "UNSUPPORTED", "FAILED")


def allowed_targets(stages: tuple[str, ...], current: str) -> frozenset[str]:
    """Where a job in ``current`` may go next."""
    if current == "QUEUED":
        return frozenset({stages[0], "CANCELLED", "FAILED"})
    if current not in stages:
        return frozenset()
    following = stages[stages.index(current) + 1 :]
    return frozenset({following[0], "CANCELLED", "FAILED"}) if following else frozenset(OUTCOMES)


def transition_table(spark: SparkSession, stages: tuple[str, ...]) -> DataFrame:
    pairs = [(a, b) for a in ("QUEUED", *stages) for b in sorted(allowed_targets(stages, a))]
    return spark.createDataFrame(pairs, "previous string, state string")


def illegal_transitions(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Events ``job_id, seq, state`` that their predecessor does not allow; a job starts QUEUED."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))
    steps = events.select("job_id", "seq", before.alias("previous"), "state")
    allowed = F.broadcast(transition_table(events.sparkSession, stages))
    first = F.col("previous").isNull()
    bad_first = steps.where(first & (F.col("state") != "QUEUED"))
    return steps.where(~first).join(allowed, ["previous", "state"], "left_anti").select("job_id", "seq", "previous", "state").unionByName(bad_first)


def number_events(events: DataFrame) -> DataFrame:
    """Events with a gapless ``seq`` from 1 per job, by time and arrival."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("at", "arrival")))


def version_gaps(jobs: DataFrame) -> DataFrame:
    """Stored versions that do not follow the one before."""
    last = F.lag("version").over(Window.partitionBy("id").orderBy("version"))
    return jobs.select("id", "version", last.alias("before")).where(F.col("version") != F.coalesce(F.col("before") + 1, F.lit(1)))


def current_jobs(jobs: DataFrame) -> DataFrame:
    fields = [c for c in jobs.columns if c != "id"]
    return jobs.groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("j")).select("id", "j.*")


def idempotent_requests(requests: DataFrame) -> DataFrame:
    """Requests with the job each one gets: the first of its key; ``conflict`` if it asks for something else.

    The first request of each key is a partial aggregate that joins back, so a key with a third of
    all requests needs no task of its own; requests without a key join nothing.
    """
    ask = F.struct("query", "language", "country")
    first = requests.where("key is not null").groupBy(F.col("key").alias("_key")).agg(F.min_by(F.struct("id", ask.alias("ask")), "arrival").alias("_f"))
    rows = requests.join(first, F.col("key") == F.col("_key"), "left")
    same = F.col("_f.ask").eqNullSafe(ask)
    return rows.select(
        *requests.columns,
        F.when(F.col("key").isNull(), F.col("id")).when(same, F.col("_f.id")).alias("job"),
        F.coalesce(F.col("key").isNotNull() & ~same, F.lit(False)).alias("conflict"),
        tx.key_hash(F.col("key")).alias("key_hash"),
    )


def valid_request(query: Column, language: Column, country: Column) -> Column:
    return (
        F.coalesce(tx.query_column(query).isNotNull(), F.lit(False))
        & F.coalesce(language.rlike(r"\A[a-z]{2}\z"), F.lit(True))
        & F.coalesce(country.rlike(r"\A[A-Z]{2}\z"), F.lit(True))
    )


def valid_plan(queries: Column) -> Column:
    clean = F.transform(queries, tx.collapse)
    return F.size(queries).between(1, 8) & (F.size(F.array_distinct(clean)) == F.size(queries)) & ~F.exists(clean, lambda q: q == "")


def valid_stages(stages: Column) -> Column:
    """Non-empty, known, distinct and in canonical order."""
    order = F.array(*(F.lit(s) for s in STAGES))
    places = F.transform(stages, lambda s: F.array_position(order, s))
    return (F.size(stages) > 0) & ~F.exists(places, lambda p: p == 0) & (F.array_sort(F.array_distinct(places)) == places)


def error_category(code: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in JOB_ERROR_CATEGORY.items()))
    return F.coalesce(F.try_element_at(known, code), F.lit("INTERNAL_ERROR"))


def search_conclusion(cancelled: Column, stop: Column, covered: Column, planned: Column, errors: Column) -> Column:
    """End of a search-only job: ``struct(status, error, warning)``; cancel, deadline, timeout, outcome."""
    late = F.coalesce(stop.isin("JOB_DEADLINE_EXCEEDED", "SEARCH_STAGE_TIMEOUT"), F.lit(False))
    status = (
        F.when(cancelled, "CANCELLED")
        .when(late, F.when(covered > 0, "PARTIAL").otherwise("FAILED"))
        .when(covered == 0, "FAILED")
        .when(covered == planned, "COMPLETED")
        .otherwise("PARTIAL")
    )
    error = F.when(~cancelled & late & (covered == 0), stop).when(~cancelled & ~late & (covered == 0), "ALL_SEARCH_PROVIDERS_FAILED")
    warning = F.when(~cancelled & late & (covered > 0), stop).when(~cancelled & ~late & (covered > 0) & (errors > 0), "PROVIDER_FAILURES")
    return F.struct(status.alias("status"), error.alias("error"), warning.alias("warning"))


def after_search(cancelled: Column, stop: Column, covered: Column, planned: Column, errors: Column) -> Column:
    """End of the search stage of a pipeline job: ``struct(status, warning, degraded)``; null status goes on."""
    plain = search_conclusion(cancelled, stop, covered, planned, errors)
    ends = cancelled | (covered == 0)
    deadline, late = stop.eqNullSafe("JOB_DEADLINE_EXCEEDED"), stop.eqNullSafe("SEARCH_STAGE_TIMEOUT")
    status = F.when(ends, plain["status"]).when(deadline, "PARTIAL")
    warning = F.when(ends, plain["warning"]).when(deadline | late, stop).when(errors > 0, "PROVIDER_FAILURES")
    return F.struct(status.alias("status"), warning.alias("warning"), (late | (covered < planned)).alias("degraded"))


def crawl_outcome(stop: Column, stage_error: Column) -> Column:
    status = (
        F.when(stage_error.isNotNull(), "FAILED")
        .when(stop.isin("CANCELLED", "FINALIZED", "JOB_DEADLINE"), "INTERRUPTED")
        .when(stop == "STAGE_TIMEOUT", "PARTIAL")
        .otherwise("COMPLETED")
    )
    code = F.when(stage_error.isNotNull(), stage_error).when(stop == "JOB_DEADLINE", "JOB_DEADLINE_EXCEEDED").when(stop == "STAGE_TIMEOUT", "CRAWL_STAGE_TIMEOUT")
    return F.struct(F.lit("CRAWLING").alias("stage"), status.alias("status"), code.alias("code"))


def after_crawl(stored: Column, cancelled: Column, stage_error: Column, stop: Column, usable: Column) -> Column:
    """``struct(status, error, warning, degraded)`` after the crawl stage; null status goes on."""
    deadline = stop.eqNullSafe("JOB_DEADLINE")
    status = (
        F.when(stored.isin(*OUTCOMES), stored)
        .when(cancelled, "CANCELLED")
        .when(stage_error.isNotNull(), "FAILED")
        .when(deadline, F.when(usable > 0, "PARTIAL").otherwise("FAILED"))
    )
    live = ~F.coalesce(stored.isin(*OUTCOMES), F.lit(False))
    error = F.when(live & ~cancelled, F.when(stage_error.isNotNull(), stage_error).when(deadline & (usable == 0), "JOB_DEADLINE_EXCEEDED"))
    warning = F.when(live & cancelled, stage_error).when(live & deadline & (usable > 0) & stage_error.isNull(), "JOB_DEADLINE_EXCEEDED").when(
        live & stop.eqNullSafe("STAGE_TIMEOUT") & stage_error.isNull(), "CRAWL_STAGE_TIMEOUT"
    )
    return F.struct(status.alias("status"), error.alias("error"), warning.alias("warning"), stop.eqNullSafe("STAGE_TIMEOUT").alias("degraded"))


def pipeline_conclusion(cancelled: Column, dedup_failed: Column, fetch_failed: Column, degraded_documents: Column, dedup_errors: Column, sources: Column, usable: Column, degraded: Column) -> Column:
    """``struct(status, error, warnings)`` at the end of a pipeline job."""
    none = (sources > 0) & (usable == 0)
    status = F.when(cancelled, "CANCELLED").when(dedup_failed | none, "FAILED").when(degraded, "PARTIAL").otherwise("COMPLETED")
    error = F.when(~cancelled, F.when(dedup_failed, "DEDUP_FAILED").when(none, "NO_DOCUMENTS"))
    open_end = ~cancelled & ~dedup_failed
    warnings = F.array_compact(
        F.array(
            F.when(open_end & (fetch_failed > 0), "FETCH_FAILURES"),
            F.when(open_end & (degraded_documents > 0), "EXTRACTION_DEGRADED"),
            F.when(open_end & (dedup_errors > 0), "DEDUP_CONTRACT_ERRORS"),
        )
    )
    return F.struct(status.alias("status"), error.alias("error"), warnings.alias("warnings"))


def stage_outcomes(stages: tuple[str, ...], reached: Column) -> Column:
    """Stages after ``reached`` as NOT_RUN."""
    order = F.array(*(F.lit(s) for s in stages))
    rest = F.slice(order, F.array_position(order, reached).cast("int") + 1, len(stages))
    return F.transform(rest, lambda s: F.struct(s.alias("stage"), F.lit("NOT_RUN").alias("status")))


def progress(stage: Column, stages: tuple[str, ...], outcomes: Column) -> Column:
    order = F.array(*(F.lit(s) for s in stages))
    done = F.filter(outcomes, lambda o: o.isin("COVERED", "FAILED"))
    return F.struct(
        stage.alias("stage"),
        (F.array_position(order, stage) - 1).cast("int").alias("stage_index"),
        F.lit(len(stages)).alias("total_stages"),
        F.size(outcomes).alias("queries_total"),
        F.size(done).alias("queries_done"),
        F.size(F.filter(outcomes, lambda o: o == "FAILED")).alias("queries_failed"),
    )


def seconds_left(deadline: Column, now: Column) -> Column:
    return F.unix_micros(deadline) / 1e6 - F.unix_micros(now) / 1e6


def admission_order(waiting: DataFrame, slots: int, per_host: int, per_job: int) -> DataFrame:
    """Which waiting fetches start first, and in which round.

    ``waiting``: ``job_id, position, host``. Replays fair admission with equal fetch times: in a
    round each job and host has its slots, jobs take turns, the lowest position of a free host goes
    first. One small plan per batch of jobs, folded in one pass.
    """
    import pandas as pd

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        queues = {j: list(g.sort_values("position")[["position", "host"]].itertuples(index=False)) for j, g in batch.groupby("job_id", sort=True)}
        jobs, turn, rows, n = list(queues), 0, [], 0
        while any(queues.values()):
            busy_jobs: dict = {}
            busy_hosts: dict = {}
            free, n, moved = slots, n + 1, True
            while free and moved:
                moved = False
                for k in range(len(jobs)):
                    job = jobs[(turn + k) % len(jobs)]
                    pick = next((w for w in queues[job] if w.host is None or busy_hosts.get(w.host, 0) < per_host), None)
                    if pick is None or busy_jobs.get(job, 0) >= per_job:
                        continue
                    queues[job].remove(pick)
                    busy_jobs[job] = busy_jobs.get(job, 0) + 1
                    if pick.host is not None:
                        busy_hosts[pick.host] = busy_hosts.get(pick.host, 0) + 1
                    rows.append((job, pick.position, n, len(rows) + 1))
                    turn, free, moved = (turn + k + 1) % len(jobs), free - 1, True
                    break
        return pd.DataFrame(rows, columns=["job_id", "position", "round", "granted"])

    return waiting.groupBy("pool").applyInPandas(fold, "job_id string, position int, round int, granted int")
