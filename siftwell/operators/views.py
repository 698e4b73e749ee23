"""Records and views: projections of stored rows to what a caller sees. None holds page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.jobs import error_category
from siftwell.schemas import OUTCOMES


def fetch_records(fetches: DataFrame) -> DataFrame:
    """Fetch results without body, title and search result."""
    return fetches.drop("content", "body", "title", "source", "headers")


def attempt_records(attempts: DataFrame) -> DataFrame:
    """Search attempts as they are stored; an error's message stays behind."""
    e = F.col("error")
    provider = F.coalesce(e["provider"], F.col("provider")) if "provider" in attempts.schema["error"].dataType.names else F.col("provider")
    kept = F.struct(provider.alias("provider"), F.coalesce(e["code"], F.lit("")).alias("code"), F.coalesce(e["category"], F.lit("")).alias("category"), F.coalesce(e["retryable"], F.lit(False)).alias("retryable"))
    tries = F.col("tries") if "tries" in attempts.columns else F.when(F.col("status") == "SKIPPED_CIRCUIT_OPEN", 0).otherwise(1)
    return attempts.select("request_id", "idx", "provider", "query", "status", tries.alias("tries"), "duration_ms", "result_count", F.when(e.isNotNull(), kept).alias("error"))


def outcomes_in_order(outcomes: DataFrame) -> DataFrame:
    """Each job's query outcomes as one list, by index."""
    fields = [c for c in outcomes.columns if c not in ("job_id", "index")]
    return outcomes.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("index", *fields))).alias("outcomes"))


def first_failure(failures: DataFrame) -> DataFrame:
    """What stops a stage: a caller's signal before any stage failure, else the first failure.

    ``failures``: ``job_id, seq, kind, code``; kind SIGNAL or FAILURE, others do not count.
    """
    rows = failures.where(F.col("kind").isin("SIGNAL", "FAILURE"))
    order = F.struct((F.col("kind") != "SIGNAL").alias("late"), "seq")
    return rows.groupBy("job_id").agg(F.min_by(F.struct("kind", "code"), order).alias("f")).select("job_id", "f.*")


def error_view(code: Column, step: Column, message: Column, provider_errors: Column | None = None) -> Column:
    """``struct(code, category, step, message, provider_errors)``; errors of providers only where given."""
    shown = F.transform(provider_errors, lambda e: F.struct(e["provider"].alias("provider"), e["code"].alias("code"), e["category"].alias("category"))) if provider_errors is not None else F.array()
    kind = "array<struct<provider:string,code:string,category:string>>"
    category = F.when(code.isin("ALL_SEARCH_PROVIDERS_FAILED", "PROVIDER_FAILURES"), "PROVIDER_ERROR").otherwise(error_category(code))
    whole = F.struct(code.alias("code"), category.alias("category"), step.alias("step"), message.alias("message"), F.coalesce(shown.cast(kind), F.array().cast(kind)).alias("provider_errors"))
    return F.when(code.isNotNull(), whole)


def progress_view(pipeline: Column, counts: dict[str, Column]) -> Column:
    """Counts of queries for every job, those of the crawl for pipeline jobs only."""
    always = ("queries_total", "queries_done", "queries_failed", "results_unique")
    return F.struct(*((v if k in always else F.when(pipeline, v)).alias(k) for k, v in counts.items()))


def job_views(jobs: DataFrame) -> DataFrame:
    """``jobs``: ``id, query, status, stages, cancel_requested, created_at, started_at, completed_at, deadline_at, coverage,
    results, error_code, error_step, warning_codes``, one row a job.
    """
    ended = F.col("status").isin(*OUTCOMES)
    none = F.lit(None).cast("string")
    return jobs.select(
        F.col("id").alias("job_id"),
        "query",
        "status",
        F.when(F.array_contains("stages", F.col("status")), F.col("status")).alias("stage"),
        "stages",
        "cancel_requested",
        "created_at",
        "started_at",
        F.col("completed_at").alias("finished_at"),
        "deadline_at",
        F.when(ended & F.col("coverage").isNotNull(), F.struct("coverage", "results")).alias("result_summary"),
        error_view(F.col("error_code"), F.col("error_step"), F.lit("")).alias("error"),
        F.transform("warning_codes", lambda w: error_view(w, none, F.lit(""))).alias("warnings"),
    )


def result_items(merged: DataFrame) -> DataFrame:
    """The items of a results view, in order of first appearance."""
    r = F.col("result")
    return merged.select(
        "request_id", "position", r["url"].alias("url"), r["title"].alias("title"), r["source"].alias("provider"), "providers", r["rank"].alias("rank"), "occurrences"
    )


def results_view(items: DataFrame, statuses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One JSON document for each request: results, provider statuses and query outcomes."""

    def listed(rows: DataFrame, name: str, order: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("request_id", order)]
        found = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("v")))).alias("l"))
        return found.select("request_id", F.transform("l", lambda x: x["v"]).alias(name))

    whole = listed(statuses, "provider_statuses", "ord").join(listed(items, "results", "position"), "request_id", "left").join(listed(outcomes, "query_outcomes", "index"), "request_id", "left")
    return whole.select("request_id", F.to_json(F.struct("results", "provider_statuses", "query_outcomes")).alias("body"))


def envelope(data: Column, request_id: Column, error: Column | None = None) -> Column:
    """The JSON of an answer: data or error, and the request's id."""
    return F.to_json(F.struct(data.alias("data"), (error if error is not None else F.lit(None).cast("string")).alias("error"), F.struct(request_id.alias("request_id")).alias("meta")), {"ignoreNullFields": "false"})


def validation_details(problems: DataFrame) -> DataFrame:
    """Where a request is invalid and why, never the value that was sent."""
    return problems.select("request_id", F.transform("loc", lambda p: p.cast("string")).alias("loc"), F.col("message").alias("msg"), "type")


def latest(versions: DataFrame, key: str = "id") -> DataFrame:
    """The newest stored version of each row."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    return versions.withColumn("_n", n).where("_n = 1").drop("_n")
