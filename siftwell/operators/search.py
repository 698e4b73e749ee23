"""Search hits of several queries and providers: merge, fallback, breaker and status operators.

Order is data: ``query_dim`` and ``provider_dim`` give each name its place, and every merge sorts
by (query, provider, rank, arrival) before it takes a first value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = 2**31 - 1


def _ordered(hits: DataFrame, queries: DataFrame, providers: DataFrame) -> DataFrame:
    """Hits with ``q, p``; names that the dimensions lack come last. The dimensions are small by nature."""
    q = queries.select("request_id", F.col("name").alias("query"), F.col("ord").alias("q"))
    p = providers.select("request_id", F.col("name").alias("source"), F.col("ord").alias("p"))
    joined = hits.join(q, ["request_id", "query"], "left").join(p, ["request_id", "source"], "left")
    return joined.withColumns({"q": F.coalesce("q", F.lit(LAST)), "p": F.coalesce("p", F.lit(LAST))})


def merge(hits: DataFrame, queries: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per request and URL, by first appearance: ``position, result, providers, queries, occurrences``."""
    own = [c for c in hits.columns if c not in ("request_id", "idx")]
    # A MAP cannot be compared, so the order key is a struct of its own in front.
    row = F.struct(F.struct("q", "p", "rank", "idx").alias("k"), F.col("query").alias("query"), F.col("source").alias("source"))
    order = F.struct("q", "p", "rank", "idx")
    grouped = _ordered(hits, queries, providers).groupBy("request_id", "url").agg(
        F.array_sort(F.collect_list(row)).alias("h"), F.min_by(F.struct(*own), order).alias("result"), F.min(order).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("first")) - 1
    return grouped.select(
        "request_id",
        place.alias("position"),
        "result",
        F.array_distinct(F.transform("h", lambda x: x["source"])).alias("providers"),
        F.array_distinct(F.transform("h", lambda x: x["query"])).alias("queries"),
        F.size("h").alias("occurrences"),
    )


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each URL in arrival order."""
    n = F.row_number().over(Window.partitionBy("request_id", "url").orderBy("idx"))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")


def duplicate_count(hits: DataFrame) -> DataFrame:
    per_url = hits.groupBy("request_id", "url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("request_id").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def select_prefix(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` results of each request."""
    return results.where(F.col("position") < most)


def not_selected(results: DataFrame, most: int) -> DataFrame:
    return results.groupBy("request_id").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("not_selected"))


def run_status(calls: Column, ok: Column, failed: Column, attempts: Column) -> Column:
    return (
        F.when(attempts == 0, "NOT_CALLED")
        .when(calls == 0, "SKIPPED")
        .when(failed == calls, "FAILED")
        .when(failed > 0, "PARTIAL")
        .when(ok > 0, "SUCCESS")
        .otherwise("EMPTY")
    )


def provider_status(attempts: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per provider of each request, also for those never called."""
    dim = providers.select("request_id", F.col("name").alias("provider"), "ord")
    s = F.col("status")
    counted = attempts.groupBy("request_id", "provider").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(s == "OK").alias("succeeded"),
        F.count_if(s == "EMPTY").alias("empty"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "SKIPPED_CIRCUIT_OPEN").alias("skipped"),
        F.sum("result_count").alias("result_count"),
        F.sum("duration_ms").alias("duration_ms"),
        F.array_sort(F.collect_set("error.category")).alias("error_categories"),
    )
    found = dim.join(counted, ["request_id", "provider"], "left")
    numbers = ("attempts", "succeeded", "empty", "failed", "skipped", "result_count", "duration_ms")
    found = found.na.fill(0, list(numbers)).withColumn("calls", F.col("succeeded") + F.col("empty") + F.col("failed"))
    return found.select(
        "request_id",
        "provider",
        "ord",
        run_status(F.col("calls"), F.col("succeeded"), F.col("failed"), F.col("attempts")).alias("status"),
        "calls",
        *numbers[1:],
        F.coalesce("error_categories", F.array().cast("array<string>")).alias("error_categories"),
    )


def fallback(attempts: DataFrame, queries: DataFrame, providers: DataFrame) -> DataFrame:
    """Attempts that a fallback run would have made: per query, providers in order up to the first with hits."""
    p = providers.select("request_id", F.col("name").alias("provider"), F.col("ord").alias("p"))
    named = attempts.join(p, ["request_id", "provider"])
    chosen = named.groupBy("request_id", "query").agg(F.min(F.when(F.col("result_count") > 0, F.col("p"))).alias("chosen"))
    return named.join(chosen, ["request_id", "query"]).where("chosen is null or p <= chosen").drop("p", "chosen")


def fanout(attempts: DataFrame, providers: DataFrame) -> DataFrame:
    """All attempts, with each provider's place."""
    p = providers.select("request_id", F.col("name").alias("provider"), F.col("ord").alias("p"))
    return attempts.join(p, ["request_id", "provider"], "left")


def breaker(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """Attempts with ``open_before``: whether ``threshold`` failures in a row stand before it.

    A skipped call leaves the run of failures as it is; a success or an empty answer ends it. The
    fold is a gaps-and-islands window, so it streams in order of ``idx``.
    """
    order = Window.partitionBy("request_id", "provider").orderBy("idx")
    ends = F.sum(F.when(F.col("status").isin("OK", "EMPTY"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = attempts.withColumn("_island", ends)
    inside = Window.partitionBy("request_id", "provider", "_island").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = islands.withColumn("_run", F.sum(F.when(F.col("status") == "FAILED", 1).otherwise(0)).over(inside))
    before = F.coalesce(F.lag("_run").over(order), F.lit(0))
    return runs.withColumn("open_before", before >= threshold).drop("_island", "_run")


def all_failed(attempts: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests without hits in which every attempt failed or was skipped."""
    bad = attempts.groupBy("request_id").agg(F.every(F.col("status").isin("FAILED", "SKIPPED_CIRCUIT_OPEN")).alias("bad")).where("bad")
    return bad.select("request_id").join(hits.select("request_id").distinct(), "request_id", "left_anti")


def attempt_errors(attempts: DataFrame) -> DataFrame:
    return attempts.where("error is not null").orderBy("request_id", "idx").select("request_id", "idx", "error.*")


def provider_errors(attempts: DataFrame) -> DataFrame:
    """The first error of each (provider, code, category)."""
    e = attempts.where("error is not null").select("request_id", "idx", "provider", F.col("error.code").alias("code"), F.col("error.category").alias("category"), F.col("error.retryable").alias("retryable"))
    n = F.row_number().over(Window.partitionBy("request_id", "provider", "code", "category").orderBy("idx"))
    return e.withColumn("_n", n).where("_n = 1").drop("_n")


def query_outcomes(planned: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """``job_id, query, status``: COVERED if a call answered (be it with nothing), FAILED if every one failed or was skipped.

    A query without recorded attempts was answered.
    """
    if attempts is None:
        return planned.withColumn("status", F.lit("COVERED"))
    per = attempts.groupBy(F.col("request_id").alias("job_id"), "query").agg(F.bool_or(F.col("status").isin("OK", "EMPTY")).alias("_ok"))
    return planned.join(per, ["job_id", "query"], "left").select("job_id", "query", F.when(F.coalesce("_ok", F.lit(True)), "COVERED").otherwise("FAILED").alias("status"))


def coverage(planned: DataFrame, outcomes: DataFrame, stopped: bool) -> DataFrame:
    """Every planned query with its outcome; missing ones are INTERRUPTED or NOT_RUN after a stop.

    ``planned``: ``job_id, index, query``; ``outcomes``: ``job_id, index, status, started``.
    """
    joined = planned.join(outcomes, ["job_id", "index"], "left")
    gap = F.when(F.coalesce("started", F.lit(False)), "INTERRUPTED").otherwise("NOT_RUN") if stopped else F.lit(None)
    return joined.withColumn("status", F.coalesce("status", gap)).where("status is not null")


def coverage_summary(outcomes: DataFrame) -> DataFrame:
    covered, total = F.count_if(F.col("status") == "COVERED"), F.count(F.lit(1))
    return outcomes.groupBy("job_id").agg(
        covered.alias("covered"), total.alias("planned"), F.when(covered == total, "COMPLETE").when(covered > 0, "PARTIAL").otherwise("NONE").alias("coverage")
    )
