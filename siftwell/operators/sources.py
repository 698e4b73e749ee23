"""Selected sources through fetch, extraction and grouping: slots, records, counters, views.

A source keeps its position from selection to view; joins by position are left joins from the
selection, so a source that was never fetched is a row all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import urls
from siftwell.operators import dedup
from siftwell.session import once

MAX_URLS = 30
TEXT_BUDGET = 30_000_000


def state(fetched: Column, extracted: Column, started: Column) -> Column:
    return F.when(extracted, "EXTRACTED").when(fetched, "FETCHED").when(started, "INTERRUPTED").otherwise("NOT_RUN")


def records(selection: DataFrame, fetches: DataFrame, documents: DataFrame, started: DataFrame | None = None, stop_reason: str | None = None) -> DataFrame:
    """One row per selected source (``job_id, position, result, providers, queries``)."""
    key = ["job_id", "position"]
    more = [c for c in ("http_status", "timeout_kind") if c in fetches.columns]
    f = fetches.select(*key, F.col("status").alias("fetch_status"), F.col("final_url").alias("final_url"), *more, F.lit(True).alias("_f"))
    d = documents.select(*key, "document_id", F.col("status").alias("document_status"), F.col("warnings").alias("document_warnings"), F.char_length("text").alias("text_chars"), F.lit(True).alias("_d"))
    rows = selection.join(f, key, "left").join(d, key, "left")
    if started is not None:
        rows = rows.join(started.select(*key).distinct().withColumn("_s", F.lit(True)), key, "left")
    else:
        rows = rows.withColumn("_s", F.lit(False))
    found = state(F.coalesce("_f", F.lit(False)), F.coalesce("_d", F.lit(False)), F.coalesce("_s", F.lit(False)))
    return rows.select(
        *key,
        F.col("result.url").alias("url"),
        F.col("result.original_url").alias("original_url"),
        "providers",
        "queries",
        found.alias("state"),
        F.when(found != "EXTRACTED", F.lit(stop_reason)).alias("reason"),
        "fetch_status",
        *(c if c in more else F.lit(None).cast(t).alias(c) for c, t in (("http_status", "int"), ("timeout_kind", "string"))),
        "final_url",
        "document_id",
        "document_status",
        F.coalesce("document_warnings", F.array().cast("array<string>")).alias("document_warnings"),
        F.coalesce("text_chars", F.lit(0)).alias("text_chars"),
    )


def join_mismatches(fetches: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose fetch at that position has another crawl id; a sound run has none."""
    f = fetches.select("job_id", "position", F.col("crawl_id").alias("_fetch_crawl"))
    return documents.join(f, ["job_id", "position"], "left").where(~F.col("crawl_id").eqNullSafe(F.col("_fetch_crawl"))).select("job_id", "position", "crawl_id", "_fetch_crawl")


def dense_positions(documents: DataFrame) -> DataFrame:
    """Documents with ``dense``, their place among the job's documents."""
    return documents.withColumn("dense", F.row_number().over(Window.partitionBy("job_id").orderBy("position")) - 1)


def _histogram(rows: DataFrame, column: str, name: str) -> DataFrame:
    counted = rows.groupBy("job_id", column).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def timeout_kind(requested_url: Column, final_url: Column, chain: Column, capped: Column) -> Column:
    """Why a fetch timed out: it left its host, its time was cut by the deadline, or other."""
    hosts = F.array_union(F.transform(chain, lambda h: urls.host(h["url"])), F.array_compact(F.transform(chain, lambda h: F.when(h["location"].rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), urls.host(h["location"])))))
    every = F.when(final_url.isNotNull(), F.array_union(hosts, F.array(urls.host(final_url)))).otherwise(hosts)
    away = F.size(F.array_except(every, F.array(urls.host(requested_url)))) > 0
    return F.when(away, "cross_host_redirect").when(capped, "deadline_capped").otherwise("other")


def crawl_stats(recs: DataFrame, waits: DataFrame | None = None, not_selected: DataFrame | None = None, deadline_hit: DataFrame | None = None) -> DataFrame:
    """The counters of a crawl stage per job, from ``records``.

    ``waits`` (``job_id, wait_ms``: one row for each admitted fetch), ``not_selected`` (``job_id,
    not_selected``) and ``deadline_hit`` (``job_id`` of the jobs that met it) add what records lack.
    """
    s, fs, kind = F.col("state"), F.col("fetch_status"), F.col("timeout_kind")
    base = recs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("selected"),
        F.count(fs).alias("fetched"),
        F.count_if(fs == "OK").alias("fetch_ok"),
        F.count_if(fs != "OK").alias("fetch_failed"),
        F.count_if(fs == "FETCH_TIMEOUT").alias("fetch_timeout"),
        F.count_if(kind == "cross_host_redirect").alias("fetch_timeout_cross_host_redirect"),
        F.count_if(kind == "deadline_capped").alias("fetch_timeout_deadline_capped"),
        F.count_if(kind == "other").alias("fetch_timeout_other"),
        F.count("document_id").alias("extracted"),
        F.count_if(s == "NOT_RUN").alias("not_run"),
        F.count_if(s == "INTERRUPTED").alias("interrupted"),
        F.count_if(s == "FETCHED").alias("fetched_not_extracted"),
        F.sum("text_chars").alias("text_chars"),
    )
    base = base.join(_histogram(recs.where(fs.isNotNull()), "fetch_status", "fetch_status_counts"), "job_id", "left")
    base = base.join(_histogram(recs.where("document_status is not null"), "document_status", "extraction_status_counts"), "job_id", "left")
    none = F.create_map().cast("map<string,int>")
    base = base.withColumns({c: F.coalesce(c, none) for c in ("fetch_status_counts", "extraction_status_counts")})
    numbers = {"admitted": F.count(F.lit(1)), "admission_wait_ms_total": F.sum("wait_ms"), "admission_wait_ms_max": F.max("wait_ms")}
    if waits is not None:
        base = base.join(waits.groupBy("job_id").agg(*(v.alias(k) for k, v in numbers.items())), "job_id", "left")
    else:
        base = base.withColumns(dict.fromkeys(numbers, F.lit(0)))
    base = base.join(not_selected, "job_id", "left") if not_selected is not None else base.withColumn("not_selected", F.lit(0))
    late = deadline_hit.select("job_id").distinct().withColumn("deadline_hit", F.lit(True)) if deadline_hit is not None else None
    base = base.join(late, "job_id", "left") if late is not None else base.withColumn("deadline_hit", F.lit(False))
    return base.withColumns({**{c: F.coalesce(c, F.lit(0)).cast("long") for c in (*numbers, "not_selected")}, "deadline_hit": F.coalesce("deadline_hit", F.lit(False))})


def pipeline_counts(stats: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What a job's progress shows of its crawl: ``urls_total, urls_done, fetch_failed, documents, groups``."""
    counted = stats.select(
        "job_id", F.col("selected").alias("urls_total"), F.col("fetched").alias("urls_done"), "fetch_failed", F.col("extracted").alias("documents")
    )
    if found is None:
        return counted.withColumn("groups", F.lit(0).cast("long"))
    per_job = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("groups"))
    return counted.join(per_job, "job_id", "left").na.fill(0, ["groups"])


def usable(documents: DataFrame) -> DataFrame:
    return documents.groupBy("job_id").agg(F.count_if(F.col("status").isin("SUCCESS", "PARTIAL")).alias("usable"))


def over_budget(documents: DataFrame, budget: int = TEXT_BUDGET) -> DataFrame:
    """Jobs whose texts exceed the budget, with the position at which they do."""
    so_far = F.sum(F.char_length("text")).over(Window.partitionBy("job_id").orderBy("position"))
    rows = documents.select("job_id", "position", so_far.alias("chars")).where(F.col("chars") > budget)
    return rows.groupBy("job_id").agg(F.min("position").alias("position"), F.max("chars").alias("chars"))


def source_views(recs: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with the group key of each level that the source is in."""
    members = dedup.group_members(documents, ["job_id"])
    keys = members.groupBy("job_id", "position").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "key")))).alias("group_keys"))
    empty = F.create_map().cast("map<string,string>")
    return recs.join(keys, ["job_id", "position"], "left").withColumn("group_keys", F.coalesce("group_keys", empty))


def group_views(documents: DataFrame) -> DataFrame:
    """Groups of each job's documents as source positions.

    Grouping numbers the documents it is given; a job's sources without a document leave gaps, so
    members are mapped back by a join on that number.
    """
    dense = dense_positions(documents)
    places = dense.select("job_id", "dense", F.col("position").alias("source"))
    found = dedup.groups(dense.withColumn("position", F.col("dense")), ["job_id"])
    members = found.select("job_id", "level", "key", "warnings", F.explode("members").alias("dense")).join(places, ["job_id", "dense"])
    return members.groupBy("job_id", "level", "key").agg(
        F.min("source").alias("representative"), F.array_sort(F.collect_list("source")).alias("members"), F.first("warnings").alias("warnings")
    )


def results_json(recs: DataFrame) -> DataFrame:
    """One JSON document of sources per job."""
    fields = [c for c in recs.columns if c != "job_id"]
    return recs.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("sources"))


def run_replay(selection: DataFrame, fetches: DataFrame, limits: dict | None = None) -> dict[str, DataFrame]:
    """Selection and recorded fetches to documents, records and groups.

    Documents are extracted once; the other tables are lazy plans over them.
    """
    from siftwell.operators.extract import extract_documents

    wanted = fetches.join(selection.select("job_id", "position"), ["job_id", "position"], "left_semi")
    documents = once(extract_documents(wanted, limits))
    recs = records(selection, wanted, documents)
    return {
        "documents": documents, "records": recs, "stats": crawl_stats(recs), "groups": dedup.groups(documents, ["job_id"]),
        "views": source_views(recs, documents), "group_views": group_views(documents), "exclusions": dedup.exclusions(documents, ["job_id"]), "errors": dedup.errors(documents, ["job_id"]),
    }
