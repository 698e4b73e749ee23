"""Exact-duplicate groups of documents at three independent levels, without dropping any input.

Levels: L1 by source identity, L2 by raw body hash, L3 by a text hash that is recomputed and
must match. Texts are read and hashed once; what is shuffled are narrow rows without text. A
group's size, representative and warnings are partial aggregates, so a group of any size costs
its tasks one row each. Members are rows (``group_members``); as arrays they come only for
groups of at most ``LISTED`` members, whose size was counted before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.functions import urls
from siftwell.schemas import ERROR_REASONS, LEVELS
from siftwell.session import once

# Fixed value: the longest text that an extractor may give.
MAX_TEXT = 10_000_000
#: The largest group whose members are listed in its row as well.
LISTED = 10_000
NARROW = ("position", "source_identity", "host", "content_sha256", "text_sha256", "fetch_status")


def _text_reason(status: Column, text: Column, given: Column) -> Column:
    return (
        F.when(~status.eqNullSafe("SUCCESS"), "NOT_SUCCESS")
        .when(F.coalesce(text, F.lit("")) == "", F.when(given.isNotNull(), "TEXT_HASH_MISMATCH").otherwise("EMPTY_TEXT"))
        .when(F.char_length(text) > MAX_TEXT, "TEXT_TOO_LONG")
        .when(given.isNull(), "MISSING_TEXT_HASH")
        .when(F.sha2(text, 256) != given, "TEXT_HASH_MISMATCH")
    )


def keyed(documents: DataFrame, levels: tuple[str, ...] = LEVELS, sources: bool = True) -> DataFrame:
    """Narrow rows: identity, host, a struct ``key, reason`` for each level, and no text.

    Without ``sources`` (and L1) no URL is looked at, and identity and host are null.
    """
    wanted = sources or "L1" in levels
    identity = urls.source_identity(F.col("final_url"), F.col("requested_url")) if wanted else F.lit(None).cast("string")
    rows = documents.withColumn("source_identity", identity)
    sha = F.col("content_sha256")
    reasons = {
        "L1": F.when(F.col("source_identity").isNull(), "INVALID_SOURCE_URL"),
        "L2": F.when(sha.isNull(), "NO_CONTENT_HASH").when(~tx.is_sha256(sha), "INVALID_CONTENT_HASH"),
        "L3": _text_reason(F.col("status"), F.col("text"), F.col("text_sha256")),
    }
    # The reasons are columns of their own first, so a text is hashed once though key and reason need it.
    rows = rows.withColumns({f"_{level}": reasons[level] for level in levels}).drop("text")
    keys = {"L1": ("L1:url:", "source_identity"), "L2": ("L2:sha256:", "content_sha256"), "L3": ("L3:sha256:", "text_sha256")}
    for level in levels:
        prefix, column = keys[level]
        why = F.col(f"_{level}")
        rows = rows.withColumn(level, F.struct(F.when(why.isNull(), F.concat(F.lit(prefix), column)).alias("key"), why.alias("reason"))).drop(f"_{level}")
    return rows.withColumn("host", urls.host(F.col("source_identity")))


def _exploded(rows: DataFrame, scope: list[str], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    each = F.array(*(F.struct(F.lit(name).alias("level"), F.col(f"{name}.key").alias("key"), F.col(f"{name}.reason").alias("reason")) for name in levels))
    return rows.select(*scope, *NARROW, F.explode(each).alias("k")).select(*scope, *NARROW, "k.*")


def _narrow(documents: DataFrame, scope: list[str], levels: tuple[str, ...] = LEVELS, sources: bool = True) -> DataFrame:
    """The rows of ``keyed`` that later steps read more than once, without any other column."""
    return once(keyed(documents, levels, sources).select(*scope, *NARROW, *levels))


def _differ(column: str, nulls: bool) -> Column:
    """Whether a group has several values: extremes of two 64-bit hashes, which aggregate in place."""
    hashes = [f"xxhash64({seed}, {column})" if nulls else f"if({column} is null, null, xxhash64({seed}, {column}))" for seed in (1, 2)]
    return F.expr(" or ".join(f"coalesce(max({h}) <> min({h}), false)" for h in hashes))


def _heads(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each group: size, representative and what its warnings depend on."""
    return (
        rows.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("position").alias("representative"),
            _differ("content_sha256", False).alias("_contents"),
            _differ("fetch_status", True).alias("_fetches"),
            _differ("text_sha256", True).alias("_texts"),
            _differ("source_identity", False).alias("_sources"),
        )
        .where("n >= 2")
    )


#: Warning, level test and flag, in order.
_WARNINGS = (
    ("SOURCE_CONTENT_DIFFERS", "level = 'L1'", "_contents"),
    ("MIXED_FETCH_STATUS", "level = 'L1'", "_fetches"),
    ("RAW_DUPLICATE_TEXT_DIFFERS", "level = 'L2'", "_texts"),
    ("CROSS_SOURCE_DUPLICATE", "level <> 'L1'", "_sources"),
)


def _warnings() -> Column:
    return F.expr(f"array_compact(array({', '.join(f"if({test} and {flag}, '{name}', null)" for name, test, flag in _WARNINGS)}))")


def _distinct(members: Column, field: str) -> Column:
    """Distinct values in member order, nulls dropped."""
    return F.array_compact(F.array_distinct(F.transform(members, lambda m: m[field])))


def groups(documents: DataFrame, scope: list[str] | None = None, levels: tuple[str, ...] = LEVELS, sources: bool = True, listed: int = LISTED) -> DataFrame:
    """``level, key, n, representative, members, source_identities, hosts, warnings`` per group.

    The three arrays are null for a group of more than ``listed`` members: ``group_members`` has
    its rows. Without ``sources`` there are no identities, hosts and warnings about them.
    """
    key = [*(scope or []), "level", "key"]
    rows = _exploded(_narrow(documents, scope or [], levels, sources), scope or [], levels).where("key is not null")
    heads = _heads(rows, key)
    flags = ("representative", "_contents", "_fetches", "_texts", "_sources")
    member = F.when(F.col("n") <= listed, F.struct("position", "source_identity", "host"))
    found = rows.select(*key, "position", "source_identity", "host").join(heads, key)
    found = found.groupBy(*key).agg(F.first("n").alias("n"), *(F.first(c).alias(c) for c in flags), F.array_sort(F.collect_list(member)).alias("m"))
    m = F.when(F.col("n") <= listed, F.col("m"))
    return found.select(
        *key,
        "n",
        "representative",
        F.transform(m, lambda x: x["position"]).alias("members"),
        _distinct(m, "source_identity").alias("source_identities"),
        _distinct(m, "host").alias("hosts"),
        _warnings().alias("warnings"),
    )


def ordered(found: DataFrame, scope: list[str]) -> DataFrame:
    """Groups with ``ord``, their place in their scope: by level, then by first member."""
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("level", "representative")) - 1
    return found.withColumn("ord", place)


def group_members(documents: DataFrame, scope: list[str] | None = None, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The same groups as rows ``level, key, position, representative``: no arrays, any group size."""
    key = [*(scope or []), "level", "key"]
    rows = _exploded(_narrow(documents, scope or [], levels), scope or [], levels).where("key is not null").select(*key, "position")
    heads = rows.groupBy(*key).agg(F.min("position").alias("representative"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rows.join(heads.drop("n"), key).select(*key, "position", "representative")


def exclusions(documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``position, level, reason`` for every level that a document has no key at."""
    scope = scope or []
    return _exploded(keyed(documents, sources=False), scope).where("key is null").select(*scope, "position", "level", "reason")


def errors(documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Exclusions that break a contract: ``position, level, code``."""
    found = exclusions(documents, scope).where(F.col("reason").isin(*ERROR_REASONS))
    return found.withColumnRenamed("reason", "code")


def refs(documents: DataFrame) -> DataFrame:
    """One reference per input, without text."""
    wanted = (
        "job_id", "position", "document_id", "crawl_id", "source_identity", "host", "requested_url", "final_url", "status",
        "fetch_status", "warnings", "content_sha256", "text_sha256", "kind", "trust", "search_source",
    )
    rows = keyed(documents)
    return rows.select(*(c for c in wanted if c in rows.columns))


def stats(documents: DataFrame) -> DataFrame:
    """Per level: groups, grouped documents, exclusions and errors; levels without any have zeros.

    One aggregate per key first, then one per level, over the same narrow rows.
    """
    rows = _exploded(keyed(documents, sources=False), [])
    broken = F.col("reason").isin(*ERROR_REASONS)
    per_key = rows.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("excluded"), F.count_if(broken).alias("broken"))
    real = F.col("key").isNotNull() & (F.col("n") >= 2)
    seen = per_key.groupBy("level").agg(
        F.sum("n").alias("documents"),
        F.count_if(real).alias("groups"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("grouped_documents"),
        F.sum("excluded").alias("exclusions"),
        F.sum("broken").alias("errors"),
    )
    levels = documents.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    return levels.join(F.broadcast(seen), "level", "left").na.fill(0).select("level", "documents", "groups", "grouped_documents", "exclusions", "errors")


def require_columns(documents: DataFrame) -> None:
    """Raise TypeError before any work if the input is not a table of documents."""
    missing = {"position", "requested_url", "final_url", "status", "fetch_status", "content_sha256", "text", "text_sha256"} - set(documents.columns)
    if missing:
        raise TypeError(f"not a table of documents: {sorted(missing)} missing")


def document_set(documents: DataFrame, scope: list[str] | None = None) -> dict[str, DataFrame]:
    """All five tables of one grouping."""
    require_columns(documents)
    return {"refs": refs(documents), "groups": groups(documents, scope), "exclusions": exclusions(documents, scope), "errors": errors(documents, scope), "stats": stats(documents)}
