"""Fetch results to extracted documents.

One pass over the fetches: a body reaches the parser only if its row can be parsed; other rows go
through with none. Workers hold a few bodies at a time, whatever the size of a batch.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import headers
from siftwell.functions import text as tx
from siftwell.functions.html import extract
from siftwell.session import spread

# Fixed values.
HTML_TYPES = ("text/html", "application/xhtml+xml")
VERSION = "1"
LINK = "array<struct<url:string,normalized_url:string,text:string,in_main_content:boolean>>"
PARTS = (
    "content_source string, title string, title_source string, text string, claimed_language string, language_source string, "
    f"links {LINK}, claimed_metadata map<string,string>, json_ld array<string>, stats map<string,int>, removed_chars map<string,int>, "
    "links_dropped map<string,int>, part_warnings array<string>, partial boolean, failed boolean"
)
_ARROW_LINK = pa.list_(pa.struct([("url", pa.string()), ("normalized_url", pa.string()), ("text", pa.string()), ("in_main_content", pa.bool_())]))
_COUNTS = pa.map_(pa.string(), pa.int32())
_ARROW = {
    "content_source": pa.string(), "title": pa.string(), "title_source": pa.string(), "text": pa.string(), "claimed_language": pa.string(),
    "language_source": pa.string(), "links": _ARROW_LINK, "claimed_metadata": pa.map_(pa.string(), pa.string()), "json_ld": pa.list_(pa.string()),
    "stats": _COUNTS, "removed_chars": _COUNTS, "links_dropped": _COUNTS, "part_warnings": pa.list_(pa.string()), "partial": pa.bool_(), "failed": pa.bool_(),
}
NOTHING = {
    "content_source": "NONE", "title": None, "title_source": "NONE", "text": "", "claimed_language": None, "language_source": "NONE", "links": [],
    "claimed_metadata": [], "json_ld": [], "stats": [], "removed_chars": [], "links_dropped": [], "part_warnings": [], "partial": False, "failed": False,
}
#: Bodies that a worker turns into Python strings at once.
BODIES = 32


def _parts(content: str | None, content_type: str, url: str, limits: dict | None) -> dict:
    if content is None:
        return NOTHING
    try:
        out = extract(content, content_type, url, limits)
    except Exception:  # noqa: BLE001  a page's failure is its status, whatever the page did
        return NOTHING | {"failed": True}
    metadata = out["metadata"]
    return {
        "content_source": out["content_source"],
        "title": out["title"],
        "title_source": out["title_source"],
        "text": out["text"],
        "claimed_language": out["language"],
        "language_source": out["language_source"],
        "links": out["links"],
        "claimed_metadata": [(k, v) for k, v in metadata.items() if k != "json_ld" and v is not None],
        "json_ld": metadata.get("json_ld", []),
        "stats": list(out["stats"].items()),
        "removed_chars": sorted(out["removed_chars"].items()),
        "links_dropped": sorted(out["links_dropped"].items()),
        "part_warnings": out["warnings"],
        "partial": out["partial"],
        "failed": False,
    }


def extract_documents(fetches: DataFrame, limits: dict | None = None) -> DataFrame:
    """One document per fetch, in all cases; ``fetches`` needs the columns used below.

    ``position, crawl_id, requested_url, final_url, status, content_type, charset, content,
    content_sha256`` and any others, which are carried along unless they clash.
    """
    ok = F.col("status") == "OK"
    supported = F.coalesce(F.col("content_type").isin(*HTML_TYPES, "text/plain"), F.lit(False))
    reason = F.when(~ok, "NOT_FETCHED").when(~supported, "UNSUPPORTED").when(F.col("content").isNull(), "FAILED")
    named = spread(fetches).withColumn("_reason", reason).withColumnRenamed("status", "fetch_status")
    keep = [c for c in named.columns if c not in ("content", "title", "_reason")]
    fit = F.col("_reason").isNull()
    warned = F.when(fit, headers.charset_warnings(F.col("content"), F.col("charset"))).otherwise(F.array().cast("array<string>"))
    inputs = named.select(*keep, "_reason", warned.alias("_warned"), F.when(fit, F.col("content")).alias("content"))
    width = len(keep) + 2
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema[:width]) + ", " + PARTS

    def run(batches):
        for whole in batches:
            at = {n: i for i, n in enumerate(whole.schema.names)}
            for first in range(0, whole.num_rows, BODIES):
                batch = whole.slice(first, BODIES)
                content, kind, final, asked = (batch.column(at[c]).to_pylist() for c in ("content", "content_type", "final_url", "requested_url"))
                rows = [_parts(c, k, f or a or "", limits) for c, k, f, a in zip(content, kind, final, asked, strict=True)]
                columns = [pa.array([r[n] for r in rows], t) for n, t in _ARROW.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), *columns], [*whole.schema.names[:width], *_ARROW])

    every = inputs.mapInArrow(run, schema)
    status = F.coalesce("_reason", F.when(F.col("failed"), "FAILED").when(F.col("partial"), "PARTIAL").when(F.col("text") == "", "EMPTY").otherwise("SUCCESS"))
    return every.select(
        *keep,
        F.sha2(F.concat_ws("|", F.coalesce("final_url", "requested_url"), F.col("position").cast("string")), 256).alias("document_id"),
        F.lit(VERSION).alias("extractor_version"),
        status.alias("status"),
        F.array_distinct(F.concat("_warned", "part_warnings")).alias("warnings"),
        F.when(status == "FAILED", F.struct(F.lit("EXTRACTION_FAILED").alias("code"), F.lit("extraction failed").alias("message"))).alias("error"),
        "content_source",
        "title",
        "title_source",
        "text",
        tx.char_count(F.col("text")).alias("char_count"),
        tx.word_count(F.col("text")).alias("word_count"),
        tx.text_hash(F.col("text")).alias("text_sha256"),
        "claimed_language",
        "language_source",
        "links",
        "claimed_metadata",
        "json_ld",
        "stats",
        "removed_chars",
        "links_dropped",
        F.lit("web_page").alias("kind"),
        F.lit("untrusted").alias("trust"),
    )


def links(documents: DataFrame) -> DataFrame:
    """Rows of links: ``position, ord, url, normalized_url, text, in_main_content``."""
    return documents.select("position", F.posexplode("links").alias("ord", "link")).select("position", "ord", "link.*")


def metadata_json(documents: DataFrame) -> DataFrame:
    return documents.select("position", F.to_json("claimed_metadata").alias("metadata"))


def fetches_from_pages(pages: DataFrame) -> DataFrame:
    """Replay: stored pages as successful fetches."""
    return pages.select(
        F.lit("replay").alias("job_id"),
        F.col("page_id").cast("int").alias("position"),
        F.sha2("url", 256).alias("crawl_id"),
        F.col("url").alias("requested_url"),
        F.col("url").alias("final_url"),
        F.lit("OK").alias("status"),
        F.lit("text/html").alias("content_type"),
        F.lit("utf-8").alias("charset"),
        F.col("html").alias("content"),
        F.sha2("html", 256).alias("content_sha256"),
    )

