"""Search providers: recorded or live JSON to hits.

Parsing is Catalyst (``from_json``, ``posexplode``). ``SearchSource`` is a Python data source for
live calls; its request builder and transport are parameters, so tests and replays use none.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.functions import headers
from siftwell.functions.urls import normalized

#: Name -> endpoint, most results, names of its settings, request builder and parser; see ``register``.
PROVIDERS: dict[str, dict] = {}
# Field names of the two services.
DATE_KEYS = ("article:published_time", "og:published_time", "datepublished")
PERPLEXITY_JSON = "id string, results array<struct<title:string,url:string,snippet:string,date:string,last_updated:string>>"
GOOGLE_JSON = (
    "items array<struct<title:string,link:string,snippet:string,displayLink:string,pagemap:struct<metatags:array<map<string,string>>>>>"
)


def provider_status(settings: dict[str, str | None], names: tuple[str, ...] = ("perplexity", "google")) -> list[tuple[str, str, list[str]]]:
    """(name, CONFIGURED / REQUIRES_CONFIGURATION / UNKNOWN_PROVIDER, missing settings)."""
    rows = []
    for name in names:
        if name not in PROVIDERS:
            rows.append((name, "UNKNOWN_PROVIDER", []))
            continue
        missing = [s.upper() for s in PROVIDERS[name]["settings"] if not settings.get(s)]
        rows.append((name, "REQUIRES_CONFIGURATION" if missing else "CONFIGURED", missing))
    return rows


def configured(settings: dict[str, str | None], names: tuple[str, ...] = ("perplexity", "google")) -> list[str]:
    """Providers that can be called, in order; an error if there is none."""
    ready = [name for name, status, _ in provider_status(settings, names) if status == "CONFIGURED"]
    if not ready:
        raise ValueError("no search provider is configured")
    return ready


def request_for(name: str, settings: dict, query: str, most: int = 10, language: str | None = None, country: str | None = None) -> tuple[str, str, bytes | None, dict]:
    """(method, url, body, headers)."""
    provider = PROVIDERS[name]
    method, body, head, pairs = provider["build"](settings, query, min(most, provider["most"]), language, country)
    url = provider["endpoint"] + (f"?{urllib.parse.urlencode(pairs)}" if pairs else "")
    return method, url, None if body is None else json.dumps(body).encode(), head


def response_error(http_status: Column, body: Column) -> Column:
    """``struct(code, category, retryable)`` of a response that is not an answer, else null."""
    def error(code: str, category: str, retryable: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(retryable).alias("retryable"))

    return (
        F.when(http_status.isin(401, 403), error("PROVIDER_ERROR", "AUTH_ERROR", False))
        .when(http_status == 429, error("PROVIDER_RATE_LIMITED", "RATE_LIMITED", True))
        .when(http_status >= 500, error("PROVIDER_UNAVAILABLE", "PROVIDER_UNAVAILABLE", True))
        .when(http_status >= 400, error("PROVIDER_ERROR", "INVALID_REQUEST", False))
        .when((http_status < 200) | (http_status >= 300), error("PROVIDER_ERROR", "INVALID_RESPONSE", False))
        .when(F.try_parse_json(body).isNull(), error("PROVIDER_ERROR", "INVALID_RESPONSE", False))
    )


def _hits(rows: DataFrame, source: str, title: Column, link: Column, snippet: Column, date: Column, metadata: Column) -> DataFrame:
    """Invalid URLs go, ranks stay."""
    out = rows.select(
        "request_id",
        "query",
        F.trim(title).alias("title"),
        normalized(link).alias("url"),
        link.alias("original_url"),
        F.nullif(snippet, F.lit("")).alias("snippet"),
        F.lit(source).alias("source"),
        headers.native_date(date).alias("published_at"),
        (F.col("place") + 1).alias("rank"),
        metadata.alias("metadata"),
    )
    return out.where("url is not null")


def _entries(**fields: Column) -> Column:
    kept = F.array_compact(F.array(*(F.when(v.isNotNull() & (v != ""), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fields.items())))
    return F.map_from_entries(kept)


def perplexity_hits(responses: DataFrame) -> DataFrame:
    """``request_id, query, body`` to hits."""
    parsed = responses.withColumn("p", F.from_json("body", PERPLEXITY_JSON))
    rows = parsed.select("request_id", "query", F.col("p.id").alias("id"), F.posexplode("p.results").alias("place", "r"))
    return _hits(
        rows, "perplexity", F.col("r.title"), F.col("r.url"), F.col("r.snippet"), F.col("r.date"), _entries(provider_request_id=F.col("id"), last_updated=F.col("r.last_updated"))
    )


def google_date(metatags: Column) -> Column:
    """The first non-blank date over the ordered tag maps and keys."""
    found = F.flatten(F.transform(metatags, lambda m: F.array(*(F.try_element_at(m, F.lit(k)) for k in DATE_KEYS))))
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(1))


def google_hits(responses: DataFrame) -> DataFrame:
    parsed = responses.withColumn("p", F.from_json("body", GOOGLE_JSON))
    rows = parsed.select("request_id", "query", F.posexplode("p.items").alias("place", "r"))
    return _hits(rows, "google", F.col("r.title"), F.col("r.link"), F.col("r.snippet"), google_date(F.col("r.pagemap.metatags")), _entries(display_link=F.col("r.displayLink")))


def http_call(method: str, url: str, body: bytes | None, head: dict, timeout_s: float) -> tuple[int | None, str | None, str | None]:
    """(status, text, transport error). The text of an error never holds the request."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, head, method=method), timeout=timeout_s) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, None, None
    except TimeoutError:
        return None, None, "TIMEOUT"
    except (urllib.error.URLError, OSError):
        return None, None, "NETWORK_ERROR"


def transport_error(http_status: int | None, body: str | None, transport: str | None) -> tuple[str, str, bool] | None:
    """(code, category, retryable) of a call that gave no answer, as ``response_error`` has it."""
    if transport:
        return ("PROVIDER_TIMEOUT" if transport == "TIMEOUT" else "PROVIDER_UNAVAILABLE", transport, True)
    if http_status in (401, 403):
        return ("PROVIDER_ERROR", "AUTH_ERROR", False)
    if http_status == 429:
        return ("PROVIDER_RATE_LIMITED", "RATE_LIMITED", True)
    if http_status >= 500:
        return ("PROVIDER_UNAVAILABLE", "PROVIDER_UNAVAILABLE", True)
    if http_status >= 400:
        return ("PROVIDER_ERROR", "INVALID_REQUEST", False)
    try:
        good = 200 <= http_status < 300 and isinstance(json.loads(body or ""), dict)
    except ValueError:
        good = False
    return None if good else ("PROVIDER_ERROR", "INVALID_RESPONSE", False)


def bounded(call, timeout_s: float):
    """``call()``, or a timeout after ``timeout_s`` of wall-clock time, whatever the call waits for."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout_s)
    except TimeoutError:
        return None, None, "TIMEOUT"
    finally:
        pool.shutdown(wait=False)


def call_with_retry(call, retries: int = 1, base_s: float = 1.0, timeout_s: float = 15.0, sleep=time.sleep, clock=time.monotonic) -> dict:
    """One attempt of a provider: the call, and again while its error may pass and retries are left."""
    started, tries = clock(), 0
    while True:
        tries += 1
        status, body, transport = bounded(call, timeout_s)
        error = transport_error(status, body, transport)
        if error is None or not error[2] or tries > retries:
            break
        sleep(min(base_s * 2.0 ** (tries - 1), headers.MOST_BACKOFF))
    found = len(next((v for k in ("results", "items") if isinstance(v := json.loads(body).get(k), list)), [])) if error is None else 0
    outcome = "FAILED" if error else "OK" if found else "EMPTY"
    return {"status": outcome, "http_status": status, "body": body, "tries": tries, "duration_ms": int((clock() - started) * 1000), "result_count": found, "error": error}


class SearchReader(DataSourceReader):
    """One partition a query and provider; each is one attempt, with its retries."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self):
        queries = json.loads(self.options["queries"])
        names = self.options.get("providers", ",".join(PROVIDERS)).split(",")
        return [InputPartition((i, q, n)) for i, q in enumerate(queries) for n in names]

    def read(self, partition):
        i, query, name = partition.value
        o = self.options
        method, url, body, head = request_for(name, o, query, int(o.get("max_results", 10)), o.get("language"), o.get("country"))
        url, timeout_s = o.get(f"{name}_endpoint", url), float(o.get("timeout_s", 15))
        got = call_with_retry(lambda: http_call(method, url, body, head, timeout_s), int(o.get("max_retries", 1)), float(o.get("backoff_s", 1)), timeout_s)
        code, category, retryable = got["error"] or (None, None, None)
        yield (o.get("request_id", ""), i, query, name, got["status"], got["http_status"], got["body"], got["tries"], got["duration_ms"], got["result_count"], code, category, retryable)


class SearchSource(DataSource):
    """``spark.read.format("siftwell_search")``: one attempt per query and provider, with the answer."""

    @classmethod
    def name(cls) -> str:
        return "siftwell_search"

    def schema(self) -> str:
        return (
            "request_id string, query_index int, query string, provider string, status string, http_status int, body string, tries int, duration_ms int, "
            "result_count int, error_code string, error_category string, error_retryable boolean"
        )

    def reader(self, schema):
        return SearchReader(self.options)


def answers_to_hits(answers: DataFrame) -> DataFrame:
    """The hits of a search's attempts, by each provider's own parser."""
    found = [PROVIDERS[name]["parse"](answers.where((F.col("provider") == name) & F.col("status").isin("OK", "EMPTY"))) for name in PROVIDERS]
    return reduce(DataFrame.unionByName, found)


def attempts_of(answers: DataFrame) -> DataFrame:
    """A search's attempts in the form of the status operators."""
    error = F.struct("provider", F.col("error_code").alias("code"), F.col("error_category").alias("category"), F.col("error_retryable").alias("retryable"))
    place = (F.row_number().over(Window.partitionBy("request_id").orderBy("query_index", "provider")) - 1).alias("idx")
    return answers.select("request_id", place, "provider", "query", "status", "result_count", "duration_ms", "tries", F.when(F.col("error_code").isNotNull(), error).alias("error"))


def register(name: str, endpoint: str, settings: tuple[str, ...], most: int, build, parse) -> None:
    """Add a provider: ``build(settings, query, most, language, country)`` gives (method, body, headers, query pairs),
    ``parse(responses)`` its hits.
    """
    PROVIDERS[name] = {"endpoint": endpoint, "most": most, "settings": settings, "build": build, "parse": parse}


def _perplexity_request(settings, query, most, language, country):
    wanted = {"country": country, "search_language_filter": [language] if language else None}
    body = {"query": query, "max_results": most} | {k: v for k, v in wanted.items() if v}
    return "POST", body, {"Authorization": f"Bearer {settings['perplexity_api_key']}", "Content-Type": "application/json"}, None


def _google_request(settings, query, most, language, country):
    wanted = {"gl": country.lower() if country else None, "hl": language}
    pairs = {"key": settings["google_api_key"], "cx": settings["google_cse_id"], "q": query, "num": most}
    return "GET", None, {}, pairs | {k: v for k, v in wanted.items() if v}


register("perplexity", "https://api.perplexity.ai/search", ("perplexity_api_key",), 20, _perplexity_request, perplexity_hits)
register("google", "https://customsearch.googleapis.com/customsearch/v1", ("google_api_key", "google_cse_id"), 10, _google_request, google_hits)
