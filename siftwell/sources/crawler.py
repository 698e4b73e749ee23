"""Guarded HTTP fetching on executors.

Targets are dealt by host, so one task owns a host and can space its requests. Each connection
resolves the name, refuses it if any address is blocked, and connects to the address that was
checked. A redirect is followed to the target as it was given, which the policy judges like any
other URL; its canonical form only tells loops. One deadline bounds a whole fetch: waiting,
robots.txt, redirects, retries. Nothing here raises for a page: every problem is a status.
"""

from __future__ import annotations

import http.client
import random
import socket
import ssl
import time
from hashlib import sha256
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import decoding, headers, policy, robots, urls
from siftwell.functions.html import first_title
from siftwell.operators.crawl import MAX_BODY, MAX_REDIRECTS, PAGE_TYPES, REDIRECTS, RETRIED, RETRIED_HTTP, ROBOTS_BODY, ROBOTS_UNREACHABLE
from siftwell.operators.extract import HTML_TYPES
from siftwell.schemas import FETCH_CATEGORY

AGENT = "siftwell"
# Seconds.
TOTAL_S, CONNECT_S, READ_S, ROBOTS_S, ROBOTS_TTL_S, BACKOFF_S, SPACING_S = 15.0, 5.0, 10.0, 5.0, 86_400.0, 1.0, 1.0
RETRIES = 1
CHUNK = 1 << 16

RESULT = (
    "url string, crawl_id string, status string, http_status int, final_url string, content_type string, charset string, content string, "
    "content_sha256 string, content_length int, wire_bytes int, title string, "
    "redirect_chain array<struct<url:string,http_status:int,location:string,connected_ip:string>>, resolved_ip string, "
    "robots struct<robots_url:string,outcome:string,allowed:boolean>, attempts int, duration_ms int, "
    "error struct<code:string,category:string,message:string,cause:string>"
)
_HOP = pa.struct([("url", pa.string()), ("http_status", pa.int32()), ("location", pa.string()), ("connected_ip", pa.string())])
_ARROW = pa.schema(
    [
        ("url", pa.string()), ("crawl_id", pa.string()), ("status", pa.string()), ("http_status", pa.int32()), ("final_url", pa.string()), ("content_type", pa.string()),
        ("charset", pa.string()), ("content", pa.string()), ("content_sha256", pa.string()), ("content_length", pa.int32()), ("wire_bytes", pa.int32()),
        ("title", pa.string()), ("redirect_chain", pa.list_(_HOP)), ("resolved_ip", pa.string()),
        ("robots", pa.struct([("robots_url", pa.string()), ("outcome", pa.string()), ("allowed", pa.bool_())])), ("attempts", pa.int32()), ("duration_ms", pa.int32()),
        ("error", pa.struct([(n, pa.string()) for n in ("code", "category", "message", "cause")])),
    ]
)


def resolve(host: str, port: int) -> list[str]:
    """Distinct addresses in resolver order."""
    return list(dict.fromkeys(a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)))


class _Pinned(http.client.HTTPConnection):
    """Connects to a checked address, speaks to the named host."""

    def __init__(self, host: str, port: int, address: str, tls: bool, timeout: float) -> None:
        super().__init__(host, port, timeout=timeout)
        self.address, self.tls = address, tls

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)
        if self.tls:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)


def request(url: str, timeout_s: float, most: int, blocked=policy.is_blocked_address, lookup=resolve, clock=time.monotonic) -> dict:
    """One GET without redirects, done after ``timeout_s`` at the latest."""
    end = clock() + timeout_s
    parts = urlsplit(url)
    tls = parts.scheme == "https"
    port = parts.port or (443 if tls else 80)
    host = parts.hostname or ""
    try:
        found = lookup(host, port)
    except OSError:
        return {"status": "DNS_ERROR", "message": "dns resolution failed"}
    if not found or any(map(blocked, found)):
        return {"status": "SSRF_BLOCKED", "message": "resolved address not allowed"}

    def late(status: str, message: str) -> dict:
        return {"status": "FETCH_TIMEOUT", "message": "total fetch time exceeded"} if clock() >= end else {"status": status, "message": message}

    connection = _Pinned(host, port, found[0], tls, max(0.001, min(CONNECT_S, end - clock())))
    try:
        try:
            connection.connect()
        except TimeoutError:
            return late("CONNECT_TIMEOUT", "connect timed out")
        line = connection.sock
        line.settimeout(max(0.001, min(READ_S, end - clock())))
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        connection.request("GET", path, headers={"User-Agent": AGENT, "Accept-Encoding": "gzip, deflate"})
        answer = connection.getresponse()
        head = {k.lower(): v for k, v in answer.getheaders()}
        raw = bytearray()
        while len(raw) <= most + most // 10 + 65_536 and not answer.isclosed():
            left = end - clock()
            if left <= 0:
                return late("READ_TIMEOUT", "read timed out")
            line.settimeout(min(READ_S, left))
            block = answer.read1(CHUNK)
            if not block:
                break
            raw += block
    except ssl.SSLError:
        return {"status": "TLS_ERROR", "message": "tls handshake or certificate verification failed"}
    except TimeoutError:
        return late("READ_TIMEOUT", "read timed out")
    except http.client.HTTPException:
        return {"status": "INVALID_RESPONSE", "message": "protocol error"}
    except (OSError, ValueError):
        return {"status": "CONNECTION_ERROR", "message": "connection failed"}
    finally:
        connection.close()
    return {"status": "READ", "http_status": answer.status, "head": head, "raw": bytes(raw), "resolved_ip": found[0]}


def _media(value: str | None) -> tuple[str | None, str | None]:
    """The media type and the last charset of a header."""
    first, *rest = [p.strip() for p in (value or "").split(";")]
    named = [p.partition("=")[2].strip().strip("\"'").lower() for p in rest if p.partition("=")[0].strip().lower() == "charset" and "=" in p]
    return first.lower() or None, (named[-1] or None) if named else None


def _finish(answer: dict, most: int, page: bool) -> dict:
    """The rules for a response that is not a redirect."""
    if answer["status"] != "READ":
        return answer
    head, code = answer["head"], answer["http_status"]
    media, charset = _media(head.get("content-type"))
    out = {"http_status": code, "content_type": media, "charset": charset, "resolved_ip": answer["resolved_ip"], "retry_after": head.get("retry-after")}
    if not 200 <= code < 300:
        return out | {"status": "HTTP_ERROR", "message": f"http status {code}"}
    if page and media not in PAGE_TYPES:
        return out | {"status": "UNSUPPORTED_CONTENT_TYPE", "message": "content type not supported"}
    if len(answer["raw"]) > most + most // 10 + 65_536:
        return out | {"status": "RESPONSE_TOO_LARGE", "message": "response body over limit"}
    body, status = decoding.decode_body(answer["raw"], head.get("content-encoding"), most)
    return out | {"status": status, "body": body, "wire_bytes": len(answer["raw"]), "message": "ok" if status == "OK" else "body not usable"}


class Fetcher:
    """Fetches of one task: robots cache, spacing per host, redirects, one retry."""

    def __init__(self, timeout_s: float = TOTAL_S, spacing_s: float = SPACING_S, check=policy.check_url, send=request, clock=time.monotonic, sleep=time.sleep, retries: int = RETRIES) -> None:
        self.timeout_s, self.spacing_s, self.check, self.send, self.clock, self.sleep, self.retries = timeout_s, spacing_s, check, send, clock, sleep, retries
        self.robots: dict[str, tuple[str, str | None, float]] = {}
        self.last: dict[str, float] = {}
        self.jitter = random.Random(0)

    def _send(self, url: str, most: int, end: float) -> dict:
        """One request, after the host's spacing and before ``end``."""
        host = urlsplit(url).hostname or ""
        wait = self.last.get(host, -1e9) + self.spacing_s - self.clock()
        if self.clock() + max(wait, 0) >= end:
            return {"status": "FETCH_TIMEOUT", "message": "total fetch time exceeded"}
        if wait > 0:
            self.sleep(wait)
        self.last[host] = self.clock()
        return self.send(url, end - self.clock(), most)

    def _walk(self, url: str, most: int, page: bool, end: float) -> dict:
        current, seen, chain, verdict = url, set(), [], None
        while True:
            _, reason, ssrf = self.check(current)
            common = {"final_url": current, "chain": chain, "robots": verdict and verdict["robots"]}
            if reason:
                return common | {"status": "SSRF_BLOCKED" if ssrf else "POLICY_BLOCKED", "message": reason}
            key = urls.normalize_url(current) or current
            if page and key in seen:
                return common | {"status": "REDIRECT_LOOP", "message": "redirect loop"}
            seen.add(key)
            if page:
                verdict = self._robots_verdict(current, end)
                common |= {"robots": verdict["robots"]}
                if verdict["status"]:
                    return common | {"status": verdict["status"], "message": verdict["message"]}
            answer = self._send(current, most, end)
            if answer.get("http_status") not in REDIRECTS:
                return common | _finish(answer, most, page)
            location = answer["head"].get("location")
            if not location:
                return common | {"status": "INVALID_RESPONSE", "http_status": answer["http_status"], "message": "redirect without location"}
            chain.append({"url": current, "http_status": answer["http_status"], "location": location, "connected_ip": answer.get("resolved_ip")})
            if len(chain) > MAX_REDIRECTS:
                return common | {"status": "REDIRECT_LIMIT", "message": "too many redirects"}
            try:
                target = urljoin(current, location)
            except ValueError:
                target = location
            if current.lower().startswith("https:") and target.lower().startswith("http:"):
                return common | {"status": "POLICY_BLOCKED", "message": "https to http redirect", "final_url": target}
            current = target

    def _robots_entry(self, origin: str, end: float) -> tuple[str, str | None]:
        known = self.robots.get(origin)
        if known and known[2] > self.clock():
            return known[:2]
        got = self._walk(f"{origin}/robots.txt", ROBOTS_BODY, False, min(end, self.clock() + ROBOTS_S))
        code = got.get("http_status") or 0
        if got["status"] == "OK":
            entry = ("PARSED", got["body"].decode(headers.choose_charset(got.get("charset"), got["body"]), "replace"))
        elif got["status"] == "HTTP_ERROR" and 400 <= code < 500:
            entry = ("UNAVAILABLE_ALLOW", None)
        else:
            # What failed is looked at again the next time.
            return ("UNREACHABLE_DISALLOW", got["status"] if got["status"] == "SSRF_BLOCKED" or got["status"] in ROBOTS_UNREACHABLE else None)
        self.robots[origin] = (*entry, self.clock() + ROBOTS_TTL_S)
        return entry

    def _robots_verdict(self, url: str, end: float) -> dict:
        parts = urlsplit(url)
        origin = f"{parts.scheme.lower()}://{parts.netloc.rpartition('@')[2].lower()}"
        kind, detail = self._robots_entry(origin, end)

        def decided(outcome: str | None, allowed: bool, status: str | None = None, message: str = "") -> dict:
            shown = {"robots_url": f"{origin}/robots.txt", "outcome": outcome, "allowed": allowed} if outcome else None
            return {"robots": shown, "status": status or (None if allowed else "ROBOTS_BLOCKED"), "message": message}

        if kind == "PARSED":
            allowed = robots.is_allowed(detail, AGENT, url)
            return decided("ALLOWED" if allowed else "DISALLOWED", allowed, message="disallowed by robots.txt")
        if kind == "UNAVAILABLE_ALLOW":
            return decided(kind, True)
        if detail == "SSRF_BLOCKED":
            return decided(None, False, detail, "resolved address not allowed")
        return decided(kind, False, detail, "host unreachable" if detail else "disallowed by robots.txt")

    def fetch(self, url: str, deadline: float | None = None) -> dict:
        """One page; ``deadline`` (on the fetcher's clock) bounds it further."""
        started = self.clock()
        end = started + self.timeout_s if deadline is None else min(started + self.timeout_s, deadline)
        if end <= started:
            return {"status": "FETCH_TIMEOUT", "message": "no time budget left", "attempts": 1, "duration_ms": 0, "chain": []}
        got: dict = {}
        for attempt in range(1, self.retries + 2):
            got = self._walk(url, MAX_BODY, True, end) | {"attempts": attempt}
            again = got["status"] in RETRIED or (got["status"] == "HTTP_ERROR" and got.get("http_status") in RETRIED_HTTP)
            if not again:
                break
            if attempt > self.retries:
                if attempt > 1:
                    got |= {"status": "RETRY_EXHAUSTED", "message": "transient failure persisted after retry", "cause": got["status"]}
                break
            delay = _seconds(got.get("retry_after"))
            delay = BACKOFF_S * self.jitter.uniform(0.5, 1.0) if delay is None else delay
            if self.clock() + delay >= end:
                break
            self.sleep(delay)
        return got | {"duration_ms": int((self.clock() - started) * 1000)}


def _seconds(value: str | None) -> float | None:
    try:
        return None if value is None else max(0.0, float(value))
    except ValueError:
        return None


def assemble(url: str, got: dict) -> dict:
    """A fetch's row: text and hash for a page that is there, an error for any other."""
    code = got.get("http_status")
    row = {
        "url": url, "crawl_id": sha256(url.encode()).hexdigest(), "status": got["status"], "http_status": code, "final_url": got.get("final_url"),
        "content_type": got.get("content_type"), "redirect_chain": got.get("chain") or [], "resolved_ip": got.get("resolved_ip") if code is not None else None,
        "robots": got.get("robots"), "attempts": got.get("attempts", 1), "duration_ms": got.get("duration_ms", 0),
    }
    body = got.get("body")
    if got["status"] != "OK" or body is None:
        return row | {"error": {"code": got["status"], "category": FETCH_CATEGORY[got["status"]] or "INTERNAL_ERROR", "message": got.get("message"), "cause": got.get("cause")}}
    charset = headers.choose_charset(got.get("charset"), body)
    content = body.decode(charset, "replace")
    title = first_title(content) if got.get("content_type") in HTML_TYPES else None
    return row | {"charset": charset, "content": content, "content_sha256": sha256(body).hexdigest(), "content_length": len(body), "wire_bytes": got.get("wire_bytes"), "title": title}


def fetch_all(targets: DataFrame, make=Fetcher, budget_s: float | None = None) -> DataFrame:
    """``targets`` (``url`` and any other columns) fetched by host: one task owns a host's requests and their spacing.

    ``budget_s`` bounds what a task may take in all; targets it does not get to are FETCH_TIMEOUT rows.
    """
    host = urls.host(F.col("url"))
    dealt = targets.repartition(host).sortWithinPartitions(host)
    more = [c for c in targets.columns if c != "url"]
    schema = "".join(f"`{c}` {targets.schema[c].dataType.simpleString()}, " for c in more) + RESULT

    def run(batches):
        fetcher = make()
        deadline = None if budget_s is None else fetcher.clock() + budget_s
        for batch in batches:
            rows = [assemble(u, fetcher.fetch(u, deadline)) for u in batch.column(batch.schema.get_field_index("url")).to_pylist()]
            found = pa.RecordBatch.from_pylist(rows, _ARROW)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in more]
            yield pa.RecordBatch.from_arrays([*kept, *found.columns], [*more, *_ARROW.names])

    return dealt.mapInArrow(run, schema)


def collect_sources(selection: DataFrame, make=Fetcher, budget_s: float | None = None, limits: dict | None = None) -> dict[str, DataFrame]:
    """Fetch and extract every selected source (``job_id, position, result``).

    Each source is a row all along: admitted by its host's task, fetched, checked against its
    source, extracted, checked against its fetch. ``mismatches`` is empty in a sound run.
    """
    from siftwell.operators import sources
    from siftwell.operators.extract import extract_documents
    from siftwell.session import once

    targets = selection.select("job_id", "position", F.col("result.original_url").alias("url"))
    fetched = once(fetch_all(targets, make, budget_s).withColumnRenamed("url", "requested_url"))
    documents = once(extract_documents(fetched, limits))
    return {
        "fetches": fetched, "documents": documents, "records": sources.records(selection, fetched, documents), "mismatches": sources.join_mismatches(fetched, documents),
        "over_budget": sources.over_budget(documents),
    }
