"""A small HTTP interface over the engine, on the standard library's server.

``POST /research``, ``GET /research/{id}``, ``GET /research/{id}/results``, ``POST
/research/{id}/cancel``, ``GET /health``. Answers are JSON envelopes of data or error with the
request's id; errors say what is wrong, never what was sent.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from siftwell.engine import Engine, EngineError, Job
from siftwell.sources.providers import provider_status

MOST_BODY = 16_384
REQUEST_ID = r"[A-Za-z0-9._-]{1,64}"
KEY = r"[\x21-\x7e]{1,128}"
CODES = {"JOB_NOT_FOUND": "NOT_FOUND", "IDEMPOTENCY_CONFLICT": "CONFLICT", "JOB_NOT_FINISHED": "CONFLICT", "JOB_FAILED": "CONFLICT", "INVALID_REQUEST": "VALIDATION_ERROR"}
SHAPE = {"query": 2000, "language": 8, "country": 8}
RETRY_AFTER_S = 30


def _shown(value):
    return value.isoformat() if isinstance(value, datetime) else str(value)


def invalid(*problems: tuple[tuple[str, ...], str, str]) -> EngineError:
    """Where and why, without the value."""
    return EngineError("VALIDATION_ERROR", 422, "request validation failed", None, {"errors": [{"loc": list(loc), "msg": msg, "type": kind} for loc, msg, kind in problems]})


def checked_body(raw: bytes) -> dict:
    try:
        body = json.loads(raw)
    except ValueError:
        raise invalid((("body",), "not valid JSON", "json_invalid")) from None
    if not isinstance(body, dict):
        raise invalid((("body",), "not an object", "dict_type"))
    problems = [(("body", k), "not a field", "extra_forbidden") for k in body if k not in SHAPE]
    for name, most in SHAPE.items():
        value = body.get(name)
        if value is None and name != "query":
            continue
        if not isinstance(value, str):
            problems.append((("body", name), "missing" if value is None else "not a string", "missing" if value is None else "string_type"))
        elif len(value) > most:
            problems.append((("body", name), "too long", "string_too_long"))
    for name, pattern in (("language", "[a-z]{2}"), ("country", "[A-Z]{2}")):
        if isinstance(body.get(name), str) and not re.fullmatch(pattern, body[name]):
            problems.append((("body", name), "invalid format", "string_pattern_mismatch"))
    if problems:
        raise invalid(*problems)
    return body


class Api:
    """Requests to answers; ``inputs`` gives a new job's tables for ``Engine.run``."""

    def __init__(self, engine: Engine, inputs: Callable[[Job], dict]) -> None:
        self.engine, self.inputs = engine, inputs

    def answer(self, method: str, path: str, raw: bytes, key: str | None = None) -> tuple[int, dict, dict]:
        """(status, data, meta); errors are raised."""
        if path == "/health" and method == "GET":
            s = self.engine.settings
            found = [{"name": n, "status": status, "missing": missing} for n, status, missing in provider_status(s.secrets, s.providers)]
            return 200, {"status": "ok", "providers": found, "jobs": self.engine.health()}, {}
        if path == "/research" and method == "POST":
            if key is not None and not re.fullmatch(KEY, key):
                raise invalid((("header", "Idempotency-Key"), "invalid format", "value_error"))
            body = checked_body(raw)
            job, new = self.engine.create(body["query"], body.get("language"), body.get("country"), key)
            if new:
                self.engine.start(job.id, **self.inputs(job))
            return 202 if new else 200, {"job_id": job.id, "status": job.status, "created_at": job.created_at}, {"idempotent_replay": not new}
        found = re.fullmatch(r"/research/([0-9a-f]{32})(/results|/cancel)?", path)
        if not found:
            raise EngineError("NOT_FOUND", 404, "resource not found")
        job_id, rest = found[1], found[2]
        if method != ("POST" if rest == "/cancel" else "GET"):
            raise EngineError("VALIDATION_ERROR", 405, "method not allowed", "METHOD_NOT_ALLOWED")
        if rest == "/cancel":
            status = self.engine.cancel(job_id)
            if status == 409:
                raise EngineError("CONFLICT", 409, "the job has already finished", "JOB_ALREADY_FINISHED", {"status": self.engine.get(job_id).status})
            return status, self.engine.view(job_id), {}
        return 200, self.results(job_id) if rest else self.engine.view(job_id), {}

    def results(self, job_id: str) -> dict:
        """A finished job's results: one job's selected sources are few, and come as they are."""
        job, tables = self.engine.get(job_id), self.engine.get_results(job_id)
        items = [r.asDict(True) for r in tables["results"].orderBy("position").collect()] if "results" in tables else []
        shown = {
            "job_id": job.id, "status": job.status, "coverage": job.coverage or "NONE", "error": self.engine.view(job_id)["error"], "warnings": list(job.warnings),
            "results": [{"url": i["result"]["url"], "title": i["result"].get("title"), "providers": i["providers"], "occurrences": i["occurrences"]} for i in items],
        }
        if "views" in tables:
            shown["sources"] = [r.asDict(True) for r in tables["views"].orderBy("position").collect()]
        return shown

    def serve(self, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        api = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self, method: str) -> None:
                asked = self.headers.get("X-Request-Id", "")
                request_id = asked if re.fullmatch(REQUEST_ID, asked) else uuid.uuid4().hex
                data, error, meta, head = None, None, {}, {}
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    if size > MOST_BODY:
                        raise EngineError("VALIDATION_ERROR", 413, "request body too large", "PAYLOAD_TOO_LARGE")
                    status, data, meta = api.answer(method, self.path.partition("?")[0], self.rfile.read(size), self.headers.get("Idempotency-Key"))
                except EngineError as e:
                    status, error = e.status, e.body()["error"] | {"code": CODES.get(e.code, e.code)}
                    head = {"Retry-After": str(RETRY_AFTER_S)} if status == 503 else {}
                except Exception:  # noqa: BLE001  nothing of a failure goes out
                    status, error = 500, {"code": "INTERNAL_ERROR", "message": "internal server error"}
                body = json.dumps({"data": data, "error": error, "meta": {"request_id": request_id, **meta}}, default=_shown).encode()
                self.send_response(status)
                for name, value in {"Content-Type": "application/json", "Content-Length": str(len(body)), "X-Request-Id": request_id, **head}.items():
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:  # noqa: N802
                self._reply("GET")

            def do_POST(self) -> None:  # noqa: N802
                self._reply("POST")

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
