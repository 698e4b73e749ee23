"""JSON-lines logging with secrets masked, from the same patterns as the Catalyst redaction."""

from __future__ import annotations

import json
import logging
import re

from siftwell.functions.text import BEARER, MASK, SECRET_NAME, SECRET_PARAMETER


def redact(key: str, value):
    """A value as it may be logged under ``key``."""
    if re.search(SECRET_NAME, key):
        return MASK
    if isinstance(value, str):
        return re.sub(BEARER, rf"\1{MASK}", re.sub(SECRET_PARAMETER, rf"\1{MASK}", value))
    if isinstance(value, dict):
        return {str(k): redact(str(k), v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact(key, v) for v in value]
    return value


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = getattr(record, "fields", {})
        event = {"level": record.levelname.lower(), "event": record.getMessage(), **extra}
        return json.dumps({k: redact(k, v) for k, v in event.items()}, ensure_ascii=False, default=str)


def configure(level: str = "INFO") -> logging.Logger:
    log = logging.getLogger("siftwell")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
    log.setLevel(level)
    return log
