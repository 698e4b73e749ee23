"""Text cleaning and measures.

A cleaner is a table of regex steps that means the same in Catalyst and in Python: tables run it
as ``regexp_replace`` calls, the HTML renderer runs it with ``re``. NFC is the one step that
Catalyst lacks; only texts with a character from U+0300 on need it, and only they reach Python.
Counts, hashes and redaction are Catalyst expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.types import of

# Characters that go, spaces that become plain ones, white space inside a line.
INVISIBLE = r"\u0000-\u0008\u000B\u000E-\u001F\u007F-\u009F\u00AD\u200B\u2060\uFEFF"
ODD_SPACES = r"\u00A0\u2007\u202F"
IN_LINE = r"\t\n\f\r"
#: Every character below is its own NFC form.
COMPOSED = r"\A[\u0000-\u02FF]*+\z"

_LINES = ("\r\n?", "\n")
_LINE_ENDS = (r"(?<![ \t])[ \t]++\n", "\n")
_OUTER_LINES = (r"\A\n+|\n+(?![\s\S])", "")


@F.pandas_udf(of("string"))
def _nfc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: normalize("NFC", v), na_action="ignore")


def nfc(value: Column) -> Column:
    """The value in NFC; plain values never leave the JVM."""
    plain = value.rlike(COMPOSED)
    return F.when(plain, value).otherwise(_nfc_udf(F.when(~plain, value)))


@dataclass(frozen=True)
class Cleaner:
    """Regex steps in order, then NFC, then (if ``trim``) no white space at either end."""

    steps: tuple[tuple[str, str], ...]
    trim: bool = False
    compose: bool = True

    @cached_property
    def _compiled(self) -> list[tuple[re.Pattern, str]]:
        return [(re.compile(pattern), put) for pattern, put in self.steps]

    def text(self, value: str) -> str:
        for pattern, put in self._compiled:
            value = pattern.sub(put, value)
        if self.compose:
            value = normalize("NFC", value)
        return value.strip() if self.trim else value

    def column(self, value: Column) -> Column:
        value = reduce(lambda v, step: F.regexp_replace(v, *step), self.steps, value)
        if self.compose:
            value = nfc(value)
        return strip(value) if self.trim else value


INLINE = Cleaner(((f"[{INVISIBLE}]+", ""), (f"[{ODD_SPACES}{IN_LINE}]", " "), ("  +", " ")), trim=True)
VERBATIM = Cleaner((_LINES, (rf"[{INVISIBLE}\f]+", "")))
BLOCK = Cleaner((_LINE_ENDS, ("\n{3,}", "\n\n"), _OUTER_LINES), compose=False)
PLAIN = Cleaner((_LINES, (rf"[{INVISIBLE}\f]+", ""), (f"[{ODD_SPACES}]", " "), _LINE_ENDS, ("\n{4,}", "\n\n\n"), _OUTER_LINES))

#: Control characters that no query may hold, and how long it may be.
FORBIDDEN = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F]"
QUERY_LENGTH = (3, 500)


def limited(value: str, most: int) -> tuple[str | None, bool]:
    """A value on one line of at most ``most`` characters, None if empty; and whether it was cut."""
    line = INLINE.text(value)
    return line[:most].rstrip() or None, len(line) > most


def limited_column(value: Column, most: int) -> Column:
    """``struct(value, cut)``, as ``limited``."""
    line = INLINE.column(value)
    return F.struct(F.nullif(F.regexp_replace(F.substring(line, 1, most), r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit("")).alias("value"), (F.char_length(line) > most).alias("cut"))


def clean_query(value: str | None) -> str | None:
    """A search query as it is stored, None if it is none."""
    words = [] if value is None or re.search(FORBIDDEN, value) else normalize("NFC", value).split()
    query = " ".join(words)
    return query if QUERY_LENGTH[0] <= len(query) <= QUERY_LENGTH[1] else None


def query_column(value: Column) -> Column:
    """``clean_query`` as an expression."""
    query = collapse(nfc(value))
    return F.when(~value.rlike(FORBIDDEN) & F.char_length(query).between(*QUERY_LENGTH), query)


def line_endings(value: Column) -> Column:
    return F.regexp_replace(value, *_LINES)


def strip(value: Column) -> Column:
    """Trim what Python's ``str.strip`` trims."""
    return F.regexp_replace(F.regexp_replace(value, "(?U)\\A[\\s\\x1c-\\x1f]+", ""), "(?U)[\\s\\x1c-\\x1f]+\\z", "")


def collapse(value: Column) -> Column:
    """Single spaces, as joining the split words gives."""
    return strip(F.regexp_replace(value, "(?U)[\\s\\x1c-\\x1f]+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def char_count(text: Column) -> Column:
    return F.char_length(text)


def text_hash(text: Column) -> Column:
    return F.when(text != "", F.sha2(text, 256))


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(query, 256), 1, 16)


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 12)


def clean_queries(queries: Column) -> Column:
    """Single-spaced, non-empty, first of equal ones; null when none is left."""
    kept = F.array_distinct(F.filter(F.transform(queries, collapse), lambda q: q != ""))
    return F.when(F.size(kept) > 0, kept)


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


# What a log line must not show.
SECRET_PARAMETER = r"(?i)([?&](?:key|api_key|apikey|access_token|token)=)[^&#\s'\"]+"
BEARER = r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+"
SECRET_NAME = r"(?i)(api[_-]?key|^key$|token|secret|password|authorization|cookie)"
MASK = "[REDACTED]"


def redact_text(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, SECRET_PARAMETER, f"$1{MASK}"), BEARER, f"$1{MASK}")


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_NAME), F.lit(MASK)).otherwise(redact_text(v)))
