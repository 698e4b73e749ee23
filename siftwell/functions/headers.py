"""Dates, numbers, media types, charsets and language claims from headers and markup."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.types import of, struct

# Fixed values.
LATIN1 = ("iso8859-1", "iso-8859-1", "latin-1", "latin1", "l1")
LANGUAGE = r"[a-z]{2,3}(-[a-z0-9]{2,8})*"
META_CHARSET = rb"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)"
MEDIA_TYPE = r"[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+"
MOST_BACKOFF = 30.0
_DECODED = {"charset": pa.string(), "content": pa.string(), "content_sha256": pa.string(), "content_length": pa.int32()}
#: Bytes of bodies that a worker decodes before it hands on their texts.
DECODE_BYTES = 1 << 20


def parse_date(value: str | None) -> datetime | None:
    """An ISO date or time, UTC where no zone is given; None if it is neither."""
    if not value:
        return None
    try:
        found = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def iso_datetime(value: str | None) -> datetime | None:
    """Strictly what ``fromisoformat`` reads; a naive time stays naive."""
    try:
        return datetime.fromisoformat(value.strip()) if value else None
    except ValueError:
        return None


@F.pandas_udf(of("timestamp"))
def parse_date_udf(values: pd.Series) -> pd.Series:
    return pd.Series([parse_date(v) for v in values], dtype="datetime64[us, UTC]")


@F.pandas_udf(of("string"))
def iso_datetime_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: found.isoformat() if (found := iso_datetime(v)) else None, na_action="ignore")


def native_date(value: Column) -> Column:
    """The common ISO forms without Python."""
    text = F.trim(value)
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def retry_after(value: Column) -> Column:
    number = F.expr("null") if value is None else value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(number, F.lit(0.0)))


def backoff(retry_after_s: Column, base: float, attempt: Column) -> Column:
    return F.least(F.coalesce(retry_after_s, F.lit(base) * F.pow(F.lit(2.0), attempt - 1)), F.lit(MOST_BACKOFF))


def media_type(value: Column) -> Column:
    """The lower-case type before any parameter, null if it is malformed."""
    media = F.lower(F.trim(F.split(value, ";")[0]))
    return F.when(media.rlike(rf"\A(?:{MEDIA_TYPE})\z"), media)


def declared_charset(value: Column) -> Column:
    """The last charset parameter of a well-formed type, without quotes."""
    named = F.filter(
        F.transform(F.slice(F.split(value, ";"), 2, 1000), lambda p: F.trim(p)),
        lambda p: (F.instr(p, "=") > 0) & (F.lower(F.trim(F.substring_index(p, "=", 1))) == "charset"),
    )
    last = F.try_element_at(named, F.lit(-1))
    text = F.lower(F.regexp_replace(F.trim(F.regexp_extract(last, "=(.*)$", 1)), "^[\"']+|[\"']+$", ""))
    return F.when(media_type(value).isNotNull() & (text != ""), text)


def choose_charset(declared: str | None, body: bytes) -> str:
    """The first of declared, BOM and meta charset that Python knows, else UTF-8."""
    meta = re.search(META_CHARSET, body[:4096])
    bom = "utf-8-sig" if body[:3] == codecs.BOM_UTF8 else None
    for name in (declared, bom, meta and meta[1].decode("ascii", "ignore")):
        if name:
            try:
                return codecs.lookup(name).name
            except LookupError:
                pass
    return "utf-8"


def decode_text(raw: bytes | None, declared: str | None) -> tuple:
    """Charset, text, hash and length of a body."""
    from hashlib import sha256

    if raw is None:
        return None, None, None, None
    charset = choose_charset(declared, raw)
    return charset, raw.decode(charset, "replace"), sha256(raw).hexdigest(), len(raw)


@F.arrow_udf(struct(charset="string", content="string", content_sha256="string", content_length="int"))
def decode_body_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``decode_text`` of each row. Only ``DECODE_BYTES`` of a batch and one body are Python objects at once."""

    def packed(rows: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DECODED.values(), strict=True)], names=list(_DECODED))

    for body, declared in batches:
        rows, size = [], 0
        for raw, name in zip(body, declared, strict=True):
            rows.append(decode_text(raw.as_py(), name.as_py()))
            size += rows[-1][3] or 0
            if size >= DECODE_BYTES:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)


def charset_warnings(content: Column, charset: Column) -> Column:
    """``CHARSET_SUSPECT`` and ``DECODING_ERRORS`` where they apply."""
    suspect = content.contains("\x00") | (F.coalesce(F.lower(charset).isin(*LATIN1), F.lit(False)) & content.rlike("[\\x80-\\x9f]"))
    lost = F.char_length(content) - F.char_length(F.replace(content, F.lit("�"), F.lit("")))
    many = (lost > 100) | ((content != "") & (lost > 0.005 * F.char_length(content)))
    return F.array_compact(F.array(F.when(suspect, "CHARSET_SUSPECT"), F.when(many, "DECODING_ERRORS")))


def claimed_language(value: Column) -> Column:
    code = F.replace(F.lower(F.trim(F.split(value, ",")[0])), F.lit("_"), F.lit("-"))
    return F.when(code.rlike(rf"\A(?:{LANGUAGE})\z"), code)
