"""Bounded decoding of response bodies."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from siftwell.functions.types import struct

STEP = 1 << 16
ENCODINGS = ("", "identity", "gzip", "x-gzip", "deflate")


def _inflated(chunks, gzip: bool):
    """The blocks of a compressed stream, at most ``STEP`` bytes each; EOFError if gzip stops early."""
    stream = zlib.decompressobj(31) if gzip else None
    for chunk in chunks:
        if stream is None and chunk:
            # A zlib header is two bytes that divide by 31; anything else is raw deflate.
            wrapped = len(chunk) > 1 and chunk[0] & 15 == 8 and int.from_bytes(chunk[:2], "big") % 31 == 0
            stream = zlib.decompressobj(15 if wrapped else -15)
        while chunk and not stream.eof:
            yield stream.decompress(chunk, STEP)
            chunk = stream.unconsumed_tail
    if stream is not None:
        yield stream.flush()
    if gzip and not stream.eof:
        raise EOFError


def decode(chunks, encoding: str | None, most: int) -> tuple[bytes | None, str]:
    """The decoded body and its status; a body of more than ``most`` bytes is dropped on the way."""
    name = (encoding or "").strip().lower()
    if name not in ENCODINGS:
        return None, "INVALID_RESPONSE"
    out = bytearray()
    try:
        for block in chunks if name in ("", "identity") else _inflated(chunks, name != "deflate"):
            out += block
            if len(out) > most:
                return None, "RESPONSE_TOO_LARGE"
    except (zlib.error, EOFError):
        return None, "INVALID_RESPONSE"
    return bytes(out), "OK"


def decode_body(raw: bytes | None, encoding: str | None, most: int) -> tuple[bytes | None, str]:
    return (None, "INVALID_RESPONSE") if raw is None else decode([raw], encoding, most)


def decode_udf(max_bytes: int):
    """A UDF ``(body, encoding) -> struct(body, status)``."""

    @F.pandas_udf(struct(body="binary", status="string"))
    def run(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_body(b, e, max_bytes) for b, e in zip(bodies, encodings, strict=True)], columns=["body", "status"])

    return run
