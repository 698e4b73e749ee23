"""Scalar tables: URLs, text, headers, policy, robots, decoding."""

import gzip
import tracemalloc
import zlib
from hashlib import sha256

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import decoding, headers, policy, robots, text, urls

URLS = [
    ("HTTP://Example.COM", "http://example.com/"),
    ("https://example.com:443/a/../b/./c", "https://example.com/b/c"),
    ("http://example.com:8080/x", "http://example.com:8080/x"),
    ("https://user:pw@example.com/", "https://example.com/"),
    ("https://example.com/a//b/", "https://example.com/a/b/"),
    ("https://example.com/%7euser/%2f", "https://example.com/~user/%2F"),
    ("https://example.com/100%", "https://example.com/100%25"),
    ("https://example.com/ü x", "https://example.com/%C3%BC%20x"),
    ("https://bücher.example/", "https://xn--bcher-kva.example/"),
    ("https://example.com/?b=2&a=1&a=0&utm_source=x&FBCLID=1", "https://example.com/?a=0&a=1&b=2"),
    ("https://example.com/?k&x=a b#frag", "https://example.com/?k=&x=a+b"),
    ("https://[2001:DB8::1]:443/", "https://[2001:db8::1]/"),
    ("https://example.com./", "https://example.com/"),
    ("https://example.com/?ref=x&page=2", "https://example.com/?page=2&ref=x"),
]
BAD_URLS = [None, "", "  ", "ftp://example.com/", "mailto:x@y.z", "http://", "https://exa mple:bad/", "http://example.com:99999/", "http://[::1", "//example.com/", "https://example.com/" + "a" * 2048]


@pytest.mark.parametrize(("raw", "expected"), URLS)
def test_normalize_url(raw, expected):
    assert urls.normalize_url(raw) == expected
    assert urls.normalize_url(expected) == expected


@pytest.mark.parametrize("raw", BAD_URLS)
def test_normalize_url_rejects(raw):
    assert urls.normalize_url(raw) is None


@given(st.text(alphabet="abAB01%-._~/?&=#;:+ ü", max_size=40))
def test_normalize_url_is_idempotent(tail):
    once = urls.normalize_url("https://example.com/" + tail)
    assert once is None or urls.normalize_url(once) == once


def test_native_normal_form_agrees_with_python(spark):
    rows = [u for u, _ in URLS] + [u for u in BAD_URLS if u is not None] + [
        "https://a.example/x?b=1&a=2", "http://A.example", "https://a.example/x.html#top", "https://a.example/x/?utm_source=feed&q=1", "https://a.example/..", "https://a.example/x/./y",
    ]
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    got = df.select("u", urls.normalized(F.col("u")).alias("n"), urls.normalize_url_udf("u").alias("p")).collect()
    assert all(r.n == r.p for r in got), [r for r in got if r.n != r.p]


@pytest.mark.parametrize(
    ("href", "reason"),
    [("", "empty"), ("#x", "fragment"), ("javascript:void(0)", "javascript"), ("mailto:a@b.c", "mailto"), ("foo:bar", "other_scheme"), ("http://u@h/", "credentials"), ("http://", "invalid"), ("/" + "a" * 3000, "too_long")],
)
def test_link_reasons(href, reason):
    assert urls.link_url(href, "https://e.com/a/")[1] == reason


def test_links_resolve():
    assert urls.resolve_link(" b\n?x=1#f ", "https://e.com/a/") == ("https://e.com/a/b?x=1", "https://e.com/a/b?x=1", None)


CLEANED = [
    (text.INLINE, "  a\u200b \u00a0b\t\n e\u0301 ", "a b \u00e9"), (text.VERBATIM, "a\r\n\tb\x07\r", "a\n\tb\n"), (text.BLOCK, "a  \n\n\n\nb\n", "a\n\nb"),
    (text.PLAIN, "\n\u00a0a \r\n\n\n\n\n\nb\u00adc\n", " a\n\n\nbc"), (text.INLINE, "\u2003 x\x0by \x1f", "xy"), (text.VERBATIM, "\f\ufeff", ""), (text.PLAIN, "", ""),
]


def test_clean_text(spark):
    for cleaner, raw, clean in CLEANED:
        assert cleaner.text(raw) == clean
    (row,) = spark.range(1).select(*(c.column(F.lit(raw)).alias(f"c{i}") for i, (c, raw, _) in enumerate(CLEANED))).collect()
    assert list(row) == [clean for _, _, clean in CLEANED]
    assert text.limited(" ab  cd ", 3) == ("ab", True)
    assert text.limited(" \u200b ", 3) == (None, False)
    queries = ["a\x00bc", " a \n b  c", "ab", "e\u0301" * 3, None, "x" * 501]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").orderBy("i")
    expected = [None, "a b c", None, "\u00e9" * 3, None, None]
    assert [text.clean_query(q) for q in queries] == expected
    assert [r.c for r in df.select(text.query_column(F.col("q")).alias("c")).collect()] == expected
    (row,) = spark.range(1).select(text.limited_column(F.lit(" ab  cd "), 3).alias("a"), text.limited_column(F.lit(" \u200b "), 3).alias("b")).collect()
    assert (tuple(row.a), tuple(row.b)) == (("ab", True), (None, False))


@given(st.text(alphabet="a \t\n\r\f\u00a0\u200b\u0301e\x07\x1c\u2003", max_size=30))
def test_inline_text_is_stable(value):
    once = text.INLINE.text(value)
    assert text.INLINE.text(once) == once and "  " not in once


def test_text_expressions(spark):
    df = spark.createDataFrame([("é_x 1²!", "0" * 64), ("", "0" * 64 + "\n"), (None, None)], "t string, h string")
    got = df.select(
        text.word_count(F.col("t")).alias("w"), text.char_count(F.col("t")).alias("c"), text.text_hash(F.col("t")).alias("s"), text.is_sha256(F.col("h")).alias("v"),
        text.redact_text(F.lit("x?key=1&token=a Bearer zz.1")).alias("r"), text.strip(F.lit("  a \x1c")).alias("p"),
    ).collect()
    assert [(r.w, r.c, r.v) for r in got] == [(2, 7, True), (0, 0, False), (None, None, False)]
    assert got[0].s and got[1].s is None
    assert got[0].r == "x?key=[REDACTED]&token=[REDACTED] Bearer [REDACTED]"
    assert got[0].p == "a"


def test_dates_and_charsets():
    assert headers.parse_date("2024-01-02T03:04:05Z").isoformat() == "2024-01-02T03:04:05+00:00"
    assert headers.parse_date("2024-01-02").isoformat() == "2024-01-02T00:00:00+00:00"
    assert headers.parse_date("soon") is None
    assert headers.iso_datetime("2024-01-02T03:04").isoformat() == "2024-01-02T03:04:00"
    assert headers.choose_charset("nope", b"\xef\xbb\xbfx") == "utf-8-sig"
    assert headers.choose_charset(None, b"<meta charset='latin-1'>") == "iso8859-1"
    assert headers.choose_charset(None, b"x") == "utf-8"


def test_bodies_are_decoded_by_the_megabyte():
    """Of a batch of 40 MB, no more than a few are Python objects at once, and each text goes on in its slice."""
    bodies = pa.array([b"\xc3\xa9" * 100_000] * 200 + [None, b""])
    rows, largest = 0, 0
    tracemalloc.start()
    for part in headers.decode_body_udf.func(iter([(bodies, pa.nulls(len(bodies), pa.string()))])):
        rows, largest = rows + len(part), max(largest, part.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(bodies)
    assert largest < 2 * headers.DECODE_BYTES and peak < 5 * headers.DECODE_BYTES


def test_decoded_bodies_stay_with_their_rows(spark):
    """Several slices in a batch, bodies over a slice, empty and missing ones; and a table without rows."""
    def body(i):
        return None if i % 7 == 3 else (f"{i} é" * (i % 5 * 5000 if i != 100 else 400_000)).encode()

    rows = [(i, body(i), "latin-1" if i % 3 == 1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, b binary, c string").coalesce(1)
    shown = df.select("i", headers.decode_body_udf("b", "c").alias("d")).select("i", "d.*")
    expected = []
    for i, b, c in rows:
        charset = "iso8859-1" if c else "utf-8"
        expected.append((i, None, None, None, None) if b is None else (i, charset, b.decode(charset), sha256(b).hexdigest(), len(b)))
    assert [tuple(r) for r in shown.orderBy("i").collect()] == expected
    assert df.where("i < 0").select(headers.decode_body_udf("b", "c").alias("d")).count() == 0
    assert df.where("length(b) < 0").select(headers.decode_body_udf("b", "c").alias("d")).select("d.content").collect() == []


ADDRESSES = [
    ("8.8.8.8", False), ("127.0.0.1", True), ("10.0.0.1", True), ("169.254.1.1", True), ("224.0.0.1", True), ("0.0.0.0", True), ("::1", True), ("2606:4700::1", False),
    ("::ffff:127.0.0.1", True), ("64:ff9b::7f00:1", True), ("64:ff9b::808:808", False), ("2002:7f00:1::", True), ("fe80::1%eth0", True), ("x", True),
]


@pytest.mark.parametrize(("address", "blocked"), ADDRESSES)
def test_blocked_addresses(address, blocked):
    assert policy.is_blocked_address(address) is blocked


def test_policy_order():
    assert policy.check_url("http://u@localhost:99/") == (None, "credentials in url", False)
    assert policy.check_url("https://e.com:81/") == (None, "port not allowed", False)
    assert policy.check_url("http://0x7f.1/") == (None, "non-canonical numeric host", True)
    assert policy.check_url("http://[::1]/") == (None, "address not allowed", True)
    assert policy.check_url("https://E.com./x") == ("e.com", None, False)
    assert policy.check_url("http://[x") == (None, "malformed url", False)


ROBOTS = "User-agent: a\nUser-agent: b\nDisallow: /x # note\nAllow: /x/ok\nCrawl-delay: 1\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /\nDisallow:\n"


@pytest.mark.parametrize(
    ("agent", "path", "allowed"), [("A", "/x1", False), ("b", "/x/ok", True), ("b", "/y.pdf", False), ("b", "/y.pdf?z", True), ("c", "/y", False), ("b", "/y", True)]
)
def test_robots(spark, agent, path, allowed):
    assert robots.is_allowed(ROBOTS, agent, "https://e.com" + path) is allowed
    files = spark.createDataFrame([("https://e.com", ROBOTS)], "origin string, text string")
    target = spark.createDataFrame([("https://e.com", robots.url_path("https://e.com" + path))], "origin string, path string")
    assert robots.decide(target, robots.rules_table(files), agent).first().allowed is allowed


def test_robots_ties_and_group_without_rules():
    assert robots.is_allowed("User-agent: *\nDisallow: /a\nAllow: /a", "z", "https://e.com/a")
    assert robots.is_allowed("User-agent: z\n\nUser-agent: *\nDisallow: /", "q", "https://e.com/a") is False
    assert robots.is_allowed("Disallow: /", "q", "https://e.com/a")


def test_decoding():
    body = b"x" * 1000
    raw = zlib.compressobj(wbits=-15)
    assert decoding.decode([body], None, 1000) == (body, "OK")
    assert decoding.decode([gzip.compress(body)], "GZIP", 1000) == (body, "OK")
    assert decoding.decode([zlib.compress(body)], "deflate", 1000) == (body, "OK")
    assert decoding.decode([raw.compress(body) + raw.flush()], "deflate", 1000) == (body, "OK")
    assert decoding.decode([gzip.compress(body)], "gzip", 999) == (None, "RESPONSE_TOO_LARGE")
    assert decoding.decode([gzip.compress(body)[:-9]], "gzip", 1000) == (None, "INVALID_RESPONSE")
    assert decoding.decode([gzip.compress(body)[:7], gzip.compress(body)[7:] + b"tail"], "gzip", 1000) == (body, "OK")
    assert decoding.decode([body], "br", 1000) == (None, "INVALID_RESPONSE")
    assert decoding.decode_body(None, None, 1000) == (None, "INVALID_RESPONSE")
