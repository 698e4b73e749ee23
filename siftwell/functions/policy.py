"""Which URLs and addresses may be fetched. Nothing here does I/O."""

from __future__ import annotations

import re
from ipaddress import IPv4Address, IPv6Address, ip_address, ip_network
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.types import of, struct

# Fixed values.
MAX_URL = 2048
SCHEMES = ("http", "https")
PORTS = (80, 443)
LOCAL_NAMES = ("localhost", "metadata", "metadata.google.internal")
NAT64 = ("64:ff9b::/96", "64:ff9b:1::/48")
TUNNELS = ("2002::/16", "2001::/32")
NUMERIC_HOST = r"(?i)(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+))*"
QUAD = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANONICAL_V4 = rf"{QUAD}(?:\.{QUAD}){{3}}"

_nat64 = [ip_network(n) for n in NAT64]
_tunnels = [ip_network(n) for n in TUNNELS]


def _private(ip: IPv4Address | IPv6Address) -> bool:
    return ip.is_multicast or ip.is_unspecified or ip.is_reserved or not ip.is_global


def is_blocked_address(address: str) -> bool:
    """Whether connecting there is refused, by the address and any IPv4 address inside it."""
    try:
        ip = ip_address(address.partition("%")[0])
    except ValueError:
        return True
    if ip.version == 4:
        return _private(ip)
    if any(ip in n for n in _tunnels):
        return True
    if any(ip in n for n in _nat64):
        return _private(IPv4Address(int(ip) % (1 << 32)))
    return _private(ip) or (ip.ipv4_mapped is not None and _private(ip.ipv4_mapped))


def check_url(url: str | None) -> tuple[str | None, str | None, bool]:
    """(host, None, False) for a URL that may be fetched, else (None, reason, SSRF)."""
    if url is None or len(url) > MAX_URL:
        return None, "malformed url" if url is None else "url too long", False
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None, "malformed url", False
    scheme = parts.scheme.lower()
    host = (parts.hostname or "").rstrip(".").lower()
    plain = (
        ("scheme not allowed", scheme not in SCHEMES),
        ("credentials in url", "@" in parts.netloc),
        ("missing host", not host),
        ("zone id or encoded host", "%" in host),
        ("port not allowed", (port if port is not None else dict(zip(SCHEMES, PORTS, strict=True)).get(scheme)) not in PORTS),
    )
    for reason, broken in plain:
        if broken:
            return None, reason, False
    if host in LOCAL_NAMES or host.endswith(".localhost"):
        return None, "local hostname", True
    if re.fullmatch(NUMERIC_HOST, host) and not re.fullmatch(CANONICAL_V4, host):
        return None, "non-canonical numeric host", True
    try:
        literal = str(ip_address(host))
    except ValueError:
        return host, None, False
    return (None, "address not allowed", True) if is_blocked_address(literal) else (host, None, False)


@F.pandas_udf(struct(host="string", reason="string", ssrf="boolean"))
def check_url_udf(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check_url(u) for u in urls], columns=["host", "reason", "ssrf"])


@F.pandas_udf(of("boolean"))
def is_blocked_udf(addresses: pd.Series) -> pd.Series:
    return pd.Series([is_blocked_address(a or "") for a in addresses], dtype=bool)


@F.pandas_udf(of("boolean"))
def any_blocked_udf(addresses: pd.Series) -> pd.Series:
    """Whether a host is refused: one blocked address is enough, no address at all as well."""
    return pd.Series([len(a) == 0 or any(map(is_blocked_address, a)) for a in addresses], dtype=bool)


def lexical_check(url: Column) -> Column:
    """The checks that need no address arithmetic, as ``struct(host, reason, ssrf)``, in Catalyst.

    Exact for URLs whose host is a name or a dotted quad; IPv6 literals need ``check_url_udf``.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(place, r"(?:^|@)([^@:]*)(?::[0-9]*)?$", 1), r"\.+$", ""))
    port = F.coalesce(F.nullif(F.regexp_extract(place, r":([0-9]+)$", 1), F.lit("")).try_cast("int"), F.when(scheme == "https", 443).otherwise(80))
    quad = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b = quad[0], quad[1]
    inside = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 198) & b.between(18, 19)) | ((a == 192) & (b == 0) & quad[2].isin(0, 2)) | ((a == 198) & (b == 51) & (quad[2] == 100))
        | ((a == 203) & (b == 0) & (quad[2] == 113))
    )
    reason = (
        F.when(F.char_length(url) > MAX_URL, "url too long")
        .when(~scheme.isin(*SCHEMES), "scheme not allowed")
        .when(place.contains("@"), "credentials in url")
        .when(host == "", "missing host")
        .when(host.contains("%"), "zone id or encoded host")
        .when(~port.isin(*PORTS), "port not allowed")
        .when(host.isin(*LOCAL_NAMES) | host.endswith(".localhost"), "local hostname")
        .when(host.rlike(rf"\A{NUMERIC_HOST}\z") & ~host.rlike(rf"\A{CANONICAL_V4}\z"), "non-canonical numeric host")
        .when(host.rlike(rf"\A{CANONICAL_V4}\z") & inside, "address not allowed")
    )
    ssrf = F.coalesce(reason.isin("local hostname", "non-canonical numeric host", "address not allowed"), F.lit(False))
    return F.struct(F.when(reason.isNull(), host).alias("host"), reason.alias("reason"), ssrf.alias("ssrf"))
