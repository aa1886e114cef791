"""Fetching sources by URL without reaching into the network at home.

Every URL, and every one that a redirect names, is checked before it is asked for: scheme, user part, host name, and all addresses that the host resolves to. What goes wrong is told by a
class that says whether another try makes sense. How bytes are fetched and names resolved are functions that the caller brings; they run in the tasks.
"""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable, Iterable
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import blocked_host, host_of

MOST_REDIRECTS, MOST_BYTES = 5, 64 << 20
#: Errors that another try can't mend; all others are worth one.
PERMANENT = ("unsupported_scheme", "user_info", "internal_address", "no_addresses", "http_4xx", "too_large", "too_many_redirects", "invalid_redirect")


class Response(NamedTuple):
    status: int
    body: Iterable[bytes] = ()
    location: str | None = None
    content_type: str | None = None


class Failed(Exception):
    """A fetch that ended with an error of this class."""


Transport = Callable[[str, tuple[str, ...]], Response]  # url and the checked addresses to connect to; TimeoutError and OSError are the network's
Resolver = Callable[[str], Iterable[str]]  # host to addresses; OSError if the name can't be looked up


def url_error(url: Column) -> Column:
    """The class of what is wrong with a URL as it stands, null if nothing is."""
    web = F.coalesce(url.rlike(r"(?i)^https?://[^/?#]"), F.lit(False))
    user = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1).contains("@")
    return F.when(~web, "unsupported_scheme").when(user, "user_info").when(host_of(url).isNull(), "unsupported_scheme").when(blocked_host(host_of(url)), "internal_address")


def internal(address: str) -> bool:
    """Loopback, private, link-local, unspecified, broadcast or unique-local; an IPv4 address mapped into IPv6 counts as itself."""
    ip = ipaddress.ip_address(address.split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.version == 6:
        return ip.is_loopback or ip.is_unspecified or ip.is_link_local or ip in ipaddress.ip_network("fc00::/7")
    home = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32", "255.255.255.255/32")
    return any(ip in ipaddress.ip_network(n) for n in home)


def checked(url: str, resolve: Resolver) -> tuple[str, ...]:
    """The addresses that a URL may be fetched from; Failed for one that may not."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        raise Failed("unsupported_scheme") from None
    if parts.scheme not in ("http", "https") or not host:
        raise Failed("unsupported_scheme")
    if "@" in parts.netloc:
        raise Failed("user_info")
    if host == "localhost" or host.endswith((".local", ".internal", ".localhost")):
        raise Failed("internal_address")
    try:
        ipaddress.ip_address(host)
        found: tuple[str, ...] = (host,)
    except ValueError:
        try:
            found = tuple(resolve(host))
        except OSError:
            raise Failed("dns") from None
    if not found:
        raise Failed("no_addresses")
    if any(internal(a) for a in found):
        raise Failed("internal_address")
    return found


def fetch_one(url: str, transport: Transport, resolve: Resolver, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS) -> tuple[str, int, bytes, str | None]:
    """Final URL, number of redirects, body and content type."""
    hops = 0
    while True:
        addresses = checked(url, resolve)
        try:
            response = transport(url, addresses)
            if 300 <= response.status < 400:
                if hops == most_redirects:
                    raise Failed("too_many_redirects")
                if not response.location:
                    raise Failed("invalid_redirect")
                hops += 1
                try:
                    url = urljoin(url, response.location)
                except ValueError:
                    raise Failed("invalid_redirect") from None
                continue
            if response.status >= 400:
                raise Failed("http_4xx" if response.status < 500 else "http_5xx")
            body = bytearray()
            for part in response.body:
                if len(body) + len(part) > most_bytes:
                    raise Failed("too_large")
                body += part
        except TimeoutError:
            raise Failed("timeout") from None
        except OSError:
            raise Failed("network") from None
        return url, hops, bytes(body), response.content_type


OUT = "final_url string, redirects int, content binary, content_type string, sha256 string, error string, permanent boolean"


def fetch(urls: DataFrame, transport: Transport, resolve: Resolver, url: str = "url", most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS) -> DataFrame:
    """urls with final_url, redirects, content, content_type, sha256, error and permanent. A row with an error has no content; a null URL is an unsupported scheme. Rows are fetched
    where they lie, one at a time in a task: deal them out by host for politeness."""
    names = [c.split()[0] for c in OUT.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ': ') for c in OUT.split(', '))}>")
    def told(column: pa.Array) -> pa.Array:
        rows = []
        for u in column.to_pylist():
            try:
                final, hops, body, kind = fetch_one(u or "", transport, resolve, most_bytes, most_redirects)
                rows.append(dict(zip(names, (final, hops, body, kind, hashlib.sha256(body).hexdigest(), None, None), strict=True)))
            except Failed as e:
                rows.append(dict.fromkeys(names) | {"error": str(e), "permanent": str(e) in PERMANENT})
        kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        return pa.array(rows, pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in OUT.split(", ")]))

    return urls.withColumn("_told", told(F.col(url))).select(*urls.columns, "_told.*")


def fetch_outcomes(fetched: DataFrame) -> DataFrame:
    """fetched with what a source's life cycle asks for: ok, and whether the source is to be given up."""
    return fetched.withColumn("ok", F.col("error").isNull()).withColumn("dead", F.coalesce("permanent", F.lit(False)))


def by_host(urls: DataFrame, url: str = "url", lanes: int = 4) -> DataFrame:
    """urls dealt out so that a host's rows, of which there may be many, come from a few tasks at a time."""
    return urls.repartition(host_of(F.col(url)), F.pmod(F.xxhash64(url), F.lit(lanes)))

