"""URL identity: hosts, canonical addresses and source keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import non_empty

# scheme, user info, host (or bracketed IPv6), port, path, query
_PARTS = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def is_http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def netloc(url: Column) -> Column:
    """Everything between the scheme and the path, port included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def outlet_host(url: Column) -> Column:
    """Reporting host without ``www.``; the address itself when it has none."""
    return F.coalesce(non_empty(F.replace(netloc(url), F.lit("www."), F.lit(""))), url)


def canonical(url: Column) -> Column:
    """Lower-cased scheme and host, no user info, default port or fragment; null when unusable."""

    def part(i: int) -> Column:
        return F.regexp_extract(url, _PARTS, i)

    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default_port = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    authority = F.when((port == "") | default_port, host).otherwise(
        F.concat(host, F.lit(":"), port.try_cast("int").cast("string"))
    )
    query = F.when(part(5) == "", "").otherwise(F.concat(F.lit("?"), part(5)))
    path = F.coalesce(non_empty(part(4)), F.lit("/"))
    usable = is_http(url) & (host != "") & ((port == "") | port.try_cast("int").between(0, 65535))
    return F.when(usable, F.concat(scheme, F.lit("://"), authority, path, query))


def source_key(provider: Column, native_id: Column, url: Column) -> Column:
    """Provider plus its own id when it has one, else plus the canonical address."""
    by_url = F.concat(provider, F.lit("|url:"), canonical(url))
    return F.when(
        F.coalesce(native_id, F.lit("")) != "", F.concat(provider, F.lit("|"), native_id)
    ).otherwise(by_url)


def name_uid(kind: str, *parts: Column) -> Column:
    """Identifier in UUID layout computed from a name, so retried tasks agree on it."""
    digest = F.sha1(F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
