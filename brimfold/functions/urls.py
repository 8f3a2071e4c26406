"""URLs as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only say where a visitor came from.
TRACKING = "source ref referrer gh_src".split()


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, single slashes and none at the end. Null gives the empty string."""
    text = F.trim(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(text, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^(?:utm_[^=]*|{'|'.join(TRACKING)})(?:=|$)"))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_host(url: Column) -> Column:
    """Host in lower case, port included; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host_quality(url: Column, aggregators: list[str]) -> Column:
    """0 without a host, 1 for an aggregator's, else 3."""
    host = url_host(url)
    return F.when(host == "", 0).when(host.isin(aggregators), 1).otherwise(3)


def redirect_target(url: Column, parameters: tuple[str, ...] = ("url", "q", "target", "dest", "destination")) -> Column:
    """The address that a redirecting URL carries in its query, else the URL itself."""
    found = [F.regexp_extract(url, rf"[?&]{p}=(https?(?:%3A|:)[^&#]*)", 1) for p in parameters]
    target = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    return F.coalesce(F.try_url_decode(target), url)


def urls_in(text: Column) -> Column:
    """The http(s) addresses in a text, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>\"')]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))
