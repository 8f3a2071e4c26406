"""Keys, hashes, buckets, rates and dates as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brimfold.functions.text import normalize_company, normalize_text, normalize_title


def digest(*parts: Column, length: int = 64) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the parts joined by a bar; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    """Normalised company, title and location, joined by bars."""
    place = F.replace(normalize_text(location), F.lit("deutschland"), F.lit("germany"))
    return F.concat_ws("|", normalize_company(company), normalize_title(title), place)


def posting_key(company: Column, title: Column, location: Column) -> Column:
    """20 hex digits that name a posting across sources."""
    return F.substring(F.sha2(fingerprint(company, title, location), 256), 1, 20)


def company_key(source: Column, identifier: Column) -> Column:
    """What an employer's health is kept under, whatever the case of its identifier."""
    return F.concat_ws(":", F.lower(source), F.lower(F.trim(identifier)))


def missed_key(company: Column, position: Column, url: Column) -> Column:
    """16 hex digits that name a posting the run should have had."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (company, position, url)]), 256), 1, 16)


def label_prefix(label: Column) -> Column:
    """The part of a label before " - "."""
    return F.substring_index(F.coalesce(label, F.lit("")), " - ", 1)


def stable_bucket(key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 by the first four bytes of the key's SHA-256; the same in every engine."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, rounded half to even; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / whole, digits))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two timestamps, not below 0; null if either is."""
    days = F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days)).cast("int")


def age_band(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 2, "new").when(days <= 7, "recent").when(days <= 30, "current").otherwise("older")


def band(value: Column, steps: list[tuple[float, str]], below: str, missing: str | None = None) -> Column:
    """The name of the first step (in falling order) that ``value`` reaches."""
    out = F.when(value.isNull(), missing) if missing is not None else None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(below)


def week_start(at: Column) -> Column:
    """The Monday of its week."""
    return F.date_trunc("week", at).cast("date")
