"""Raw postings of any provider to one canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimfold.functions.instants import instant, trimmed, with_wall_clock
from brimfold.functions.keys import digest, posting_key
from brimfold.functions.text import html_to_text, markup_to_text, normalize_company, normalize_text, normalize_title, truthy
from brimfold.functions.urls import canonical_url

TEXTS = ("company", "title", "location", "description", "salary", "employment_type", "post_author", "feed_name")


def iso_instant(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` as ISO-8601 UTC with Z and whole seconds; without a zone it is UTC; what can't be read stays as it is, trimmed."""
    df = with_wall_clock(df.withColumn("_text", trimmed(F.coalesce(F.col(value), F.lit("")))), "_text", True, "_clock", "_zone")
    at = F.timestamp_micros(instant(F.col("_clock"), F.coalesce("_zone", F.lit("+00:00"))))
    return df.withColumn(name, F.coalesce(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("_text"))).drop("_text", "_clock", "_zone")


def _text(name: str, default: str, exact: bool) -> Column:
    value = truthy(F.col(name))
    return html_to_text(F.coalesce(value, F.lit(default))) if exact else markup_to_text(F.coalesce(value, F.lit(default)))


def normalise_postings(raw: DataFrame, exact_html: bool = True) -> DataFrame:
    """Canonical postings: cleaned texts, normalised names, keys, hashes, one-entry maps by source.

    ``raw`` may lack any column of the raw schema. ``exact_html`` resolves every HTML entity (Arrow function); else the
    JVM-side reading is used. Null and blank company, title and source get "Unknown company", "Untitled role" and "Unknown".
    """
    strings = ("source", "source_job_id", "source_id", "url", "apply_url", "canonical_url", "ats", "published_at", "lead_type", *TEXTS)
    have = set(raw.columns)
    raw = raw.withColumns({c: F.col(c).cast("string") if c in have else F.lit("") for c in strings})
    raw = raw.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False) for c in ("remote", "hybrid")})
    raw = raw.withColumn("tags", F.coalesce(F.col("tags"), F.array()).cast("array<string>") if "tags" in have else F.array().cast("array<string>"))
    defaults = {"company": "Unknown company", "title": "Untitled role"}
    df = iso_instant(raw, "published_at", "published_at").withColumns({c: _text(c, defaults.get(c, ""), exact_html) for c in TEXTS})
    place = normalize_text(F.col("location"))
    df = df.withColumns({
        "source": F.coalesce(truthy(F.col("source")), F.lit("Unknown")),
        "url": canonical_url(F.col("url")),
        "source_job_id": F.coalesce(truthy(F.col("source_job_id")), truthy(F.col("source_id")), F.lit("")),
        "location": F.when(F.col("location") != "", F.col("location")).when(F.col("remote"), "Remote").otherwise("Unspecified"),
        "remote": F.col("remote") | place.rlike(r"\b(?:remote|home office|work from home)\b"),
        "hybrid": F.col("hybrid") | F.contains(place, F.lit("hybrid")),
        "tags": F.array_sort(F.array_distinct(F.filter("tags", lambda t: t != ""))),
        "ats": normalize_text(F.col("ats")),
    })
    df = df.withColumns({
        "apply_url": F.when(truthy(F.col("apply_url")).isNull(), F.col("url")).otherwise(canonical_url(F.col("apply_url"))),
        "canonical_url": F.when(truthy(F.col("canonical_url")).isNull(), F.col("url")).otherwise(canonical_url(F.col("canonical_url"))),
        "job_key": posting_key(F.col("company"), F.col("title"), F.col("location")),
        "company_normalized": normalize_company(F.col("company")),
        "title_normalized": normalize_title(F.col("title")),
        "location_normalized": F.replace(normalize_text(F.col("location")), F.lit("deutschland"), F.lit("germany")),
        "onsite": ~F.col("remote") & ~F.col("hybrid"),
        "working_model": F.when(F.col("hybrid"), "hybrid").when(F.col("remote"), "remote").otherwise("on-site"),
        "sources": F.array("source"),
        "source_urls": F.create_map("source", "url"),
        "source_job_ids": F.when(F.col("source_job_id") != "", F.create_map("source", "source_job_id")).otherwise(F.create_map().cast("map<string,string>")),
    })
    return df.withColumn("content_hash", digest(*[F.col(c) for c in ("title", "company", "location", "description", "salary", "employment_type")]))
