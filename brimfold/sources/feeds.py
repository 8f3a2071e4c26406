"""RSS and Atom feeds of posts to raw postings."""

from __future__ import annotations

import json
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions.instants import instant, trimmed, with_wall_clock
from brimfold.functions.text import contains_any, markup_to_text, normalize_plain
from brimfold.functions.urls import canonical_url, redirect_target, urls_in
from brimfold.operators.dedup import first_per_key
from brimfold.sources.providers import LOG, RAW, _finish, _or, http_status

ITEM = "title string, link string, guid string, author string, creator string, pubDate string, published string, updated string, description string, summary string, content string"
#: A guid longer than this is stored as its hash.
LONGEST_GUID = 180


class FeedConfigurationError(ValueError):
    """A list of feeds that can't be used."""


def configured_feeds(listed: list, more: str = "") -> list[dict[str, str]]:
    """[{name, url, path}] of the feeds to read: those listed (addresses or objects) and those of ``more``, a JSON array.

    Disabled ones are left out, of one address the first counts; addresses are http or https. ``path`` is where a feed was landed, if it was.
    """
    try:
        extra = json.loads(more) if more.strip() else []
    except ValueError as e:
        raise FeedConfigurationError(f"the further feeds are no JSON: {e}") from e
    if not isinstance(extra, list):
        raise FeedConfigurationError("the further feeds are no JSON array")
    out: dict[str, dict[str, str]] = {}
    for number, entry in enumerate([*listed, *extra], 1):
        entry = {"url": entry} if isinstance(entry, str) else entry
        if not isinstance(entry, dict):
            raise FeedConfigurationError(f"feed {number} is neither an address nor an object")
        url = str(entry.get("url") or "").strip()
        if entry.get("enabled", True) is False or not url:
            continue
        if urlsplit(url).scheme not in ("http", "https"):
            raise FeedConfigurationError(f"feed {number} has an address that is not http or https")
        out.setdefault(url, {"name": str(entry.get("name") or f"feed {number}").strip(), "url": url, "path": str(entry.get("path") or "")})
    return list(out.values())


def collect_feeds(spark: SparkSession, feeds: list[dict[str, str]], host: str, path_part: str, topic: list[str], call: list[str], max_items: int = 50) -> tuple[DataFrame, DataFrame]:
    """(raw postings, collection log) of landed feeds. A feed that can't be read is a failed row and costs itself only; no feeds, no rows."""
    postings, log = spark.createDataFrame([], RAW), spark.createDataFrame([], LOG)
    for feed in feeds:
        name = feed["name"]
        row = lambda ok, jobs, error, name=name: (F.lit("feed_posts").alias("source"), F.lit(name).alias("employer"), F.lit(ok).alias("ok"), jobs.cast("bigint").alias("jobs"), F.lit(1).cast("bigint").alias("requests"), http_status(F.lit(error)).alias("http_status"), F.lit(error[:300]).alias("error"))
        try:
            text = spark.read.option("wholetext", True).text(feed["path"])
            # a document is a feed if its root says so and is closed
            if not text.where(F.col("value").rlike(r"(?is)<(rss|feed|rdf:RDF)\b.*</(rss|feed|rdf:RDF)>\s*$")).limit(1).count():
                raise FeedConfigurationError("no feed in the document")
            rows = feed_postings(feed_entries(spark, feed["path"]), name, host, path_part, topic, call, max_items)
        except (AnalysisException, FeedConfigurationError, ValueError) as e:
            error = " ".join(f"{type(e).__name__}: {e}".split())
            log = log.unionByName(spark.range(1).select(*row(False, F.lit(0), error)))
            continue
        postings = postings.unionByName(rows)
        log = log.unionByName(rows.agg(F.count("*").alias("_jobs")).select(*row(True, F.col("_jobs"), "")))
    return postings, log


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title, link, guid, author, published, description): RSS items and Atom entries, the first non-empty of each group of fields."""
    read = lambda tag: spark.read.format("xml").schema(ITEM).option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE").load(path)
    rows = read("item").unionByName(read("entry"))
    return rows.select(F.monotonically_increasing_id().alias("pos"), _or(F.col("title")).alias("title"), _or(F.col("link")).alias("link"), _or(F.col("guid")).alias("guid"), _or(F.col("author"), F.col("creator")).alias("author"), _or(F.col("pubDate"), F.col("published"), F.col("updated")).alias("published"), _or(F.col("description"), F.col("summary"), F.col("content")).alias("description"))


def feed_postings(entries: DataFrame, feed: str, host: str, path_part: str, topic: list[str], call: list[str], max_items: int = 50) -> DataFrame:
    """Raw postings of a feed's first ``max_items`` entries that link to a post on ``host`` and speak of both ``topic`` and ``call``.

    The post's address is the first match among link, guid, description and title, redirects unwrapped; each address counts
    once, the first entry wins. ``max_items`` is the feature of the feed setting, not a guard.
    """
    first = entries.orderBy("pos").limit(max_items)
    urls = F.flatten(F.transform(F.array("link", "guid", "description", "title"), urls_in))
    posts = F.filter(F.transform(urls, lambda u: canonical_url(redirect_target(u))), lambda u: F.lower(u).rlike(rf"^https?://(?:[a-z0-9-]+\.)*{host}/") & u.contains(path_part))
    text = normalize_plain(markup_to_text(F.concat_ws(" ", "title", "description")))
    kept = first.withColumns({"_url": F.try_element_at(posts, F.lit(1)), "_text": text}).where("_url is not null")
    kept = first_per_key(kept, ["_url"], [F.col("pos")]).where(contains_any(F.col("_text"), topic) & contains_any(F.col("_text"), call))
    kept = with_wall_clock(kept.withColumn("_when", trimmed(F.col("published"))), "_when", True, "_clock", "_zone")
    at = F.timestamp_micros(instant(F.col("_clock"), F.coalesce("_zone", F.lit("+00:00"))))
    when = F.coalesce(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("_when"))
    guid = F.when(F.length("guid") > LONGEST_GUID, F.sha2("guid", 256)).otherwise(_or(F.col("guid"), F.col("_url")))
    remote = F.col("_text").rlike(r"\b(?:remote|home office)\b")
    return _finish(kept, "feed_posts", source_job_id=guid, company=_or(F.col("author")), title=F.trim(F.regexp_replace(markup_to_text(F.col("title")), r"\s+", " ")), location=F.when(remote, "Remote").otherwise(""), remote=remote, url=F.col("_url"), published_at=when, description=F.col("description"), lead_type=F.lit("post"), post_author=F.col("author"), feed_name=F.lit(feed))
