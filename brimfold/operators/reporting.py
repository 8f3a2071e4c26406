"""What a run tells: orders, counts by source and family, alerts, sections of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brimfold.functions.keys import label_prefix, whole_days
from brimfold.operators.summaries import keys_digest, top_per_group


def job_order(order: str = "_ord") -> list[Column]:
    """Postings that are gone last, then the best score, then by company; ties in the order they came."""
    return [F.coalesce(F.col("status") == "REMOVED", F.lit(False)), F.coalesce("score", F.lit(0)).desc(), F.coalesce("company", F.lit("")), F.col(order)]


def jobs_by_source(log: DataFrame) -> DataFrame:
    """(source, jobs) of a collection log."""
    return log.groupBy("source").agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"))


def family_counts(df: DataFrame, family: str, order: str) -> DataFrame:
    """(family, rows, rank): the most frequent first, ties by the row seen first. Null and blank families are ``Other``."""
    named = df.select(F.coalesce(F.nullif(F.trim(family), F.lit("")), F.lit("Other")).alias("family"), F.col(order).alias("_o"))
    counted = named.groupBy("family").agg(F.count("*").alias("rows"), F.min("_o").alias("_first"))
    # as many rows as there are families
    return counted.withColumn("rank", F.row_number().over(W.Window.orderBy(F.col("rows").desc(), "_first"))).drop("_first")


def active(df: DataFrame, done: list[str]) -> DataFrame:
    """Postings that are not gone and whose application is in no state of ``done``."""
    return df.where((F.coalesce("status", F.lit("")) != "REMOVED") & ~F.coalesce(F.upper("application_status"), F.lit("NEW")).isin(done))


def alert_candidates(df: DataFrame, statuses: list[str], least: int) -> DataFrame:
    """Postings in one of these states, of this score or more, not applied for; a null score is 0, a null application is NEW."""
    return df.where(F.upper("status").isin(statuses) & (F.coalesce("score", F.lit(0)) >= least) & (F.coalesce(F.upper("application_status"), F.lit("NEW")) == "NEW"))


def alert(df: DataFrame, statuses: list[str], least: int, limit: int = 10, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """(jobs, summary) of an alert: the ``limit`` best candidates, shortened; one row with candidate_count, included_count, truncated_count and digest.

    The best are those of the highest score, priority employers first, then the latest; ties in the order they came.
    """
    found = alert_candidates(df, statuses, least)
    best = [F.coalesce("score", F.lit(0)).desc(), F.coalesce("priority", F.lit(False)).desc(), F.coalesce("published_at", F.lit("")).desc(), F.col(order)]
    top = found.orderBy(*best).limit(limit).withColumn("position", F.row_number().over(W.Window.orderBy(*best)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    jobs = top.select(
        "position", text("job_key").alias("job_key"), text("title").alias("title"), text("company").alias("company"), text("location").alias("location"), F.coalesce("score", F.lit(0)).alias("score"), label_prefix(F.col("recommendation")).alias("recommendation"),
        F.coalesce("family", F.lit("Other")).alias("family"), F.substring(text("published_at"), 1, 10).alias("published_at"), F.coalesce(F.nullif("apply_url", F.lit("")), F.col("url"), F.lit("")).alias("url"), F.slice("reasons", 1, 4).alias("reasons"), F.slice("warnings", 1, 5).alias("warnings"),
    )
    counts = found.agg(F.count("*").alias("candidate_count")).select("candidate_count", F.least("candidate_count", F.lit(limit)).alias("included_count"), F.greatest(F.col("candidate_count") - limit, F.lit(0)).alias("truncated_count"), F.lit(1).alias("_one"))
    digest = keys_digest(jobs, "job_key", limit).withColumn("_one", F.lit(1))
    return jobs, counts.join(digest, "_one").drop("_one")


def report_sections(df: DataFrame, order: list[Column], strong: int = 75, most_strong: int = 10, most_other: int = 50) -> DataFrame:
    """Adds ``section`` (strong, other) and ``position`` to the first postings of a report: at most so many of each."""
    named = df.withColumn("section", F.when(F.coalesce("score", F.lit(0)) >= strong, "strong").otherwise("other"))
    return top_per_group(named, ["section"], order, max(most_strong, most_other), "position").where((F.col("section") == "other") & (F.col("position") <= most_other) | (F.col("section") == "strong") & (F.col("position") <= most_strong))


def handoff(report: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of a numbered report with these columns only, in their order; a column that is missing is null."""
    here = set(report.columns)
    return report.where(F.col("report_number") <= n).orderBy("report_number").select("report_number", *[F.col(c) if c in here else F.lit(None).cast("string").alias(c) for c in columns])


def compact(df: DataFrame, columns: list[str], now: Column, published: str = "published_at") -> DataFrame:
    """These columns of postings, missing ones as null, and ``age_days``: as stored, else the whole days since ``published``."""
    here = set(df.columns)
    days = whole_days(now, F.col(published).try_cast("timestamp"))
    age = F.coalesce(F.col("age_days"), days) if "age_days" in here else days
    return df.select(*[F.col(c) if c in here else F.lit(None).cast("string").alias(c) for c in columns if c != "age_days"], age.alias("age_days"))
