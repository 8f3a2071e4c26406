"""Counts, funnels, bands, rolling windows and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brimfold.functions.keys import rate


def count_reasons(df: DataFrame, reasons: str, order: str) -> DataFrame:
    """(reason, rows, first): how often each reason occurs, and the first row it occurs in."""
    return df.select(F.col(order), F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"), F.min(order).alias("first"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; the limit is what the list is for."""
    return df.withColumn(rank, F.row_number().over(W.Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def best_per_group(df: DataFrame, group: str, best: Column, *fields: str) -> DataFrame:
    """(group, fields) of the row of each group with the greatest ``best``; combined before the shuffle."""
    return df.groupBy(group).agg(F.max_by(F.struct(*fields), best).alias("_b")).select(group, "_b.*")


def top_counts(df: DataFrame, kind: str, value: str, order: str, n: int = 12) -> DataFrame:
    """(kind, value, rows, rank): the ``n`` most frequent values of each kind; ties go to the one seen first."""
    counted = df.groupBy(kind, value).agg(F.count("*").alias("rows"), F.min(order).alias("_first"))
    return top_per_group(counted, [kind], [F.col("rows").desc(), F.col("_first"), F.col(value)], n).drop("_first")


def funnel(df: DataFrame, stages: list[str], sets: list[list[str]], unrecorded: str = "UNRECORDED") -> DataFrame:
    """Counts and rates of boolean stages for each of several groupings in one pass (GROUPING SETS).

    Rates are percentages of the stage before. Columns: the grouping columns (null where not grouped by), ``grouping``, rows, stages, <stage>_rate.
    """
    columns = sorted({c for s in sets for c in s})
    named = df.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(unrecorded)) for c in columns})
    grouped = named.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]) if columns else named.groupBy()
    level = F.grouping_id().cast("int") if columns else F.lit(0)
    out = grouped.agg(level.alias("grouping"), F.count("*").alias("rows"), *[F.count_if(F.col(s)).alias(s) for s in stages])
    return out.withColumns({f"{b}_rate": rate(F.col(b), F.col(a)) for a, b in zip(stages, stages[1:])})


def last_per_day(df: DataFrame, day: str, order: list[Column]) -> DataFrame:
    """The last row of each day."""
    return df.withColumn("_rn", F.row_number().over(W.Window.partitionBy(day).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_days(df: DataFrame, day: str, n: int) -> DataFrame:
    """The rows of the last ``n`` days that occur (observed days, not calendar days)."""
    days = df.select(day).distinct().orderBy(F.col(day).desc()).limit(n)
    return df.join(F.broadcast(days), day, "left_semi")


def calibration(df: DataFrame, components: list[str], positive: str, negative: str) -> DataFrame:
    """(component, positive_mean, negative_mean, difference): means of each component by outcome; the mean of nothing is 0."""
    long = df.unpivot([positive, negative], components, "component", "value")
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c), F.col("value"))), F.lit(0.0))
    out = long.groupBy("component").agg(mean(positive).alias("positive_mean"), mean(negative).alias("negative_mean"))
    return out.withColumn("difference", F.col("positive_mean") - F.col("negative_mean"))


def source_status(log: DataFrame) -> DataFrame:
    """(source, checked, ok_count, failed_count, jobs, requests, status): idle, partial, failed or ok by the counters of a collection log.

    ``log``: source, employer (null for a source without employers), ok, jobs, requests.
    """
    has = F.col("employer").isNotNull()
    out = log.groupBy("source").agg(F.count_if(has).alias("checked"), F.count_if(has & F.col("ok")).alias("ok_count"), F.count_if(has & ~F.col("ok")).alias("failed_count"), F.sum("jobs").alias("jobs"), F.sum("requests").alias("requests"), F.bool_and("ok").alias("_ok"))
    status = F.when((F.col("checked") == 0) & (F.col("requests") == 0) & (F.col("jobs") == 0), "idle").when((F.col("ok_count") > 0) & (F.col("failed_count") > 0), "partial").when(~F.col("_ok"), "failed").otherwise("ok")
    return out.withColumn("status", status).drop("_ok")


def all_failed(status: DataFrame) -> DataFrame:
    """One row: whether some source was not idle and all those failed."""
    return status.agg((F.count_if(F.col("status") != "idle") > 0).alias("_some"), F.coalesce(F.bool_and((F.col("status") == "failed") | (F.col("status") == "idle")), F.lit(False)).alias("_all")).select((F.col("_some") & F.col("_all")).alias("all_failed"))


def keys_digest(df: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """One row: the first ten hex digits of the SHA-256 of the sorted keys, one per line; the same for the same set, so an alert isn't sent twice.

    For the keys of one alert; more than ``most`` are an error.
    """
    few = df.select(key).limit(most + 1).agg(F.collect_list(key).alias("_k"))
    told = F.substring(F.sha2(F.array_join(F.array_sort("_k"), "\n"), 256), 1, 10)
    return few.select(F.when(F.size("_k") > most, F.raise_error(F.lit(f"more than {most} keys"))).otherwise(told).alias("digest"))


def report_queue(df: DataFrame, fresh: Column, order: list[Column], n: int, fill: bool = True) -> DataFrame:
    """The ``n`` rows of a report: fresh ones first, then (with ``fill``) the others, each in ``order``; numbered from 1."""
    rows = df if fill else df.where(fresh)
    top = rows.orderBy(fresh.desc(), *order).limit(n)
    return top.withColumn("report_number", F.row_number().over(W.Window.orderBy(fresh.desc(), *order)))
