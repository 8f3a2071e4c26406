"""State carried between runs, as keyed tables that are merged with one batch.

Defined results: a key that comes twice in a batch is compared with its own earlier row (``order``); null keys take no
part. A removed key that comes back is UPDATED, even with the same content.
"""

from __future__ import annotations

import datetime
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brimfold.functions.keys import stable_bucket
from brimfold.plans.shared import bounded_rows

MAX_RUNS = 100_000


def track_seen(batch: DataFrame, state: DataFrame, now: Column, expire_days: int, allow_expiry: bool = True, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observed, state, events) after a batch.

    ``batch`` has job_key and content_hash; ``state`` has job_key, first_seen, last_seen, content_hash, status.
    observed: the batch with first_seen, last_seen, status. events: (at, job_key, event) for NEW, UPDATED and REMOVED.
    """
    rank = W.Window.partitionBy("job_key").orderBy(F.col(order) if order else F.lit(0))
    prior = state.select("job_key", F.col("first_seen").alias("_first"), F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    seen = batch.where("job_key is not null").withColumns({"_before": F.lag("content_hash").over(rank), "_n": F.row_number().over(rank), "_last": F.lead(F.lit(1)).over(rank).isNull()}).join(prior, "job_key", "left")
    same = F.when(F.col("_n") == 1, (F.col("_status") != "REMOVED") & F.col("_hash").eqNullSafe(F.col("content_hash"))).otherwise(F.col("_before").eqNullSafe(F.col("content_hash")))
    status = F.when((F.col("_n") == 1) & F.col("_first").isNull(), "NEW").when(same, "SEEN_BEFORE").otherwise("UPDATED")
    seen = seen.withColumns({"status": status, "first_seen": F.coalesce("_first", now), "last_seen": now})
    observed = seen.drop("_before", "_n", "_last", "_first", "_hash", "_status")
    fresh = seen.where("_last").select("job_key", "first_seen", "last_seen", "content_hash", "status")
    gone = F.lit(allow_expiry) & (F.col("status") != "REMOVED") & (F.col("last_seen") < now - F.make_dt_interval(F.lit(expire_days)))
    rest = state.join(fresh.select("job_key"), "job_key", "left_anti").withColumn("_gone", gone)
    kept = rest.withColumn("status", F.when(F.col("_gone"), "REMOVED").otherwise(F.col("status"))).select("job_key", "first_seen", "last_seen", "content_hash", "status")
    events = seen.where("status <> 'SEEN_BEFORE'").select(now.alias("at"), "job_key", F.col("status").alias("event")).unionByName(rest.where("_gone").select(now.alias("at"), "job_key", F.lit("REMOVED").alias("event")))
    return observed, fresh.unionByName(kept), events


def seen_history(observations: DataFrame, runs: DataFrame, expire_days: int) -> DataFrame:
    """(job_key, run, event) of a whole log at once: NEW, UPDATED, SEEN_BEFORE and REMOVED.

    ``observations``: job_key, run (date), content_hash, one row per key and run. ``runs``: run, allow_expiry; at most MAX_RUNS of
    them, and of observed runs. What a run's neighbours say depends on the run alone: the last one before it, and the first one late
    enough to expire what it saw. Both are told once a run and joined to the observations.
    """
    allowed = sorted(x[0] for x in bounded_rows(runs.where("allow_expiry").select("run").distinct(), MAX_RUNS, "list of runs"))
    seen = sorted(x[0] for x in bounded_rows(observations.select("run").where("run is not null").distinct(), MAX_RUNS, "list of observed runs"))
    day = datetime.timedelta(days=expire_days)

    def neighbours(run: datetime.date) -> tuple:
        before, after = bisect_left(allowed, run) - 1, bisect_right(allowed, run + day)
        return run, allowed[before] if before >= 0 else None, allowed[after] if after < len(allowed) else None

    told = observations.sparkSession.createDataFrame([neighbours(r) for r in seen], "run date, _prior date, _expiring date")
    w = W.Window.partitionBy("job_key").orderBy("run")
    rows = observations.withColumns({"_p": F.lag("run").over(w), "_ph": F.lag("content_hash").over(w), "_next": F.lead("run").over(w)}).join(F.broadcast(told), "run")
    # the last run before this one is the one most likely to have expired what was seen before
    expired = F.coalesce(F.date_sub("_prior", expire_days) > F.col("_p"), F.lit(False))
    status = F.when(F.col("_p").isNull(), "NEW").when(expired | ~F.col("_ph").eqNullSafe(F.col("content_hash")), "UPDATED").otherwise("SEEN_BEFORE")
    removed = rows.where(F.col("_next").isNull() | (F.col("_expiring") < F.col("_next"))).select("job_key", F.col("_expiring").alias("run"), F.lit("REMOVED").alias("event")).where("run is not null")
    return rows.select("job_key", "run", status.alias("event")).unionByName(removed)


def upsert(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of ``current``, and those of ``previous`` whose key isn't in it."""
    return previous.join(current.select(key), key, "left_anti").unionByName(current, allowMissingColumns=True)


def replace_period(previous: DataFrame, current: DataFrame, period: str) -> DataFrame:
    """Last write wins per period: the periods of ``current`` are replaced whole."""
    return previous.join(current.select(period).distinct(), period, "left_anti").unionByName(current, allowMissingColumns=True)


def last_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The last ``n`` rows by ``order`` (a bounded log)."""
    return df.orderBy(*order).limit(n)


def cooldown_hours(failures: Column, status: Column, base: int = 24, most: int = 168, gone_hours: int = 720, free: int = 1) -> Column:
    """How long to leave a failing source alone: doubling from ``base`` hours up to ``most``; ``gone_hours`` after 404 or 410; 0 without a failure."""
    doubled = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(failures - free, F.lit(8))))
    return F.when(failures <= 0, 0.0).when(status.isin(404, 410), float(gone_hours)).otherwise(doubled).cast("int")


def update_health(health: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Employer health after a run: (key, failures, http_status, next_retry_at). ``results``: key, ok, http_status, one row per key.

    A success clears the failures; a failure adds one and sets the time of the next try; keys without a result stay.
    """
    both = health.select("key", F.col("failures").alias("_f"), F.col("http_status").alias("_s"), F.col("next_retry_at").alias("_r")).join(results, "key", "full_outer")
    failures = F.when(F.col("ok").isNull(), F.coalesce("_f", F.lit(0))).when(F.col("ok"), 0).otherwise(F.coalesce("_f", F.lit(0)) + 1)
    both = both.withColumn("failures", failures)
    wait = cooldown_hours(F.col("failures"), F.coalesce("http_status", F.lit(0)))
    retry = F.when(F.col("ok").isNull(), F.col("_r")).when(~F.col("ok"), now + F.make_dt_interval(F.lit(0), wait))
    return both.select("key", "failures", F.when(F.col("ok").isNull(), F.col("_s")).otherwise(F.col("http_status")).alias("http_status"), retry.alias("next_retry_at"))


def rotation(companies: DataFrame, health: DataFrame, now: Column, batches: int, limit: int, full: bool = False) -> DataFrame:
    """Which sources to scan: adds ``decision`` (selected, cooldown_skip, rotation_skip) to (source, key, name, priority).

    Priority sources are always due; others when their bucket is the weekday's (Monday 0) modulo ``batches``. Per source at
    most ``limit``, priority first, then by name; the rest wait for the next round.
    """
    rows = companies.join(health.select("key", "next_retry_at"), "key", "left")
    due = F.lit(full) | F.col("priority") | (stable_bucket(F.col("key"), batches) == F.weekday(now) % batches)
    rows = rows.withColumn("decision", F.when(F.col("next_retry_at") > now, "cooldown_skip").when(due, "selected").otherwise("rotation_skip"))
    w = W.Window.partitionBy("source", "decision").orderBy(F.col("priority").desc(), F.lower("name"), F.lower("key"))
    over = (F.col("decision") == "selected") & (F.row_number().over(w) > limit)
    return rows.withColumn("decision", F.when(over, "rotation_skip").otherwise(F.col("decision"))).drop("next_retry_at")
