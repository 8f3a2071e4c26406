"""Reviews of past runs: which count, their sums and rates, employers' health, joins of applications with postings, skills.

Defined results: a missing counter is 0; a missing or empty date is in no period; the mean of nothing is null; rates of
nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimfold.functions.keys import rate
from brimfold.operators.summaries import last_days, last_per_day

COUNTERS = ("relevant_jobs_in_current_run", "new_jobs", "jobs_collected", "security_title_candidates", "duplicates_removed")


def in_period(value: Column, start: Column, end: Column) -> Column:
    """Whether the day a text begins with lies in the period, both ends included, as texts."""
    return F.coalesce(F.substring(value.cast("string"), 1, 10).between(start, end) & (value.cast("string") != ""), F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def is_interview(stage: Column) -> Column:
    """An application that came to an interview: by ``stage`` (3 or more), an interview date or an interview stage."""
    return F.coalesce(stage >= 3, F.lit(False)) | _filled(F.col("interview_date")) | _filled(F.col("interview_stage"))


def interview_in_period(stage: Column, start: Column, end: Column) -> Column:
    """An interview dated in the period; or, of an application that came to one, a response dated in it."""
    return in_period(F.col("interview_date"), start, end) | (is_interview(stage) & in_period(F.col("response_date"), start, end))


def quality_runs(history: DataFrame, window: int = 14, order: str = "_ord") -> DataFrame:
    """The runs a review looks at: of the current form, daily and dated; the last of each day, of the last ``window`` days that have one."""
    runs = history.withColumn("day", F.substring("generated_at", 1, 10)).where((F.coalesce("quality_review_schema_version", F.lit(0)) >= 1) & (F.coalesce(F.nullif("employer_mode", F.lit("")), F.lit("daily")) == "daily") & _filled(F.col("day")))
    return last_days(last_per_day(runs, "day", [F.col(order).desc()]), "day", window)


def metrics(wide: DataFrame) -> DataFrame:
    """(metric, value) of a table of one row."""
    return wide.unpivot([], wide.columns, "metric", "value") if wide.columns else wide


def run_sums(runs: DataFrame) -> DataFrame:
    """One row: sums of the counters, the duplicates among candidates, the mean duration of the runs that tell one, and how many do."""
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("double").alias(c) for c in COUNTERS]
    out = runs.agg(F.count("*").cast("double").alias("runs"), *sums, F.round(F.avg("workflow_duration_seconds"), 1).alias("average_workflow_duration_seconds"), F.count("workflow_duration_seconds").cast("double").alias("workflow_duration_coverage_runs"))
    return out.withColumn("duplicate_rate_percent", rate(F.col("duplicates_removed"), F.col("security_title_candidates")))


def source_checks(runs: DataFrame, statuses: str = "source_status") -> DataFrame:
    """One row: checks of sources (idle ones left out), how many failed or were partial, and the share that failed. A source without a status failed."""
    each = runs.select(F.explode(statuses).alias("source", "_s")).select(F.coalesce(F.nullif("_s.status", F.lit("")), F.lit("failed")).alias("status")).where("status <> 'idle'")
    out = each.agg(F.count("*").cast("double").alias("source_checks"), F.count_if(F.col("status") == "failed").cast("double").alias("source_failures"), F.count_if(F.col("status") == "partial").cast("double").alias("source_partials"))
    return out.withColumn("source_failure_rate_percent", rate(F.col("source_failures"), F.col("source_checks")))


def feedback_counts(reviews: DataFrame, start: Column, end: Column, wrong: str = "FALSE_POSITIVE", right: str = "SUITABLE", reliable_from: int = 5) -> DataFrame:
    """One row: reviews of the period, how many call a posting wrong or right, the share of wrong ones, and whether there are enough (1) or not (0)."""
    seen = F.coalesce(F.nullif("first_seen", F.lit("")), F.col("reviewed_at"))
    out = reviews.where(in_period(seen, start, end)).agg(F.count("*").cast("double").alias("reviewed_jobs"), F.count_if(F.col("verdict") == right).cast("double").alias("suitable_jobs_confirmed"), F.count_if(F.col("verdict") == wrong).cast("double").alias("false_positives"))
    return out.withColumns({"false_positive_rate_percent": rate(F.col("false_positives"), F.col("reviewed_jobs")), "false_positive_rate_is_reliable": (F.col("reviewed_jobs") >= max(1, reliable_from)).cast("double")})


def missed_count(missed: DataFrame, start: Column, end: Column) -> DataFrame:
    return missed.where(in_period(F.col("found_date"), start, end)).agg(F.count("*").cast("double").alias("missed_suitable_jobs"))


def quality_summary(history: DataFrame, reviews: DataFrame, missed: DataFrame, today: str, window: int = 14, reliable_from: int = 5) -> DataFrame:
    """(metric, value) of a review. The period is that of the runs it looks at; without one it is ``today``."""
    runs = quality_runs(history, window)
    first, last = runs.agg(F.min("day"), F.max("day")).first()
    start, end = F.lit(first or today), F.lit(last or today)
    out = None
    for part in (run_sums(runs), source_checks(runs), feedback_counts(reviews, start, end, reliable_from=reliable_from), missed_count(missed, start, end)):
        out = metrics(part) if out is None else out.unionByName(metrics(part))
    return out


def health_summary(companies: DataFrame, health: DataFrame, now: Column, gone: list[int] | None = None) -> DataFrame:
    """One row: configured employers, those whose last scan went well, those left alone for now, and those whose identifier is not known there (``gone`` statuses). An employer never scanned counts as none of these."""
    both = companies.select("key").distinct().join(health.select("key", "failures", "http_status", "next_retry_at"), "key", "left")
    return both.agg(F.count("*").alias("configured"), F.count_if(F.col("failures") == 0).alias("healthy"), F.count_if(F.col("next_retry_at") > now).alias("cooling_down"), F.count_if((F.col("failures") > 0) & F.col("http_status").isin(gone or [404, 410])).alias("invalid_identifiers"))


def selection_summary(decisions: DataFrame) -> DataFrame:
    """(source, configured_enabled, priority_configured, selected, skipped_by_rotation, skipped_by_cooldown) of a rotation. Which were skipped is told by its rows."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return decisions.groupBy("source").agg(F.count("*").alias("configured_enabled"), F.count_if(F.col("priority")).alias("priority_configured"), is_("selected").alias("selected"), is_("rotation_skip").alias("skipped_by_rotation"), is_("cooldown_skip").alias("skipped_by_cooldown"))


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join; the columns of ``right`` get their default where it has no row or a null."""
    joined = left.join(right, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def flagged(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: whether the key is in ``right``; repeated keys there add no rows."""
    return left.join(right.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def enriched(applications: DataFrame, jobs: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Applications with what they leave blank taken from their posting (``job_key``); ``fields``: column -> columns of the posting, the first that is not blank."""
    own = jobs.select(F.col("job_key"), *[F.col(c).alias(f"_j_{c}") for c in sorted({c for cs in fields.values() for c in cs})])
    joined = applications.join(own, "job_key", "left")
    kinds = {f.name: f.dataType.simpleString() for f in applications.schema.fields}

    def value(c: str) -> Column:
        options = [F.nullif(F.trim(x.cast("string")), F.lit("")) for x in (F.col(c), *[F.col(f"_j_{o}") for o in fields[c]])]
        return F.coalesce(*options).cast(kinds[c])

    return joined.select(*[value(c).alias(c) if c in fields else F.col(c) for c in applications.columns])


def with_components(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications whose posting has a score broken down, with ``score_breakdown``; the input of a calibration."""
    return applications.join(jobs.where("score_breakdown is not null and size(score_breakdown) > 0").select("job_key", "score_breakdown"), "job_key")


def with_skill_status(skills: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ``profile_status`` to (skill, ...): what the profile says of it, ``missing`` where nothing."""
    return with_defaults(skills, profile.select("skill", "profile_status"), "skill", {"profile_status": "missing"})


def skill_list(skills: DataFrame, key: str) -> DataFrame:
    """(key, skills): the skills of each posting in the order mandatory, mentioned, optional, then by name; one row a posting, as many as it names."""
    return skills.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("requirement", "skill", "profile_status"))).alias("skills"))


def skill_gaps(df: DataFrame) -> DataFrame:
    """Adds the skills that are short: mandatory_gaps, potential_gaps (mentioned and missing) and optional_gaps."""
    short = lambda s: s["profile_status"].isin("partial", "missing")
    pick = lambda test: F.transform(F.filter("skills", test), lambda s: s["skill"])
    return df.withColumns({"mandatory_gaps": pick(lambda s: (s["requirement"] == "mandatory") & short(s)), "potential_gaps": pick(lambda s: (s["requirement"] == "mentioned") & (s["profile_status"] == "missing")), "optional_gaps": pick(lambda s: (s["requirement"] == "optional") & short(s))})


def below(score: Column, least: int) -> tuple[Column, Column]:
    """A rule for ``rules.reasons``: a score under the least one; null is 0."""
    return F.coalesce(score, F.lit(0)) < least, F.concat(F.lit("score "), F.coalesce(score, F.lit(0)).cast("string"), F.lit(f" is below {least}"))
