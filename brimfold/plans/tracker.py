"""``python -m brimfold.plans.tracker ROOT ...``: what a person records of postings, kept as swapped tables below ROOT.

    applications set --job-key K [--company ..] [--position ..] [--status ..] [--score N] [--date D] [--notes ..]
    applications list | applications export
    review mark --job-key K --verdict V [--notes ..]
    review missed --company C --position P --url U [--found-date D] [--reason ..]
    review list | review report [--runs TABLE]

ROOT/tracker.json may name the allowed ``statuses`` and ``verdicts``, and the statuses that need a date (``dated``); without it
any is allowed. ROOT/jobs is a Parquet table with job_key, company, title, score, url, first_seen, where there is one; blank fields are
taken from it. Exit status 0, or 1 with the broken rules.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions.keys import missed_key
from brimfold.operators import review, validation
from brimfold.operators.state import upsert
from brimfold.plans.shared import bounded_rows, materialize
from brimfold.sources import sinks
from brimfold.sources.files import HadoopFiles

APPLICATIONS = "job_key string, company string, position string, status string, score int, application_date string, job_url string, notes string, updated_at string"
REVIEWS = "job_key string, verdict string, company string, position string, score int, first_seen string, reviewed_at string, notes string"
MISSED = "missed_key string, company string, position string, url string, found_date string, reason string, notes string, recorded_at string"
JOBS = "job_key string, company string, title string, score int, url string, first_seen string"
FROM_JOB = {"company": ["company"], "position": ["title"], "score": ["score"], "job_url": ["url"]}
MOST = 100_000


def checked_applications(rows: DataFrame, statuses: list[str], dated: list[str]) -> DataFrame:
    """The rows, or InvalidRecords: company and position, a known status, a score of 0 to 100, real dates, a date where the status needs one."""
    rules = [validation.required("company"), validation.required("position"), validation.between("score", 0, 100), validation.iso_date("application_date"), validation.required_if("application_date", F.col("status").isin(dated))]
    rules += [validation.one_of("status", statuses)] if statuses else []
    validation.require_valid(validation.violations(rows, "job_key", rules), "applications")
    return rows


def checked_reviews(rows: DataFrame, verdicts: list[str]) -> DataFrame:
    """The rows, or InvalidRecords: a known verdict, a score of 0 to 100, dates or instants."""
    rules = [validation.required("verdict"), validation.between("score", 0, 100), validation.iso_moment("first_seen"), validation.iso_moment("reviewed_at")]
    rules += [validation.one_of("verdict", verdicts)] if verdicts else []
    validation.require_valid(validation.violations(rows, "job_key", rules), "reviews")
    return rows


def checked_missed(rows: DataFrame) -> DataFrame:
    """The rows, or InvalidRecords: company, position, address and date are needed, the address is http or https."""
    rules = [*(validation.required(c) for c in ("company", "position", "url", "found_date")), validation.web_address("url"), validation.iso_date("found_date")]
    validation.require_valid(validation.violations(rows, "missed_key", rules), "missed postings")
    return rows


class Tracker:
    """The three tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rules = sinks.get_json(spark, f"{self.root}/tracker.json", {})
        self.applications, self.reviews, self.missed = (sinks.SwappedTable(spark, f"{self.root}/{n}", s) for n, s in (("applications", APPLICATIONS), ("reviews", REVIEWS), ("missed", MISSED)))

    def jobs(self) -> DataFrame:
        here = HadoopFiles(self.spark).exists(f"{self.root}/jobs")
        return self.spark.read.schema(JOBS).parquet(f"{self.root}/jobs") if here else self.spark.createDataFrame([], JOBS)

    def _one(self, schema: str, **values) -> DataFrame:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        return self.spark.createDataFrame([tuple(values.get(n) for n in names)], schema)

    def set_application(self, now: str, **fields) -> None:
        """Put the given fields into one record, new or old; what it leaves blank comes from the posting."""
        merged = validation.partial_update(self.applications.read(), self._one(APPLICATIONS, **fields, updated_at=now), "job_key")
        rows = review.enriched(merged, self.jobs(), FROM_JOB).withColumn("status", F.upper(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("REVIEW"))))
        rows = materialize(rows.select(*self.applications.read().columns), "applications")
        self.applications.replace(checked_applications(rows, self.rules.get("statuses", []), self.rules.get("dated", [])))

    def mark(self, now: str, job_key: str, verdict: str, notes: str = "") -> None:
        """Record what a person thinks of a posting; the last word on it counts. A posting that is not known is an error."""
        known = self.jobs().where(F.col("job_key") == job_key)
        if not known.limit(1).count():
            raise validation.InvalidRecords(f"no posting {job_key}")
        row = known.limit(1).select("job_key", F.lit(verdict.upper().replace("-", "_")).alias("verdict"), "company", F.col("title").alias("position"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.lit(now).alias("reviewed_at"), F.lit(notes.strip()).alias("notes"))
        rows = materialize(upsert(self.reviews.read(), row, "job_key"), "reviews")
        self.reviews.replace(checked_reviews(rows, self.rules.get("verdicts", [])))

    def miss(self, now: str, company: str, position: str, url: str, found_date: str, reason: str = "", notes: str = "") -> None:
        """Record a posting the runs should have had."""
        row = self._one(MISSED, company=company.strip(), position=position.strip(), url=url.strip(), found_date=found_date, reason=reason.strip(), notes=notes.strip(), recorded_at=now)
        row = row.withColumn("missed_key", missed_key(F.col("company"), F.col("position"), F.col("url")))
        rows = materialize(upsert(self.missed.read(), row, "missed_key"), "missed")
        self.missed.replace(checked_missed(rows))

    def export(self) -> str:
        """One CSV of all applications, sorted by posting; its folder."""
        sinks.one_csv(self.applications.read(), self.applications.read().columns, "job_key", f"{self.root}/applications_csv")
        return f"{self.root}/applications_csv"

    def report(self, runs: DataFrame, today: str) -> DataFrame:
        """(metric, value) of a review; also as ROOT/review.json and ROOT/review.md."""
        found = materialize(review.quality_summary(runs, self.reviews.read(), self.missed.read(), today), "review")
        sinks.list_json(found, f"{self.root}/review.json")
        sinks.put_text(self.spark, f"{self.root}/review.md", sinks.markdown_document("Review", {"day": today}, [("Figures", found, {"metric": "Figure", "value": "Value"})]))
        return found


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="brimfold.plans.tracker")
    parser.add_argument("root")
    kinds = parser.add_subparsers(dest="kind", required=True)
    apply = kinds.add_parser("applications").add_subparsers(dest="command", required=True)
    one = apply.add_parser("set")
    for name in ("--job-key", "--company", "--position", "--status", "--date", "--job-url", "--notes"):
        one.add_argument(name, required=name == "--job-key")
    one.add_argument("--score", type=int)
    apply.add_parser("list")
    apply.add_parser("export")
    judge = kinds.add_parser("review").add_subparsers(dest="command", required=True)
    mark = judge.add_parser("mark")
    mark.add_argument("--job-key", required=True)
    mark.add_argument("--verdict", required=True)
    mark.add_argument("--notes", default="")
    missed = judge.add_parser("missed")
    for name in ("--company", "--position", "--url"):
        missed.add_argument(name, required=True)
    missed.add_argument("--found-date", default=dt.date.today().isoformat())
    missed.add_argument("--reason", default="")
    missed.add_argument("--notes", default="")
    judge.add_parser("list")
    judge.add_parser("report").add_argument("--runs", required=True)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    try:
        t = Tracker(SparkSession.builder.getOrCreate(), a.root)
        if (a.kind, a.command) == ("applications", "set"):
            t.set_application(now, job_key=a.job_key.strip(), company=a.company, position=a.position, status=a.status, score=a.score, application_date=a.date, job_url=a.job_url, notes=a.notes)
        elif (a.kind, a.command) == ("applications", "list"):
            for r in bounded_rows(t.applications.read().orderBy("job_key"), MOST, "list of applications"):
                print(f"{r.status:<20} {r.company} | {r.position} | {r.application_date or '-'}")
        elif (a.kind, a.command) == ("applications", "export"):
            print(t.export())
        elif a.command == "mark":
            t.mark(now, a.job_key.strip(), a.verdict, a.notes)
        elif a.command == "missed":
            t.miss(now, a.company, a.position, a.url, a.found_date, a.reason, a.notes)
        elif a.command == "list":
            both = t.reviews.read().select("verdict", "company", "position").unionByName(t.missed.read().select(F.lit("MISSED").alias("verdict"), "company", "position"))
            for r in bounded_rows(both.orderBy("verdict", "company", "position"), MOST, "list of reviews"):
                print(f"{r.verdict:<15} {r.company} | {r.position}")
        else:
            for r in t.report(t.spark.read.parquet(a.runs), now[:10]).collect():
                print(f"{r.metric}: {r.value}")
        return 0
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
