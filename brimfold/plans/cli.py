"""``python -m brimfold.plans.cli CONFIG``: one run over landed payloads. Exit status 0, 1 on an error, 2 if every source failed.

CONFIG is a JSON document: {"sources": [{"kind", "path", "enabled"?, "employer"?}], "state", "out", "now", "accept": [..],
"veto": [..], "report"?, "expire_days"?, "alert"?: {"statuses", "least", "limit"}, "feeds_more"?}. Kinds: arbeitnow, remotive,
greenhouse, ashby, lever, recruitee, personio (with "employer", "company"?, "language"?), and feed (with "feeds", "host",
"path_part", "topic", "call"). ``urls`` in place of ``path`` fetches a source of one address, following its pages.
All paths are Hadoop paths but CONFIG itself. Outputs below ``out``: postings and events (archived by day), report.json,
report.md, handoff.json, alert.json, sources.json, families.json; ``state``, ``out``/health and ``out``/history are replaced as a whole.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.operators.reporting import alert, family_counts, handoff, jobs_by_source
from brimfold.operators.state import last_rows, update_health
from brimfold.operators.summaries import all_failed, source_status
from brimfold.plans import pipeline
from brimfold.plans.shared import discard, materialize
from brimfold.sources import feeds, providers, sinks
from brimfold.sources.rest import fetched

KEYED = {"greenhouse": ("boards", "jobs"), "ashby": ("boards", "jobs"), "lever": ("sites", None), "recruitee": ("subdomains", "offers")}
STATE = "job_key string, first_seen timestamp, last_seen timestamp, content_hash string, status string"
HEALTH = "key string, failures int, http_status int, next_retry_at timestamp"
HISTORY = "generated_at string, postings bigint, new_jobs bigint, failed_sources bigint"
#: Runs the history keeps.
MOST_RUNS = 400


class ConfigurationError(ValueError):
    """A configuration that can't be run."""


def _feed(spark: SparkSession, s: dict, more: str) -> tuple[DataFrame, DataFrame]:
    listed = feeds.configured_feeds(s.get("feeds", []), more)
    return feeds.collect_feeds(spark, listed, s["host"], s.get("path_part", "/"), s["topic"], s["call"], int(s.get("max_items", 50)))


def collect(spark: SparkSession, sources: list[dict], more_feeds: str = "") -> tuple[DataFrame, DataFrame]:
    """(raw postings with _ord, collection log) of the enabled sources, in their order."""
    parts, logs = [], []
    for s in sources:
        kind = s.get("kind")
        if not s.get("enabled", True):
            continue
        if kind == "feed":
            rows, log = _feed(spark, s, more_feeds)
        elif kind == "personio":
            rows = providers.personio(spark, s["path"], s["employer"], s.get("company", ""), s.get("language", "en"))
            log = rows.agg(F.count("*").alias("jobs")).select(F.lit(kind).alias("source"), F.lit(s["employer"]).alias("employer"), F.lit(True).alias("ok"), "jobs", F.lit(1).cast("bigint").alias("requests"), F.lit(None).cast("int").alias("http_status"), F.lit("").alias("error"))
        elif kind in providers.SCHEMAS:
            if "urls" in s:  # asked once; all readings are of the written answers
                answers = materialize(fetched(spark, s["urls"], max_pages=s.get("max_pages", 8), page_param=s.get("page_param", ""), workers=s.get("workers", 6)), "answers")
                docs = providers.parsed(answers, kind)
            else:
                docs = providers.payloads(spark, s["path"], kind)
            rows = getattr(providers, kind)(docs)
            log = providers.collection_log(docs, kind, *KEYED.get(kind, ()))
        else:
            raise ConfigurationError(f"unknown source: {kind}")
        parts.append(rows)
        logs.append(log)
    if not parts:
        raise ConfigurationError("no source is enabled")
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    return providers.union_sources(parts), log


def run(spark: SparkSession, config: dict) -> int:
    now = dt.datetime.fromisoformat(config["now"].replace("Z", "+00:00")).astimezone(dt.timezone.utc).replace(tzinfo=None)
    at, day, out = F.lit(now).cast("timestamp"), F.lit(now.date().isoformat()).alias("run_date"), config["out"].rstrip("/")
    raw, log = collect(spark, config["sources"], os.environ.get(config.get("feeds_more", ""), "") if config.get("feeds_more") else "")
    log = materialize(log, "log")
    status = materialize(source_status(log), "status")
    failed = all_failed(status).first().all_failed
    state = sinks.SwappedTable(spark, config["state"], STATE)
    order = [F.col("published_at").desc(), F.col("_ord")]
    done = pipeline.run(raw, state.read(), at, config["accept"], config.get("veto", []), order, config.get("report", 50), config.get("expire_days", 30), not failed)
    postings = materialize(done["postings"], "postings")
    sinks.archive(postings.select("*", day), f"{out}/postings", "run_date")
    sinks.archive(done["events"].select("*", day), f"{out}/events", "run_date")

    report = materialize(done["report"].select("report_number", "job_key", "title", "company", "location", "working_model", "status", "published_at", "url"), "report").orderBy("report_number")
    sinks.list_json(report, f"{out}/report.json")
    sinks.list_json(handoff(report, ["job_key", "title", "company", "url"]), f"{out}/handoff.json")
    sinks.list_json(status.join(jobs_by_source(log).select("source"), "source", "left_semi").orderBy("source"), f"{out}/sources.json")
    sinks.list_json(family_counts(postings, "employment_type", "_ord"), f"{out}/families.json")
    wanted = config.get("alert", {})
    scored = postings.select("*", F.lit(100).alias("score"), F.lit(None).cast("string").alias("application_status"), F.lit(False).alias("priority"), F.lit("").alias("recommendation"), F.lit(None).cast("string").alias("family"), F.array().cast("array<string>").alias("reasons"), F.array().cast("array<string>").alias("warnings"))
    jobs, counts = alert(scored, wanted.get("statuses", ["NEW", "UPDATED"]), int(wanted.get("least", 0)), int(wanted.get("limit", 10)))
    told = counts.first().asDict()
    sinks.put_json(spark, f"{out}/alert.json", told | {"generated_at": config["now"], "has_alert": told["included_count"] > 0, "jobs": [json.loads(r[0]) for r in jobs.select(F.to_json(F.struct("*"))).collect()]})
    heads = {"report_number": "No.", "title": "Title", "company": "Company", "location": "Location", "status": "Status", "url": "Link"}
    sections = [("Postings", report, heads), ("Sources", status.orderBy("source"), {"source": "Source", "status": "Status", "jobs": "Postings", "failed_count": "Failed"})]
    sinks.put_text(spark, f"{out}/report.md", sinks.markdown_document(f"Run of {now.date()}", {"postings": postings.count(), "new": told["candidate_count"]}, sections))

    health = sinks.SwappedTable(spark, f"{out}/health", HEALTH)
    scanned = log.where("employer is not null").groupBy(F.concat_ws(":", F.lower("source"), F.lower("employer")).alias("key")).agg(F.bool_and("ok").alias("ok"), F.max("http_status").alias("http_status"))
    health.replace(update_health(health.read(), scanned, at))
    history = sinks.SwappedTable(spark, f"{out}/history", HISTORY)
    this = status.agg(F.count_if(F.col("status") == "failed").alias("failed_sources")).select(F.lit(config["now"]).alias("generated_at"), F.lit(postings.count()).cast("bigint").alias("postings"), F.lit(told["candidate_count"]).cast("bigint").alias("new_jobs"), "failed_sources")
    history.replace(last_rows(history.read().unionByName(this), [F.col("generated_at").desc()], MOST_RUNS))
    state.replace(done["state"])
    for table in (log, status, postings, report):
        discard(table)
    return 2 if failed else 0


def main(argv: list[str] | None = None) -> int:
    try:
        config = json.loads(Path((argv or sys.argv[1:])[0]).read_text(encoding="utf-8"))
        if not isinstance(config, dict):
            raise ConfigurationError("the configuration is no JSON object")
        return run(SparkSession.builder.getOrCreate(), config)
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
