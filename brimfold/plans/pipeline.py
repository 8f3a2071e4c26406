"""Landed payloads to canonical postings, their state and a report, in one plan per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimfold.functions.text import normalize_text
from brimfold.operators.dedup import deduplicate
from brimfold.operators.postings import normalise_postings
from brimfold.operators.rules import accepted
from brimfold.operators.state import track_seen
from brimfold.operators.summaries import report_queue
from brimfold.plans.shared import materialize


def candidates(raw: DataFrame, accept: list[str], veto: list[str]) -> DataFrame:
    """The title test, before any costly step; it stays in the JVM, right above the scan, which reads all titles (a test of normalised text is not pushed into files)."""
    return raw.where(accepted(normalize_text(F.col("title")), accept, veto))


def run(raw: DataFrame, state: DataFrame, now: Column, accept: list[str], veto: list[str], order: list[Column], report: int = 50, expire_days: int = 30, allow_expiry: bool = True) -> dict[str, DataFrame]:
    """{"postings", "state", "events", "report"} of one run. ``raw`` has the raw schema and _ord."""
    # written once, as the observed postings, the state, the events and the report all read it
    postings = materialize(deduplicate(normalise_postings(candidates(raw, accept, veto)), "_ord"), "postings")
    observed, new_state, events = track_seen(postings, state, now, expire_days, allow_expiry, "_ord")
    fresh = F.col("status").isin("NEW", "UPDATED")
    return {"postings": observed, "state": new_state, "events": events, "report": report_queue(observed, fresh, order, report)}
