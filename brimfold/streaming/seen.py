"""Seen-tracking and weekly counts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "job_key string, at timestamp, event string"
_STATE = "content_hash string, last_seen timestamp, removed boolean"


def _expire(days: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = []
        if state.hasTimedOut:
            content, last, _ = state.get
            state.update((content, last, True))
            events.append((key[0], pd.Timestamp(last) + pd.Timedelta(days=days), "REMOVED"))
        else:
            rows = pd.concat(list(batches)).sort_values("at")
            content, last, removed = state.get if state.exists else (None, None, False)
            for at, new in zip(rows["at"], rows["content_hash"]):
                if content is None:
                    events.append((key[0], at, "NEW"))
                elif removed or content != new:
                    events.append((key[0], at, "UPDATED"))
                else:
                    events.append((key[0], at, "SEEN_BEFORE"))
                content, last, removed = new, at, False
            state.update((content, last, removed))
            # at the earliest just after the watermark, as a late row may come after its own expiry
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(events, columns=["job_key", "at", "event"])

    return step


def seen_events(observations: DataFrame, expire_days: int, late: str = "1 day") -> DataFrame:
    """Stream of (job_key, at, event): NEW, UPDATED, SEEN_BEFORE per observation, REMOVED when a key isn't seen for ``expire_days`` of event time.

    ``observations``: stream with job_key, at (timestamp), content_hash.
    """
    rows = observations.select("job_key", "at", "content_hash").where("job_key is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("job_key").applyInPandasWithState(_expire(expire_days), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def weekly_counts(observations: DataFrame, kind: str, at: str, late: str = "2 days") -> DataFrame:
    """Stream of (week_start, kind, rows): tumbling calendar weeks from Monday; late rows count until the watermark passes."""
    weeks = F.window(at, "7 days", startTime="4 days")
    return observations.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(weeks.alias("w"), kind).agg(F.count("*").alias("rows")).select(F.col("w.start").cast("date").alias("week_start"), kind, "rows")
