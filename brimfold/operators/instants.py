"""Mixed timestamp formats and time zones to one UTC instant per posting.

Values without a zone get the zone that fits best: for each zone of a candidate list (with its whole
history of offsets) the local times are aligned with the ingestion times, and the zone is taken under
which the fewest lie outside the delays that the feed's zoned values show (ties: the least time outside). A declared zone
is only where that starts from: it yields to another one if the values that violate one of the two and not the other
say so by more than SURE standard errors. In the same way a part of the feed (``by``, a site or an office) may have a
zone of its own.

Defined results: null, blank and unreadable values and impossible dates name no instant and give no row.
A null key takes no part. Of repeated deliveries of a key the latest with a readable value counts (ties:
the smallest instant). Without zoned values to compare with, a violation is an instant after its ingestion
or more than a day before it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimfold.functions.instants import epoch_micros, instant, trimmed, with_wall_clock
from brimfold.plans.shared import bounded_rows, materialize

# One zone for each offset history among the places postings come from.
CANDIDATES = ("UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney")
HOUR = 3_600_000_000
DAY = 24 * HOUR
SURE = 3.0
STEPS = 200
MAX_GROUPS = 100_000


def read_instants(df: DataFrame, key: str, value: str, ingested: str, day_first: bool, by: str | None = None) -> DataFrame:
    """(_key, _by, _at, _clock, _zone, _number) of each row; _clock and _number are null where nothing can be read."""
    rows = df.select((F.col(by) if by else F.lit(None)).cast("string").alias("_by"), F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(ingested).cast("timestamp")).alias("_at"), trimmed(F.col(value).cast("string")).alias("_text"))
    rows = with_wall_clock(rows.withColumn("_number", epoch_micros(F.col("_text"))), "_text", day_first, "_clock", "_zone")
    # written once, as it is read for the delays, the violations and the result
    return materialize(rows.select("_key", "_by", "_at", "_number", "_clock", "_zone"), "instants").where("_key is not null and (_number is not null or _clock is not null)")


def usual_delays(rows: DataFrame) -> tuple[int, int]:
    """Between which delays the bulk of the zoned values lies: of all pairs of quantiles the one with the most mass per root of its width."""
    zoned = rows.where("_number is not null or _zone is not null").select((F.col("_at") - F.coalesce("_number", instant(F.col("_clock"), F.col("_zone")))).alias("_lag"))
    q = zoned.agg(F.percentile_approx("_lag", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), 4000).alias("q")).first()["q"]
    if not q:
        return 0, DAY
    pairs = ((a, b) for a in range(STEPS + 1) for b in range(a + STEPS // 2, STEPS + 1))
    a, b = max(pairs, key=lambda p: (p[1] - p[0]) / max(q[p[1]] - q[p[0]], HOUR // 60) ** 0.5)
    return q[a], q[b]


def _violations(rows: DataFrame, zones: tuple[str, ...], reference: str, groups: bool) -> list[dict]:
    """Per group, or of all rows: n zoneless values, and of each zone the violations, the time outside (``zone|t``), and the values that
    violate only the reference (``zone|won``) or only this zone (``zone|lost``). One pass for all zones. Dates without a time of day say nothing about hours and are left out."""
    low, high = usual_delays(rows)
    bare = rows.where("_number is null and _zone is null and _clock not like '% 00:00:00.0'")
    lag = {z: F.col("_at") - instant(F.col("_clock"), F.lit(z)) for z in zones}
    bad = {z: (lag[z] < low) | (lag[z] > high) for z in zones}
    out = {z: F.least(F.greatest(F.lit(low) - lag[z], lag[z] - F.lit(high), F.lit(0)), F.lit(DAY)) for z in zones}
    counts = [c.alias(f"{z}{name}") for z in zones for name, c in (("", F.count_if(bad[z])), ("|t", F.coalesce(F.sum(out[z]), F.lit(0))), ("|won", F.count_if(bad[reference] & ~bad[z])), ("|lost", F.count_if(~bad[reference] & bad[z])))]
    every = [F.count_if(lag[reference].isNotNull()).alias("n"), *counts]
    if not groups:
        return [bare.agg(*every).first().asDict()]
    return [r.asDict() for r in bounded_rows(bare.where("_by is not null").groupBy("_by").agg(*every), MAX_GROUPS, "list of parts of the feed")]


def _chosen(found: dict, zones: tuple[str, ...], reference: str | None) -> str:
    best = min(zones, key=lambda z: (found[z], found[f"{z}|t"], zones.index(z)))
    won, lost = found[f"{best}|won"], found[f"{best}|lost"]
    return best if reference is None or won - lost > SURE * (won + lost) ** 0.5 else reference


def zone_violations(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> dict:
    """{"n": zoneless values, zone: violations}."""
    found = _violations(rows, candidates, candidates[0], False)[0]
    return {x: found[x] for x in ("n", *candidates)}


def estimate_zone(rows: DataFrame, declared: str | None = None, candidates: tuple[str, ...] = CANDIDATES) -> str:
    """The zone of the values written without one."""
    zones = (declared, *[z for z in candidates if z != declared]) if declared else candidates
    return _chosen(_violations(rows, zones, zones[0], False)[0], zones, declared)


def zones_of_parts(rows: DataFrame, zone: str, candidates: tuple[str, ...] = CANDIDATES) -> dict[str, str]:
    """Parts of the feed whose zone is not ``zone``, with theirs."""
    zones = (zone, *[z for z in candidates if z != zone])
    found = {r["_by"]: _chosen(r, zones, zone) for r in _violations(rows, zones, zone, True)}
    return {part: z for part, z in found.items() if z != zone}


def normalise_instants(df: DataFrame, key: str, value: str, ingested: str, declared: str | None = None, day_first: bool = True, by: str | None = None) -> DataFrame:
    """(row_key, utc_micros): one row per key whose value names a valid instant."""
    rows = read_instants(df, key, value, ingested, day_first, by)
    zone = estimate_zone(rows, declared)
    bare = F.lit(zone)
    if by and (other := zones_of_parts(rows, zone)):
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(list(other.items()), "_by string, _own string")), "_by", "left")
        bare = F.coalesce("_own", bare)
    at = F.coalesce("_number", instant(F.col("_clock"), F.coalesce("_zone", bare)))
    good = rows.select("_key", "_at", at.alias("_utc")).where("_utc is not null")
    return good.groupBy("_key").agg(F.max_by("_utc", F.struct(F.coalesce("_at", F.lit(-(2**62))), -F.col("_utc"))).alias("utc_micros")).select(F.col("_key").alias("row_key"), "utc_micros")
