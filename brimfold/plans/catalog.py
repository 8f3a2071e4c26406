"""Queries over the driver's tables, and the same queries as DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions import instants
from brimfold.operators.instants import normalise_instants
from brimfold.operators.snapshots import delivery_changes, with_values
from brimfold.plans import table_queries, text_queries
from brimfold.sources.tables import table

#: feed: key, value, whether slashed dates begin with the day. The zones of values without one are estimated.
FEED_INSTANTS = {"remotive": ("id", "publication_date", True), "arbeitnow": ("slug", "created_at", True), "lever": ("id", "createdAt", False)}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The deliveries, applied one after the other to a key-to-hash index that is swapped each time."""
    rows = table(spark, folder, "remotive_snapshots", "snapshot_date", "id", "description")
    return delivery_changes(rows, "snapshot_date", "id", "description").select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "id", "change")


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the old and the new description of each changed posting; the texts are fetched for these only."""
    rows = table(spark, folder, "remotive_snapshots", "snapshot_date", "id", "description")
    changes = delivery_changes(rows, "snapshot_date", "id", "description")
    md5 = lambda c: F.coalesce(F.md5(c), F.lit("null"))
    return with_values(changes, rows, "snapshot_date", "id", "description").select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "id", md5("old_value").alias("old_md5"), md5("new_value").alias("new_md5"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for feed, (key, value, day_first) in FEED_INSTANTS.items():
        part = normalise_instants(table(spark, folder, feed, key, value, "fetched_at"), key, value, "fetched_at", None, day_first)
        part = part.select(F.lit(feed).alias("feed"), "row_key", "utc_micros")
        out = part if out is None else out.unionByName(part)
    return out


_DELIVERIES = """
WITH r AS (SELECT DISTINCT snapshot_date, id, description FROM remotive_snapshots WHERE snapshot_date IS NOT NULL AND id IS NOT NULL),
d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS k FROM (SELECT DISTINCT snapshot_date FROM r)),
e AS (SELECT k, id, description FROM r JOIN d USING (snapshot_date)),
x AS (SELECT coalesce(n.k, o.k + 1) AS k, coalesce(n.id, o.id) AS id, o.description AS old_value, n.description AS new_value,
        CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.description IS DISTINCT FROM n.description THEN 'changed' END AS change
      FROM e n FULL JOIN e o ON n.k = o.k + 1 AND n.id = o.id)
"""

#: What a feed's zone is known to be, for the SQL of p4_found alone; the query estimates it.
KNOWN_ZONES = {"remotive": "UTC", "arbeitnow": "Europe/Berlin", "lever": "America/New_York"}


def _instants_sql(feed: str, key: str, value: str, day_first: bool) -> str:
    """The instants of one feed in SQL, step by step as in ``functions.instants``; of a local time that occurs twice the first."""
    forms = [*instants._FORMS, (instants._SLASH, "$3|$2|$1|$4|$5|$6|$7|$8|$9" if day_first else "$3|$1|$2|$4|$5|$6|$7|$8|$9")]
    fields = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{w.replace('$', chr(92))}')" for p, w in forms) + " END"
    pick = lambda x, table: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    number = rf"CASE WHEN regexp_matches(t, '^[+\-]?\d+(\.\d*)?([eE][+]?\d{{1,2}})?$') AND NOT regexp_matches(t, '{instants._FORMS[3][0]}') THEN try_cast(t AS DOUBLE) END"
    blank = r"[\s\p{Z}\x{FEFF}\x0B\x{85}]+"
    return rf"""SELECT '{feed}' AS feed, row_key, arg_max(utc, (coalesce(seen, -4611686018427387904), -utc)) AS utc_micros FROM (
        WITH a AS (SELECT {key}::varchar AS row_key, epoch_us(fetched_at) AS seen, regexp_replace({value}, '^{blank}|{blank}$', '', 'g') AS t FROM {feed}),
        b AS (SELECT *, {number} AS d, CASE WHEN regexp_matches(t, '^[+\-]?\d{{1,18}}$') THEN try_cast(t AS BIGINT) END AS x, string_split({fields}, '|') AS f FROM a WHERE t IS NOT NULL),
        c AS (SELECT *, CASE WHEN d IS NULL THEN NULL WHEN x IS NOT NULL THEN CASE WHEN abs(d) < 1e11 THEN x * 1000000 WHEN abs(d) < 1e14 THEN x * 1000 WHEN abs(d) < 1e17 THEN x ELSE floor(x::double / 1000)::bigint END
                WHEN abs(d) < 1e11 THEN round(d * 1e6)::bigint WHEN abs(d) < 1e14 THEN round(d * 1e3)::bigint WHEN abs(d) < 1e17 THEN round(d)::bigint WHEN abs(d) < 1e20 THEN floor(d / 1e3)::bigint END AS epoch,
            CASE WHEN length(f[1]) = 2 THEN '20' || f[1] ELSE f[1] END AS y, coalesce(try_cast(f[2] AS INT), ({pick("lower(f[2][1:3])", instants.MONTHS)})::int) AS m, try_cast(f[3] AS INT) AS dd, coalesce(try_cast(f[4] AS INT), 0) AS h0, coalesce(try_cast(nullif(f[5], '') AS INT), 0) AS mi, coalesce(try_cast(nullif(f[6], '') AS INT), 0) AS s, coalesce(nullif(f[7], ''), '0')[1:6] AS frac,
            lower(f[8]) AS half, regexp_extract(f[9], '^[+\-]\d{{2}}:?(?:\d{{2}})?', 0) AS off, regexp_extract(f[9], '\[?([A-Za-z_+\-0-9/]*)\]?$', 1) AS named FROM b),
        e AS (SELECT *, CASE WHEN coalesce(half, '') = '' THEN h0 WHEN h0 < 1 OR h0 > 12 THEN 99 ELSE h0 % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS h,
            CASE WHEN f[9] = '' THEN '' WHEN off <> '' THEN off[1:3] || ':' || rpad(replace(off, ':', ''), 5, '0')[4:5] ELSE coalesce({pick("upper(named)", instants.ABBREVIATIONS)}, named) END AS zone FROM c),
        g AS (SELECT *, CASE WHEN f IS NOT NULL AND h < 24 AND mi < 60 AND s < 60 THEN try_cast(format('{{}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}.{{}}', y, m, dd, h, mi, s, frac) AS TIMESTAMP) END AS wall, CASE WHEN zone = '' THEN '{KNOWN_ZONES[feed]}' ELSE zone END AS z FROM e)
        SELECT row_key, seen, coalesce(epoch, CASE WHEN regexp_matches(z, '^[+\-]') THEN epoch_us(wall) - (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::bigint * 3600 + z[5:6]::bigint * 60) * 1000000
            WHEN n.name IS NOT NULL THEN least(epoch_us(timezone(n.name, wall)), epoch_us(timezone(n.name, wall - INTERVAL 1 HOUR)) + 3600000000) END) AS utc FROM g LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) n ON n.name = g.z)
        WHERE row_key IS NOT NULL AND utc IS NOT NULL GROUP BY row_key"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found} | text_queries.QUERIES | table_queries.QUERIES

SQL: dict[str, str] = text_queries.SQL | table_queries.SQL | {
    "p2_found": _DELIVERIES + "SELECT strftime(d.snapshot_date, '%Y-%m-%d') AS snapshot_date, x.id, x.change FROM x JOIN d ON d.k = x.k WHERE x.k > 1 AND x.change IS NOT NULL",
    "p2_values": _DELIVERIES + "SELECT strftime(d.snapshot_date, '%Y-%m-%d') AS snapshot_date, x.id, coalesce(md5(old_value), 'null') AS old_md5, coalesce(md5(new_value), 'null') AS new_md5 FROM x JOIN d ON d.k = x.k WHERE x.k > 1 AND x.change = 'changed'",
    "p4_found": " UNION ALL ".join(f"({_instants_sql(feed, *rest)})" for feed, rest in FEED_INSTANTS.items()),
}
