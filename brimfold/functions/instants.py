"""Texts and numbers that name an instant, as (wall clock, zone) in Catalyst expressions.

``with_wall_clock`` rewrites a value to ``yyyy-M-d h:m:s.f`` plus a zone, whatever way it was written;
``instant`` casts both to a timestamp. The cast checks the calendar, takes the first of a local time
that occurs twice, and moves a skipped one forward by the length of the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by their first three letters, English and German.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "mae": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
# Zone abbreviations with a single meaning in the feeds, as offsets.
ABBREVIATIONS = {
    "Z": "+00:00", "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "MEZ": "+01:00", "MESZ": "+02:00",
    "EET": "+02:00", "EEST": "+03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

_ZONE = r"\s*(\[?[A-Za-z][A-Za-z_]*(?:/[A-Za-z_+\-0-9]+)*\]?|[+\-]\d{2}:?(?:\d{2})?(?:\[[A-Za-z_/+\-0-9]+\])?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_NAME = r"([A-Za-zÄäÖöÜü]{3,10})\.?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_DAY = r"(?:[A-Za-zÄäÖöÜü]{2,10}\.?,?\s+)?"

# Each form: pattern, and where year, month, day, hour, minute, second, fraction, half of day and zone are in it.
_FORMS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3|0|0||||"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7"),
    (r"^((?:19|20)\d{2})(\d{2})(\d{2})$", "$1|$2|$3|0|0||||"),
    (rf"^{_DAY}(\d{{1,2}})\.?[\s\-]+{_NAME}[\s\-]+(\d{{4}}),?(?:\s+{_CLOCK}(?:\s*Uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^{_DAY}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2}}|\d{{4}})(?:,?\s+{_CLOCK}(?:\s*Uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
_SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}|\d{{4}})(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?$"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def epoch_micros(text: Column) -> Column:
    """Micros of a number written as seconds, milli-, micro- or nanoseconds since 1970; else null. Dates without separators are no numbers."""
    number = F.when(text.rlike(r"^[+\-]?\d+(\.\d*)?([eE][+]?\d{1,2})?$") & ~text.rlike(_FORMS[3][0]), text.try_cast("double"))
    exact = F.when(text.rlike(r"^[+\-]?\d{1,18}$"), text.try_cast("bigint"))
    size = F.abs(number)
    whole = F.when(size < 1e11, exact * 1_000_000).when(size < 1e14, exact * 1_000).when(size < 1e17, exact).otherwise(F.floor(exact / 1_000).cast("bigint"))
    rounded = F.when(size < 1e11, F.round(number * 1e6)).when(size < 1e14, F.round(number * 1e3)).when(size < 1e17, F.round(number)).when(size < 1e20, F.floor(number / 1e3))
    return F.coalesce(whole, rounded.cast("bigint"))


def with_wall_clock(df: DataFrame, text: str, day_first: bool, clock: str, zone: str) -> DataFrame:
    """Adds ``clock``, the wall clock as text that the cast reads (null if it is no date), and ``zone``, the zone written with it or null.

    ``day_first`` is the custom for dates with slashes; dotted dates begin with the day everywhere. Each step is a
    column of its own, so that no regular expression runs twice for a row.
    """
    forms = [*_FORMS, (_SLASH, "$3|$2|$1|$4|$5|$6|$7|$8|$9" if day_first else "$3|$1|$2|$4|$5|$6|$7|$8|$9")]
    fields = F.lit(None).cast("string")
    for pattern, where in reversed(forms):
        fields = F.when(F.col(text).rlike(pattern), F.regexp_replace(F.col(text), pattern, where)).otherwise(fields)
    df = df.withColumn("_fields", F.split(fields, r"\|", -1))
    part = [F.col("_fields")[i] for i in range(9)]
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    or0 = lambda x: F.when(x == "", "0").otherwise(x)
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = df.withColumns({
        "_month": F.coalesce(part[1].try_cast("int"), months[F.lower(F.substring(part[1], 1, 3))]),
        "_hour": F.coalesce(part[3].try_cast("int"), F.lit(0)),
        "_offset": F.regexp_extract(part[8], r"^[+\-]\d{2}:?(?:\d{2})?", 0),
        "_named": F.regexp_extract(part[8], r"\[?([A-Za-z_+\-0-9/]*)\]?$", 1),
    })
    year = F.when(F.length(part[0]) == 2, F.concat(F.lit("20"), part[0])).otherwise(part[0])
    hour = F.when(F.coalesce(part[7], F.lit("")) == "", F.col("_hour")).when((F.col("_hour") < 1) | (F.col("_hour") > 12), F.lit(99)).otherwise(F.col("_hour") % 12 + F.when(F.lower(part[7]) == "p", 12).otherwise(0))
    minutes = F.substring(F.rpad(F.replace(F.col("_offset"), F.lit(":"), F.lit("")), 5, "0"), 4, 2)
    df = df.withColumns({
        clock: F.format_string("%s-%02d-%02d %02d:%02d:%02d.%s", year, F.col("_month"), part[2].try_cast("int"), hour, or0(part[4]).try_cast("int"), or0(part[5]).try_cast("int"), F.substring(or0(part[6]), 1, 6)),
        zone: F.when(part[8] == "", F.lit(None)).when(F.col("_offset") != "", F.concat(F.substring("_offset", 1, 3), F.lit(":"), minutes)).otherwise(F.coalesce(known[F.upper("_named")], F.col("_named"))),
    })
    return df.withColumn(clock, F.when(F.col("_fields").isNotNull() & F.col("_month").isNotNull(), F.col(clock))).drop("_fields", "_month", "_hour", "_offset", "_named")


def instant(clock: Column, zone: Column) -> Column:
    """Micros since 1970 of a wall clock in a zone; null where the calendar or the zone doesn't exist."""
    return F.unix_micros(F.concat(clock, F.lit(" "), zone).try_cast("timestamp"))
