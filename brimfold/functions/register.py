"""Text operators as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brimfold.functions.text import KEPT, html_to_text


@F.pandas_udf(DoubleType())
def text_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio of two texts, null as the empty text; quadratic in their length."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)], dtype=float)


def register_functions(spark: SparkSession) -> list[str]:
    """Adds ``html_to_text(text)``, ``normalize_text(text)``, ``text_ratio(a, b)`` and ``rate(part, whole)`` to the session; their names."""
    spark.udf.register("html_to_text", html_to_text)
    spark.udf.register("text_ratio", text_ratio)
    bodies = {
        "normalize_text(t STRING) RETURNS STRING": f"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce(t, '')), 'ß', 'ss'), '&', ' and '), '[^{KEPT}]+', ' '), '\\\\s+', ' '))",
        "rate(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole = 0 THEN 0D ELSE bround(100D * part / whole, 1) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["html_to_text", "normalize_text", "rate", "text_ratio"]
