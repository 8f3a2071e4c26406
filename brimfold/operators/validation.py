"""Rules on records, as a frame of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimfold.operators.rules import reasons


class InvalidRecords(ValueError):
    """Records that break a rule."""


def required(name: str) -> tuple[Column, Column]:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == "", F.lit(f"{name}: missing")


def one_of(name: str, values: list[str]) -> tuple[Column, Column]:
    return F.col(name).isNotNull() & ~F.col(name).isin(values), F.lit(f"{name}: not allowed")


def between(name: str, low: float, high: float) -> tuple[Column, Column]:
    value = F.col(name).try_cast("double")
    return F.col(name).isNotNull() & (value.isNull() | (value < low) | (value > high)), F.lit(f"{name}: out of range")


def iso_date(name: str) -> tuple[Column, Column]:
    text = F.col(name).cast("string")
    return (F.coalesce(text, F.lit("")) != "") & (~text.rlike(r"^\d{4}-\d{2}-\d{2}$") | text.try_cast("date").isNull()), F.lit(f"{name}: no date")


def iso_moment(name: str) -> tuple[Column, Column]:
    """A date, or a date with a time of day and perhaps a zone."""
    text = F.col(name).cast("string")
    return (F.coalesce(text, F.lit("")) != "") & (~text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$") | text.try_cast("timestamp").isNull()), F.lit(f"{name}: no date or instant")


def web_address(name: str) -> tuple[Column, Column]:
    return F.col(name).isNotNull() & ~F.lower(F.col(name)).rlike("^https?://"), F.lit(f"{name}: no http address")


def required_if(name: str, condition: Column) -> tuple[Column, Column]:
    return condition & required(name)[0], F.lit(f"{name}: missing in this state")


def violations(df: DataFrame, key: str, rules: list[tuple[Column, Column]], unique: list[list[Column]] | None = None) -> DataFrame:
    """(key, rule): one row per broken rule; ``unique`` lists expressions that must not repeat (null ones are ignored)."""
    out = df.select(F.col(key), F.explode(reasons(rules)).alias("rule"))
    for columns in unique or []:
        named = [c.alias(f"_u{i}") for i, c in enumerate(columns)]
        rows = df.select(F.col(key), *named).dropna(subset=[f"_u{i}" for i in range(len(columns))])
        often = rows.groupBy(*[f"_u{i}" for i in range(len(columns))]).agg(F.count("*").alias("_n")).where("_n > 1")
        out = out.unionByName(rows.join(often, [f"_u{i}" for i in range(len(columns))], "left_semi").select(key, F.lit("not unique").alias("rule")))
    return out


def require_valid(found: DataFrame, what: str) -> None:
    """An error that names the first broken rules, if there are any."""
    first = found.limit(5).collect()
    if first:
        raise InvalidRecords(f"{what}: " + "; ".join(f"{r[0]}: {r[1]}" for r in first))


def partial_update(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` with the non-null fields of ``updates`` put in; keys that are new are added."""
    fields = [c for c in table.columns if c != key]
    both = table.join(updates.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in fields if c in updates.columns]), key, "full_outer")
    return both.select(key, *[F.coalesce(f"_n_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in fields])
