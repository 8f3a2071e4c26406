"""Outputs: small documents replaced in one step, tables swapped by a pointer, partitioned archives, one-file CSV, Markdown
tables of bounded lists. All paths are Hadoop paths, so one ``out`` serves a single machine and a cluster."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions.text import markdown_cell
from brimfold.plans.shared import bounded_rows
from brimfold.sources.files import HadoopFiles

MAX_LISTED = 10_000


class BrokenDocument(RuntimeError):
    """A document that is there, but is not JSON."""


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the old document or the new one."""
    HadoopFiles(spark).replace_text(path, text)


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1) + "\n")


def get_json(spark: SparkSession, path: str, default=None):
    """The document, or ``default`` where there is none; ``BrokenDocument`` where it can't be read as JSON."""
    text = HadoopFiles(spark).read_text(path)
    if text is None:
        return default
    try:
        return json.loads(text)
    except ValueError as e:
        raise BrokenDocument(f"no JSON in {path}: {e}") from e


class SwappedTable:
    """A table in a folder of its own, replaced as a whole: written beside the old version, then a pointer is moved and the old version deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.files = spark, path.rstrip("/"), schema, HadoopFiles(spark)

    def _version(self) -> str | None:
        return (self.files.read_text(f"{self.path}/CURRENT") or "").strip() or None

    def read(self) -> DataFrame:
        """The rows of the current version; none before the first."""
        now = self._version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}") if now else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        """Make ``df``, which may be computed from ``read``, the current version."""
        columns = self.spark.createDataFrame([], self.schema).columns
        new = f"version-{uuid.uuid4().hex}"
        df.select(*columns).write.parquet(f"{self.path}/{new}")
        self.files.replace_text(f"{self.path}/CURRENT", new)
        for left in self.files.folders(self.path):
            if left.startswith("version-") and left != new:
                self.files.delete(f"{self.path}/{left}")


def list_json(df: DataFrame, path: str) -> int:
    """A bounded list (a report, an alert) as one JSON document; how many rows it has."""
    rows = [json.loads(r[0]) for r in bounded_rows(df.select(F.to_json(F.struct("*"))), MAX_LISTED, "list")]
    put_json(df.sparkSession, path, rows)
    return len(rows)


def one_csv(df: DataFrame, columns: list[str], key: str, path: str) -> None:
    """One CSV file with a header, these columns in this order, sorted by key; for tables that fit one file."""
    df.select(*columns).orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def archive(df: DataFrame, path: str, day: str) -> None:
    """Partitioned by day; a second run of a day replaces that day alone."""
    df.write.mode("overwrite").partitionBy(day).option("partitionOverwriteMode", "dynamic").parquet(path)


def markdown_table(df: DataFrame, columns: dict[str, str]) -> str:
    """A bounded list as a Markdown table; ``columns`` maps column to heading. Bars are escaped and line breaks flattened."""
    rows = bounded_rows(df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))), MAX_LISTED, "table")
    return "\n".join(["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns), *[r[0] for r in rows]]) + "\n"


def markdown_document(title: str, facts: dict[str, object], sections: list[tuple[str, DataFrame, dict[str, str]]]) -> str:
    """A heading, a list of facts, and a table for each section (heading, rows, columns); an empty one says so."""
    parts = [f"# {title}\n", "".join(f"- {name}: {value}\n" for name, value in facts.items())]
    for heading, rows, columns in sections:
        table = markdown_table(rows, columns)
        parts.append(f"## {heading}\n\n{table if table.count(chr(10)) > 2 else 'Nothing.' + chr(10)}")
    return "\n".join(parts)
