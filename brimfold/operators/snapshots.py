"""Changes between full deliveries of a table.

A ``SnapshotIndex`` is a folder that outlives the session: key -> 128-bit hash of the compared columns, bucketed by
key, for the delivery applied last. ``apply`` writes the index of a new delivery beside it, probes the old one with
it bucket by bucket, without a shuffle of the old side, and then swaps: a pointer file is replaced in one step and the
old index deleted. A run that fails before the swap leaves the old index as it was. Old values are fetched only
for keys that changed.

Defined results: a null key takes no part. Rows that repeat a key within one delivery count once (the
greatest hash decides if their values differ, the same way in every run). Null, empty and any other
value differ from each other. An empty delivery removes every key. Extra columns are ignored. Columns of any type
can be compared.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brimfold.plans.shared import bounded_rows, discard, drop_path, materialize, new_path
from brimfold.sources.files import HadoopFiles

MAX_DELIVERIES = 10_000  # dates on the driver, not rows
#: Keys of a bucket, about 30 MB; buckets are a power of two, so that an index of another size still joins without a full shuffle.
BUCKET_KEYS, MAX_BUCKETS = 500_000, 65_536


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return value
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string").cast("binary")
    return (value.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(value))).cast("binary")


def value_hash(df: DataFrame, *columns: str) -> Column:
    """md5 of the stored values of these columns; null has a mark of its own."""
    kinds = df.select(*columns).schema.fields
    parts = [F.coalesce(F.md5(_bytes(F.col(c), f.dataType)), F.lit("null")) for c, f in zip(columns, kinds)]
    return parts[0] if len(parts) == 1 else F.md5(F.concat_ws("|", *parts).cast("binary"))


def hashed(df: DataFrame, key: str, *columns: str, by: str | None = None) -> DataFrame:
    """(_k, _h[, _d]) of a delivery, or of all deliveries named by ``by``; a key repeated in a third of the rows is combined before the shuffle."""
    extra = [F.col(by).alias("_d")] if by else []
    rows = df.select(F.col(key).alias("_k"), value_hash(df, *columns).alias("_h"), *extra).where("_k is not null")
    return rows.groupBy("_k", *(["_d"] if by else [])).agg(F.max("_h").alias("_h"))


def buckets_for(keys: int) -> int:
    """About BUCKET_KEYS keys a bucket, as a power of two."""
    return min(MAX_BUCKETS, 1 << max(0, -(-keys // BUCKET_KEYS) - 1).bit_length())


class SnapshotIndex:
    """The key-to-hash index of the delivery applied last, in the folder ``path`` that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, values: str | list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.values = [values] if isinstance(values, str) else list(values)
        self.files = HadoopFiles(spark)
        self._tables: list[str] = []

    def _current(self) -> dict | None:
        text = self.files.read_text(f"{self.path}/CURRENT")
        return json.loads(text) if text else None

    def _table(self, folder: str, kind: str, buckets: int) -> DataFrame:
        """The bucketed files of ``folder`` as a table of this session."""
        name = f"brimfold_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (_k {kind}, _h STRING) USING parquet CLUSTERED BY (_k) SORTED BY (_k) INTO {buckets} BUCKETS LOCATION '{folder}'")
        self._tables.append(name)
        return self.spark.table(name)

    def current(self) -> DataFrame | None:
        """(_k, _h) of the delivery applied last, by whichever session; None before the first."""
        now = self._current()
        return self._table(f"{self.path}/{now['index']}", now["kind"], now["buckets"]) if now else None

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, DataFrame]:
        folder, name = f"index-{uuid.uuid4().hex}", f"brimfold_index_{uuid.uuid4().hex}"
        rows.select("_k", "_h").repartition(buckets, "_k").write.bucketBy(buckets, "_k").sortBy("_k").format("parquet").option("path", f"{self.path}/{folder}").saveAsTable(name)
        self._tables.append(name)
        return folder, self.spark.table(name)

    def apply(self, delivery: DataFrame) -> DataFrame:
        """(key, change) of ``delivery`` against the index; afterwards the index is the delivery's."""
        rows = materialize(hashed(delivery, self.key, *self.values), "delivery")
        changes = self.apply_hashed(rows, rows.count(), lambda found: materialize(found, "changes"))
        discard(rows)
        return changes

    def apply_hashed(self, rows: DataFrame, keys: int, keep):
        """``apply`` of ``keys`` rows that ``hashed`` made; ``keep`` gets the changes and writes them, before the old index goes."""
        kind = rows.schema["_k"].dataType.simpleString()
        now, old = self._current(), self.current()
        for left in self.files.folders(self.path):  # of a run that ended before its swap
            if left.startswith("index-") and left != (now or {}).get("index"):
                self.files.delete(f"{self.path}/{left}")
        buckets = buckets_for(keys)
        folder, new = self._write(rows, buckets)
        if old is None:
            changes = new.select(F.col("_k").alias(self.key), F.lit("added").alias("change"))
        else:
            o, n = old.select("_k", F.col("_h").alias("_old")), new.select("_k", F.col("_h").alias("_new"))
            kinds = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
            changes = o.join(n, "_k", "full_outer").select(F.col("_k").alias(self.key), kinds.alias("change")).where("change is not null")
        kept = keep(changes)
        self.files.replace_text(f"{self.path}/CURRENT", json.dumps({"index": folder, "kind": kind, "buckets": buckets, "keys": keys}))
        for name in self._tables:  # of the catalog only; the new index stays where it is
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        if now:
            self.files.delete(f"{self.path}/{now['index']}")
        return kept


def _days(df: DataFrame, delivery: str) -> list:
    return sorted(r[0] for r in bounded_rows(df.select(F.col(delivery).alias("_d")).where("_d is not null").distinct(), MAX_DELIVERIES, "list of deliveries"))


def delivery_changes(df: DataFrame, delivery: str, key: str, values: str | list[str], path: str | None = None) -> DataFrame:
    """(delivery, key, change) for each delivery but the first, against the delivery before it in the table.

    The deliveries are hashed in one scan and applied to a ``SnapshotIndex`` one after the other; ``path`` keeps the
    index of the last one. A null ``delivery`` takes no part. With an index at ``path`` from before, the first delivery
    is compared with it.
    """
    spark = df.sparkSession
    columns = [values] if isinstance(values, str) else list(values)
    kinds = df.select(F.col(delivery), F.col(key)).schema.fields
    own = path or new_path(spark, "index")
    index = SnapshotIndex(spark, own, key, columns)
    begun = index._current() is not None
    every = new_path(spark, "deliveries")
    hashed(df.where(F.col(delivery).isNotNull()), key, *columns, by=delivery).write.partitionBy("_d").parquet(every)
    rows = spark.read.schema(T.StructType([T.StructField("_k", kinds[1].dataType), T.StructField("_h", T.StringType()), T.StructField("_d", kinds[0].dataType)])).parquet(every)
    counted = sorted((r["_d"], r["n"]) for r in bounded_rows(rows.groupBy("_d").agg(F.count("*").alias("n")), MAX_DELIVERIES, "list of deliveries"))
    # a delivery whose keys are all null is empty, and still one of the deliveries
    sizes = dict.fromkeys(_days(df, delivery), 0) | dict(counted)
    out = new_path(spark, "changes")
    empty = T.StructType([*kinds, T.StructField("change", T.StringType())])
    spark.createDataFrame([], empty).write.parquet(out)
    for day, size in sorted(sizes.items()):
        dated = lambda found, day=day: found.select(F.lit(day).cast(kinds[0].dataType).alias(delivery), key, "change").write.mode("append").parquet(out)
        index.apply_hashed(rows.where(F.col("_d") == F.lit(day)), size, dated if begun else lambda found: None)
        begun = True
    drop_path(spark, every)
    if not path:
        drop_path(spark, own)
    return spark.read.schema(empty).parquet(out)


def with_values(changes: DataFrame, df: DataFrame, delivery: str, key: str, value: str) -> DataFrame:
    """Old and new values of the ``changed`` keys only: (delivery, key, old_value, new_value). Among rows that repeat a key, that of the greatest hash, as in the index."""
    kind = df.select(value).schema[0].dataType
    days = df.select(F.col(delivery).alias("_d")).where("_d is not null").distinct()
    # the delivery before each one, by a join with at most MAX_DELIVERIES dates
    order = _days(df, delivery)
    before = df.sparkSession.createDataFrame(list(zip(order[1:], order)), T.StructType([T.StructField("_d", days.schema[0].dataType), T.StructField("_b", days.schema[0].dataType)]))
    wanted = changes.where("change = 'changed'").select(F.col(delivery).alias("_d"), F.col(key).alias("_k")).join(before, "_d")
    need = wanted.select("_k", F.explode(F.array("_d", "_b")).alias("_at")).distinct()
    rows = df.select(F.col(key).alias("_k"), F.col(delivery).alias("_at"), F.col(value).alias("_v"), value_hash(df, value).alias("_h"))
    values = rows.join(need, ["_k", "_at"], "left_semi").groupBy("_k", "_at").agg(F.max_by(F.struct("_v"), "_h").alias("_s")).select("_k", "_at", F.col("_s._v").cast(kind).alias("_v"))
    old = values.select("_k", F.col("_at").alias("_b"), F.col("_v").alias("old_value"))
    new = values.select("_k", F.col("_at").alias("_d"), F.col("_v").alias("new_value"))
    return wanted.join(new, ["_k", "_d"], "left").join(old, ["_k", "_b"], "left").select(F.col("_d").alias(delivery), F.col("_k").alias(key), "old_value", "new_value")
