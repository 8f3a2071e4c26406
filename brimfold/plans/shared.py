"""Where intermediate results go, and how small tables are checked before they are broadcast.

Executors may be lost at any time, so lineage is cut only by tables in the folder that
``spark.checkpoint.dir`` names, which all executors share. A temporary folder is used only where
that setting is empty and the whole session runs in one process (master ``local``); any other
master without the setting is an error, as executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_own_folders: list[str] = []


class NoSharedFolder(RuntimeError):
    """A cluster session that names no folder all executors share."""


def single_process(master: str) -> bool:
    """Whether driver and executors of this master are one process, and so share every folder."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets a temporary one if there is none and the master is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not single_process(sc.master):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        _own_folders.append(tempfile.mkdtemp(prefix="brimfold-"))
        folder = "file://" + _own_folders[-1]
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``clean_up`` or when the driver ends."""
    path = f"{shared_dir(spark)}/brimfold-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one written table."""
    _written.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session was stopped: what lies on this machine can still go
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def clean_up() -> None:
    """Delete every intermediate table that is still there; to be called before ``spark.stop()`` when its results have been read."""
    for path, spark in list(_written.items()):
        drop_path(spark, path)
    while _own_folders:
        shutil.rmtree(_own_folders.pop(), ignore_errors=True)


atexit.register(clean_up)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brimfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    if path := getattr(df, "_brimfold_path", None):
        drop_path(df.sparkSession, path)


class TooLarge(ValueError):
    """A table meant to be small exceeds its stated bound."""


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small reference table on the driver; more than ``most`` rows is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"{what} has more than {most} rows")
    return rows


def small_or_plain(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint, but only where the table was counted and has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
