import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from brimfold.operators import snapshots
from brimfold.operators.snapshots import SnapshotIndex, buckets_for, delivery_changes, hashed, with_values

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SHAPE = "day date, id bigint, text string"
D = [dt.date(2026, 1, 1), dt.date(2026, 1, 3), dt.date(2026, 2, 1), dt.date(2026, 2, 2)]


def brute(rows):
    days = sorted({d for d, _, _ in rows if d})
    at = {d: {k: t for x, k, t in sorted(rows, key=str) if x == d and k is not None} for d in days}
    out = set()
    for a, b in zip(days, days[1:]):
        for k in at[a].keys() | at[b].keys():
            if k not in at[a]:
                out.add((b, k, "added"))
            elif k not in at[b]:
                out.add((b, k, "removed"))
            elif at[a][k] != at[b][k]:
                out.add((b, k, "changed"))
    return out


def test_random_histories(spark):
    r = random.Random(5)
    rows = []
    for d in D:
        for k in range(60):
            if r.random() < 0.7:
                rows += [(d, k, r.choice([None, "", " ", "a", "a ", "b"]))] * r.choice([1, 1, 2])
    got = delivery_changes(spark.createDataFrame(rows, SHAPE), "day", "id", "text")
    assert {tuple(x) for x in got.collect()} == brute(rows) and got.count() == len(brute(rows))


def test_edges(spark):
    rows = [(D[0], 1, None), (D[1], 1, ""), (D[2], 1, "null"), (D[0], None, "x"), (None, 4, "x"), (D[1], 2, "t" * 2_000_000), (D[2], 2, "t" * 2_000_000)]
    df = spark.createDataFrame(rows, SHAPE).withColumns({"_k": F.lit(1), "_h": F.lit(2), "change": F.lit("x"), "_n": F.lit(3)})
    got = {tuple(x) for x in delivery_changes(df, "day", "id", "text").collect()}
    assert got == {(D[1], 1, "changed"), (D[2], 1, "changed"), (D[1], 2, "added")}
    assert delivery_changes(df.limit(0), "day", "id", "text").collect() == []
    assert delivery_changes(df.where(F.col("day") == F.lit(D[0])), "day", "id", "text").collect() == []
    values = with_values(delivery_changes(df, "day", "id", "text"), df, "day", "id", "text")
    assert {tuple(x) for x in values.collect()} == {(D[1], 1, None, ""), (D[2], 1, "", "null")}


def frame_of(spark, rows, shape="id bigint, text string"):
    return spark.createDataFrame(rows, shape)


def test_the_index_is_swapped_and_outlives_its_object(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    before = {t.name for t in spark.catalog.listTables()}
    steps = [([(1, "a"), (2, "b")], {(1, "added"), (2, "added")}), ([(1, "a"), (2, "c"), (3, None)], {(2, "changed"), (3, "added")}), ([], {(1, "removed"), (2, "removed"), (3, "removed")}), ([(3, "x")], {(3, "added")})]
    for rows, want in steps:
        index = SnapshotIndex(spark, path, "id", "text")  # a new object each time, as in a new session
        assert {tuple(x) for x in index.apply(frame_of(spark, rows)).collect()} == want
        assert len([f for f in os.listdir(tmp_path / "kept") if f.startswith("index-")]) == 1
    assert {t.name for t in spark.catalog.listTables()} == before


SESSION = """
import sys
from pyspark.sql import SparkSession
from brimfold.operators.snapshots import SnapshotIndex
path, rows = sys.argv[1], eval(sys.argv[2])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", path + "-shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("FOUND", sorted(map(tuple, SnapshotIndex(spark, path, "id", ["text", "n"]).apply(spark.createDataFrame(rows, "id string, text string, n double")).collect())))
"""


def test_two_sessions(tmp_path):
    run = lambda rows: subprocess.run([sys.executable, "-c", SESSION, f"file://{tmp_path}/kept", repr(rows)], capture_output=True, text=True, timeout=300, cwd=ROOT).stdout.splitlines()[-1]
    assert run([("a", "x", 1.0), ("b", None, 2.0)]) == "FOUND [('a', 'added'), ('b', 'added')]"
    assert run([("a", "x", 1.5), ("c", None, 2.0), ("b", None, 2.0)]) == "FOUND [('a', 'changed'), ('c', 'added')]"


def test_a_run_that_fails_before_the_swap_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    index = SnapshotIndex(spark, path, "id", "text")
    index.apply(frame_of(spark, [(1, "a")]))

    def fails(_):
        raise OSError("disk full")

    with pytest.raises(OSError):
        index.apply_hashed(hashed(frame_of(spark, [(1, "b")]), "id", "text"), 1, fails)
    assert [tuple(x) for x in SnapshotIndex(spark, path, "id", "text").apply(frame_of(spark, [(1, "c"), (2, "d")])).collect() if x.id == 1] == [(1, "changed")]
    assert len([f for f in os.listdir(tmp_path / "kept") if f.startswith("index-")]) == 1


def test_columns_of_any_type(spark, tmp_path):
    shape = "id int, a int, b double, c timestamp, d array<string>, e struct<x: int>, f binary"
    t = dt.datetime(2026, 1, 1)
    base = (1, 1.5, t, ["a", None], (1,), bytearray(b"x"))
    rows = [(k, *base) for k in range(8)]
    other = [list(r) for r in rows]
    for k, v in ((1, 2), (2, 1.25), (3, t + dt.timedelta(microseconds=1)), (4, ["a"]), (5, None), (6, bytearray(b"y"))):
        other[k][k] = v
    index = SnapshotIndex(spark, f"file://{tmp_path}/kept", "id", ["a", "b", "c", "d", "e", "f"])
    index.apply(spark.createDataFrame(rows, shape))
    got = index.apply(spark.createDataFrame([tuple(r) for r in other], shape)).collect()
    assert {tuple(r) for r in got} == {(k, "changed") for k in range(1, 7)}


def test_bucket_counts(spark, tmp_path, monkeypatch):
    assert [buckets_for(n) for n in (0, 1, 500_000, 500_001, 1_500_000, 10**9, 10**14)] == [1, 1, 1, 2, 4, 2048, 65_536]
    monkeypatch.setattr(snapshots, "BUCKET_KEYS", 10)
    index = SnapshotIndex(spark, f"file://{tmp_path}/kept", "id", "text")
    index.apply(frame_of(spark, [(k, "a") for k in range(15)]))
    got = index.apply(frame_of(spark, [(k, "a" if k else "b") for k in range(95)])).collect()
    assert sorted(map(tuple, got)) == [(0, "changed")] + [(k, "added") for k in range(15, 95)]


def test_no_shuffle_when_probing(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/kept", "id", "text")
    index.apply(frame_of(spark, [(1, "a")]))
    plans = []
    index.apply_hashed(hashed(frame_of(spark, [(1, "b")]), "id", "text"), 1, lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()))
    assert "Exchange" not in plans[0]


def test_an_index_kept_from_call_to_call(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    first = spark.createDataFrame([(D[0], 1, "a"), (D[1], 1, "b")], SHAPE)
    later = spark.createDataFrame([(D[2], 1, "c"), (D[3], 2, "c")], SHAPE)
    assert {tuple(x) for x in delivery_changes(first, "day", "id", "text", path).collect()} == {(D[1], 1, "changed")}
    assert {tuple(x) for x in delivery_changes(later, "day", "id", "text", path).collect()} == {(D[2], 1, "changed"), (D[3], 1, "removed"), (D[3], 2, "added")}
