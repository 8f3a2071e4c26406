import datetime as dt

from brimfold.streaming import seen


def test_seen_events(spark, tmp_path):
    t = lambda d: dt.datetime(2026, 1, d)
    shape = "job_key string, at timestamp, content_hash string"
    batches = [[("a", t(1), "x"), ("b", t(1), "x")], [("a", t(2), "x"), (None, t(2), "x")], [("a", t(3), "y"), ("c", t(20), "q")], [("b", t(21), "x"), ("c", t(22), "q")]]
    events = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = seen.seen_events(stream, 5).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(lambda df, _: events.extend(tuple(x) for x in df.collect())).start()
        q.awaitTermination()
    got = {(k, e) for k, _, e in events}
    assert ("a", "NEW") in got and ("a", "SEEN_BEFORE") in got and ("a", "UPDATED") in got and ("a", "REMOVED") in got
    assert ("b", "REMOVED") in got and ("b", "UPDATED") in got and ("c", "SEEN_BEFORE") in got and ("c", "REMOVED") not in got
