"""Relational, stateful and summary operators over whole tables, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brimfold.functions import keys
from brimfold.operators import reporting, review, rules, state, summaries, validation
from brimfold.plans.shared import new_path
from brimfold.sources.tables import table
from brimfold.streaming import seen

SPLIT = datetime.date(1998, 6, 1)
EXPIRE_DAYS = 3
SNAPSHOT = datetime.date(2024, 1, 15)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return e.groupBy(F.col("user_id").alias("job_key"), F.to_date("ts").alias("run")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("event_type")), ","), 256).alias("content_hash"))


def q16_seen_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _observations(spark, d)
    runs = rows.select("run", F.lit(True).alias("allow_expiry")).distinct()
    return state.seen_history(rows, runs, EXPIRE_DAYS).select("job_key", F.date_format("run", "yyyy-MM-dd").alias("run"), "event")


def q17_expired_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the state loses when nothing comes in for two days."""
    e = table(spark, d, "events", "ts", "user_id").withColumn("at", F.col("ts").cast("timestamp"))
    kept = e.groupBy(F.col("user_id").alias("job_key")).agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.lit("").alias("content_hash"), F.lit("SEEN_BEFORE").alias("status"))
    newest = e.agg(F.max("at")).first()[0]
    _, state_after, events = state.track_seen(kept.where(F.lit(False)).select("job_key", "content_hash"), kept, F.lit(newest), 2)
    gone = events.where("event = 'REMOVED'").select("job_key")
    return state_after.join(gone, "job_key", "left_semi").select(F.col("job_key").alias("user_id"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_day"))


def q18_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    by = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    return state.upsert(by(o.where(F.col("o_orderdate") < F.lit(SPLIT))), by(o.where(F.col("o_orderdate") >= F.lit(SPLIT))), "o_custkey")


def q19_weekly_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts of an early state of the log, with the weeks from SNAPSHOT on replaced by those of the whole log."""
    e = table(spark, d, "events", "ts", "event_type", "value", "user_id").withColumn("week_start", keys.week_start(F.col("ts")))
    counts = lambda rows: rows.groupBy("week_start", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") >= 50).alias("high"))
    merged = state.replace_period(counts(e.where("value < 60")), counts(e.where(F.col("week_start") >= F.lit(SNAPSHOT))), "week_start")
    return merged.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


def q20_last_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type", "user_id").withColumn("day", F.to_date("ts"))
    daily = summaries.last_per_day(e, "day", [F.col("ts").desc(), F.col("event_id").desc()])
    return summaries.last_days(daily, "day", 14).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "user_id")


def q21_funnel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type", "value")
    has = lambda k: F.bool_or(F.col("event_type") == k)
    users = e.groupBy("user_id").agg(has("view").alias("viewed"), has("click").alias("clicked"), has("signup").alias("signed"), has("purchase").alias("bought"), F.max("value").alias("v"))
    users = users.select("*", F.when(F.col("v") >= 90, "high").when(F.col("v") >= 50, "").alias("value_band"), F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("arm"))
    return summaries.funnel(users, ["viewed", "clicked", "signed", "bought"], [[], ["value_band"], ["arm"]])


def q22_top12(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_partkey", "l_returnflag").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return summaries.top_counts(lines, "l_returnflag", "p_brand", "l_partkey").withColumnRenamed("rows", "n")


def q23_score_bands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_acctbal", "c_mktsegment")
    name = keys.band(F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")), [(8500, "85+"), (7000, "70+"), (5000, "50+")], "below", "UNRECORDED")
    return c.groupBy(name.alias("score_band")).agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("hits")).withColumn("hit_rate", keys.rate(F.col("hits"), F.col("n")))


def q24_calibration(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_linenumber", "l_discount").select((F.col("l_returnflag") == "R").alias("pos"), (F.col("l_returnflag") == "A").alias("neg"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_linenumber").cast("double").alias("line"), F.round(F.col("l_discount") * 100).cast("double").alias("discount"))
    return summaries.calibration(li, ["quantity", "line", "discount"], "pos", "neg").select("component", *[F.round(c, 6).alias(c) for c in ("positive_mean", "negative_mean", "difference")])


def q25_report_queue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    fresh = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 499000)
    return summaries.report_queue(o, fresh, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50).select("report_number", "o_orderkey", "o_orderstatus")


def q26_alert_digest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    top = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select(F.col("o_orderkey").cast("string").alias("k"))
    return summaries.keys_digest(top, "k")


def q27_left_join_defaults(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.count("*").alias("n"))
    return review.with_defaults(table(spark, d, "customer", "c_custkey", "c_name"), last, "c_custkey", {"status": "NEW", "n": 0})


def q28_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return review.flagged(table(spark, d, "customer", "c_custkey"), large, "c_custkey", "_large").select("c_custkey", F.when(F.col("_large"), "large").otherwise("other").alias("kind"))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("src"), F.col("s_nationkey") % 3).alias("source"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 9000).alias("priority"))


def q29_rotation(spark: SparkSession, d: str) -> DataFrame:
    health = table(spark, d, "supplier", "s_suppkey").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").cast("string").alias("key"), F.lit(datetime.datetime(2026, 9, 1)).cast("timestamp_ntz").alias("next_retry_at"))
    now = F.lit(datetime.datetime(2026, 8, 20, 12)).cast("timestamp_ntz")
    return state.rotation(_companies(spark, d), health, now, 5, 6).select("source", "key", "priority", "decision")


def q30_cooldown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    streaks = e.withColumn("ok", F.sum((F.col("event_type") != "error").cast("int")).over(w))
    last = streaks.groupBy("user_id", "ok").agg(F.count_if(F.col("event_type") == "error").alias("failures")).groupBy("user_id").agg(F.max_by("failures", "ok").alias("failures"), F.max("failures").alias("longest"))
    return last.select("user_id", "failures", "longest", state.cooldown_hours(F.col("failures"), F.lit(0)).alias("hours"))


def q31_source_status(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "documents", "source", "company_name", "n_chars").groupBy("source", F.col("company_name").alias("employer")).agg((F.min("n_chars") >= 400).alias("ok"), F.count("*").alias("jobs"), F.lit(1).cast("bigint").alias("requests"))
    return summaries.source_status(log)


def q32_age_bands(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderdate")
    days = keys.whole_days(F.lit(datetime.datetime(2001, 8, 2, 6)).cast("timestamp_ntz").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return o.groupBy(keys.age_band(days).alias("age")).agg(F.count("*").alias("n"), F.min(days).alias("youngest"))


def q33_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    broken = validation.violations(o, "o_orderkey", [validation.one_of("o_orderstatus", ["O", "F"]), validation.between("o_totalprice", 1000, 490000), validation.iso_date("_day"), validation.required_if("o_orderpriority", F.col("o_orderstatus") == "P")], [[F.col("o_custkey"), F.col("_day")]])
    return broken.select("o_orderkey", F.col("rule"))


def q34_json_field(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count_if(k.isNull()).alias("without"))


def q36_first_of_best(spark: SparkSession, d: str) -> DataFrame:
    """Per document source the longest document, the least id among equals."""
    return summaries.best_per_group(table(spark, d, "documents", "doc_id", "source", "n_chars"), "source", F.struct("n_chars", -F.col("doc_id")), "doc_id", "n_chars")


def q37_caps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    caps = rules.capped([(F.col("o_orderstatus") == "P", 59, "pending"), (F.col("o_orderpriority") == "5-LOW", 79, "low"), (F.col("o_totalprice") < 50000, 59, "small")])
    return o.select("o_orderkey", caps.alias("_c")).select("o_orderkey", "_c.cap", "_c.why")


def q38_set_operations(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation", "n_nationkey").select(F.col("n_nationkey").alias("k"))
    tag = lambda df, t: df.select("k", F.lit(t).alias("op"))
    return tag(s.union(c).distinct(), "union").unionByName(tag(n.subtract(c), "except")).unionByName(tag(s.intersect(c), "intersect"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Half-day runs made of the events, in the form of a run history."""
    e = table(spark, d, "events", "event_id", "ts", "event_type").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "half": F.floor(F.hour("ts") / 12).cast("int")})
    kinds = e.groupBy("day", "half", "event_type").agg(F.count("*").alias("k"), F.max("event_id").alias("last"))
    status = F.when(F.col("k") % 4 == 0, "failed").when(F.col("k") % 4 == 1, "partial").when(F.col("k") % 9 == 0, "idle").otherwise("ok")
    count = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("k"))).cast("int")
    runs = kinds.groupBy("day", "half").agg(
        F.sum("k").alias("n"), F.max("last").alias("_ord"), count("view").alias("relevant_jobs_in_current_run"), count("signup").alias("new_jobs"), F.sum("k").cast("int").alias("jobs_collected"), count("click").alias("security_title_candidates"), count("error").alias("duplicates_removed"),
        F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(status.alias("status"))))).alias("source_status"),
    )
    return runs.select("*", F.concat("day", F.lit("T06:00:00Z")).alias("generated_at"), F.when((F.col("half") == 1) & (F.col("n") % 5 == 0), "full").otherwise(F.when(F.col("n") % 2 == 0, "daily")).alias("employer_mode"), F.when(F.col("n") % 11 == 0, 0).otherwise(1).alias("quality_review_schema_version"), F.when(F.col("n") % 3 > 0, F.col("n") / 10).alias("workflow_duration_seconds"))


def q39_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a review: sums, rates, source checks and feedback of the runs of the last days."""
    e = table(spark, d, "events", "ts", "event_type", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    reviews = e.where("event_type in ('purchase', 'error')").select(F.when(F.col("event_type") == "purchase", "SUITABLE").otherwise("FALSE_POSITIVE").alias("verdict"), F.when(F.col("value") >= 5, F.col("day")).otherwise("").alias("first_seen"), F.concat("day", F.lit("T01:00:00Z")).alias("reviewed_at"))
    missed = e.where("event_type = 'signup' and value > 90").select(F.col("day").alias("found_date"))
    return review.quality_summary(_runs(spark, d), reviews, missed, "2024-01-31", 10).withColumn("value", F.round("value", 6))


def q50_health_merge(spark: SparkSession, d: str) -> DataFrame:
    """Employers' health after one more scan of each supplier: failures counted on, cleared or kept."""
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    key = F.col("s_suppkey").cast("string").alias("key")
    old = s.where("s_suppkey % 3 <> 0").select(key, (F.col("s_nationkey") % 4).alias("failures"), F.lit(500).alias("http_status"), F.lit(None).cast("timestamp").alias("next_retry_at"))
    results = s.where("s_suppkey % 5 <> 0").select(key, (F.col("s_acctbal") > 2000).alias("ok"), F.when(F.col("s_acctbal") < 0, 404).otherwise(200).alias("http_status"))
    now = F.lit(datetime.datetime(2026, 8, 20)).cast("timestamp")
    return state.update_health(old, results, now).select("key", "failures", "http_status", F.round(F.coalesce(F.unix_timestamp("next_retry_at") - F.unix_timestamp(now), F.lit(-3600)) / 3600).cast("int").alias("hours"))


def q51_health_and_selection(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a rotation by source, as (source, metric, value), and those of the employers' health."""
    now = datetime.datetime(2026, 8, 20, 12)
    health = table(spark, d, "supplier", "s_suppkey").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").cast("string").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(2).alias("failures"), F.when(F.col("s_suppkey") % 3 == 0, 404).otherwise(200).alias("http_status"), F.lit(datetime.datetime(2026, 9, 1)).cast("timestamp_ntz").alias("next_retry_at"))
    decided = state.rotation(_companies(spark, d), health, F.lit(now).cast("timestamp_ntz"), 5, 6)
    counts = review.selection_summary(decided)
    by_source = counts.unpivot(["source"], [c for c in counts.columns if c != "source"], "metric", "value")
    whole = review.metrics(review.health_summary(_companies(spark, d), health, F.lit(now).cast("timestamp_ntz"))).select(F.lit("all").alias("source"), "metric", "value")
    return by_source.unionByName(whole)


def q52_alert(spark: SparkSession, d: str) -> DataFrame:
    """The ten best urgent orders as an alert."""
    return reporting.alert(_scored_orders(spark, d), ["NEW"], 40)[0].select("position", "job_key", "title", "score", "recommendation", "published_at", "url", F.array_join("reasons", ",").alias("reasons"))


def q53_alert_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.alert(_scored_orders(spark, d), ["NEW"], 40)[1]


def _scored_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("_ord"), F.col("o_orderkey").cast("string").alias("job_key"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("location"), F.when(F.col("o_orderstatus") == "O", "new").otherwise("removed").alias("status"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), F.when(F.col("o_orderkey") % 4 == 0, "APPLIED").alias("application_status"), (F.col("o_orderpriority") == "1-URGENT").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.concat(F.lit("GO - "), "o_orderpriority").alias("recommendation"), F.lit(None).cast("string").alias("family"), F.lit("").alias("apply_url"), F.concat(F.lit("https://o.example/"), F.col("o_orderkey")).alias("url"), F.split(F.lit("a b c d e f"), " ").alias("reasons"), F.array().cast("array<string>").alias("warnings"),
    )


def q54_bounded_log(spark: SparkSession, d: str) -> DataFrame:
    """The last 400 events, as a log keeps them."""
    return state.last_rows(table(spark, d, "events", "event_id", "ts", "event_type"), [F.col("ts").desc(), F.col("event_id").desc()], 400).select("event_id", "event_type")


def q55_partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the fields that a later delivery of some of them fills in, and new ones."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    later = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name")).unionByName(c.where("c_custkey % 50 = 0 and c_custkey > 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name")))
    return validation.partial_update(c, later, "c_custkey")


def q56_all_failed(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source that was not idle failed, for all sources and for those that did."""
    status = q31_source_status(spark, d)
    bad = status.where("status in ('failed', 'idle')")
    return summaries.all_failed(status).select(F.lit("all").alias("sources"), "all_failed").unionByName(summaries.all_failed(bad).select(F.lit("bad").alias("sources"), "all_failed"))


def q57_skill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Skills of orders (their lines) against a profile (of parts' brands): the sorted list and the gaps."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    need = F.when(F.col("l_returnflag") == "R", "mandatory").when(F.col("l_returnflag") == "A", "mentioned").otherwise("optional")
    skills = lines.select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("skill"), need.alias("requirement"))
    profile = table(spark, d, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("skill")).agg(F.max("p_size").alias("m")).select("skill", F.when(F.substring("skill", -1, 1) == "1", "strong").when(F.substring("skill", -1, 1) == "2", "partial").alias("profile_status"))
    rows = review.skill_gaps(review.skill_list(review.with_skill_status(skills, profile), "id"))
    return rows.select("id", F.array_join(F.transform("skills", lambda x: F.concat_ws(":", x["requirement"], x["skill"])), ",").alias("skills"), *[F.array_join(c, ",").alias(c) for c in ("mandatory_gaps", "potential_gaps", "optional_gaps")])


def q58_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Orders with what they leave blank taken from their customer, and how many of the best customers' orders have components."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select("o_orderkey", F.col("o_custkey").alias("job_key"), F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("company"), F.lit(None).cast("string").alias("segment"))
    return review.enriched(o, table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").withColumnRenamed("c_custkey", "job_key"), {"company": ["c_name"], "segment": ["c_mktsegment"]})


def q59_families(spark: SparkSession, d: str) -> DataFrame:
    return reporting.family_counts(table(spark, d, "documents", "doc_id", "lang"), "lang", "doc_id")


def q60_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    """Seen-tracking as a stream over the observations, run until all that is there has been read; removals come when the watermark allows and are told by q16."""
    landing, out, marks = new_path(spark, "landing"), new_path(spark, "stream"), new_path(spark, "marks")
    rows = _observations(spark, d).select(F.col("job_key").cast("string").alias("job_key"), F.col("run").cast("timestamp").alias("at"), "content_hash")
    rows.write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    query = seen.seen_events(stream, 400).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("job_key string, at timestamp, event string").parquet(out).where("event <> 'REMOVED'").groupBy("job_key").agg(F.count_if(F.col("event") == "NEW").alias("news"), F.count_if(F.col("event") == "UPDATED").alias("updates"), F.count_if(F.col("event") == "SEEN_BEFORE").alias("seen"))


def q40_ranked_limit(spark: SparkSession, d: str) -> DataFrame:
    """The sections of a report over all suppliers: the ten best of the strong ones, fifty of the others."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score"), F.col("s_name").alias("company"), F.col("s_suppkey").alias("_ord"), F.lit("NEW").alias("status"))
    return reporting.report_sections(s, reporting.job_order(), 8000).select("s_suppkey", "section", "position")


def q47_weekly_stream(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts as a stream over the events, run until all that is there has been read."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d))
    out, marks = new_path(spark, "stream"), new_path(spark, "marks")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = seen.weekly_counts(stream, "event_type", "ts").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "event_type", F.col("rows").alias("n"))


def _stream_folder(spark: SparkSession, d: str) -> str:
    """The events in a folder of their own, as a landing zone has them."""
    folder = new_path(spark, "landing")
    table(spark, d, "events").write.parquet(folder)
    return folder


def q48_seen_batch(spark: SparkSession, d: str) -> DataFrame:
    """All observations from a day on as one batch against the state of those before it; keys come many times in the batch."""
    rows = _observations(spark, d)
    first = rows.where("run < '2024-01-15'").groupBy("job_key").agg(F.max_by("content_hash", "run").alias("content_hash"), F.min("run").cast("timestamp").alias("first_seen"), F.max("run").cast("timestamp").alias("last_seen")).withColumn("status", F.lit("SEEN_BEFORE"))
    batch = rows.where("run >= '2024-01-15'").select("job_key", "content_hash", "run")
    _, new, events = state.track_seen(batch, first, F.lit("2024-01-31").cast("timestamp"), 20, order="run")
    told = events.groupBy("job_key").agg(F.count_if(F.col("event") == "UPDATED").alias("updates"), F.count_if(F.col("event") == "NEW").alias("news"), F.count_if(F.col("event") == "REMOVED").alias("removals"))
    return review.with_defaults(new.select("job_key", "status", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "content_hash"), told, "job_key", {"updates": 0, "news": 0, "removals": 0})


QUERIES = {f.__name__: f for f in (q16_seen_history, q17_expired_keys, q18_upsert, q19_weekly_snapshot, q20_last_days, q21_funnel, q22_top12, q23_score_bands, q24_calibration, q25_report_queue, q26_alert_digest, q27_left_join_defaults, q28_semi_anti, q29_rotation, q30_cooldown, q31_source_status, q32_age_bands, q33_violations, q34_json_field, q36_first_of_best, q37_caps, q38_set_operations, q39_quality_summary, q50_health_merge, q51_health_and_selection, q52_alert, q53_alert_counts, q54_bounded_log, q55_partial_update, q56_all_failed, q57_skill_gaps, q58_enriched, q59_families, q60_seen_stream, q40_ranked_limit, q47_weekly_stream, q48_seen_batch)}

_OBS = "SELECT user_id AS job_key, ts::date AS run, sha256(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS content_hash FROM events GROUP BY 1, 2"
_RATE = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::double ELSE round_even((100.0::double * {a} / {b})::double, 1) END"
_COMPANIES = "SELECT 'src' || (s_nationkey % 3) AS source, s_suppkey::varchar AS key, s_name AS name, s_acctbal > 9000 AS priority FROM supplier"
_FUNNEL_AGG = "count(*) AS rows, count(*) FILTER (WHERE viewed) AS viewed, count(*) FILTER (WHERE clicked) AS clicked, count(*) FILTER (WHERE signed) AS signed, count(*) FILTER (WHERE bought) AS bought"

SQL = {
    "q16_seen_history": f"""WITH o AS ({_OBS}), r AS (SELECT DISTINCT run FROM o), w AS (SELECT *, lag(run) OVER k AS p, lag(content_hash) OVER k AS ph, lead(run) OVER k AS nx FROM o WINDOW k AS (PARTITION BY job_key ORDER BY run)),
        q AS (SELECT w.*, (SELECT max(r.run) FROM r WHERE r.run > w.p AND r.run < w.run) AS q, (SELECT min(r.run) FROM r WHERE r.run - {EXPIRE_DAYS} > w.run AND (w.nx IS NULL OR r.run < w.nx)) AS gone FROM w),
        e AS (SELECT job_key, run, CASE WHEN p IS NULL THEN 'NEW' WHEN coalesce(q - {EXPIRE_DAYS} > p, false) OR ph <> content_hash THEN 'UPDATED' ELSE 'SEEN_BEFORE' END AS event FROM q UNION ALL SELECT job_key, gone, 'REMOVED' FROM q WHERE gone IS NOT NULL)
        SELECT job_key, strftime(run, '%Y-%m-%d') AS run, event FROM e""",
    "q17_expired_keys": "SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
    "q18_upsert": f"""WITH a AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders WHERE o_orderdate < DATE '{SPLIT}' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders WHERE o_orderdate >= DATE '{SPLIT}' GROUP BY 1)
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)""",
    "q19_weekly_snapshot": f"""WITH e AS (SELECT *, date_trunc('week', ts)::date AS w FROM events), a AS (SELECT w, event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value >= 50) AS high FROM e WHERE value < 60 GROUP BY 1, 2), b AS (SELECT w, event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value >= 50) AS high FROM e WHERE w >= DATE '{SNAPSHOT}' GROUP BY 1, 2)
        SELECT strftime(w, '%Y-%m-%d') AS week_start, event_type, n, users, high FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE w NOT IN (SELECT w FROM b))""",
    "q20_last_days": "WITH r AS (SELECT *, ts::date AS d, row_number() OVER (PARTITION BY ts::date ORDER BY ts DESC, event_id DESC) AS n FROM events), x AS (SELECT *, dense_rank() OVER (ORDER BY d DESC) AS k FROM r WHERE n = 1) SELECT strftime(d, '%Y-%m-%d') AS day, event_id, event_type, user_id FROM x WHERE k <= 14",
    "q21_funnel": f"""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'signup') AS signed, bool_or(event_type = 'purchase') AS bought, max(value) AS v FROM events GROUP BY 1),
        x AS (SELECT *, CASE WHEN v >= 90 THEN 'high' ELSE 'UNRECORDED' END AS value_band, CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS arm FROM u),
        g AS (SELECT NULL AS arm, NULL AS value_band, 3 AS grouping, {_FUNNEL_AGG} FROM x UNION ALL SELECT NULL, value_band, 2, {_FUNNEL_AGG} FROM x GROUP BY value_band UNION ALL SELECT arm, NULL, 1, {_FUNNEL_AGG} FROM x GROUP BY arm)
        SELECT *, {_RATE('clicked', 'viewed')} AS clicked_rate, {_RATE('signed', 'clicked')} AS signed_rate, {_RATE('bought', 'signed')} AS bought_rate FROM g""",
    "q22_top12": "WITH c AS (SELECT l_returnflag, p_brand, count(*) AS n, min(l_partkey) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, f, p_brand)::int AS rank FROM c) SELECT l_returnflag, p_brand, n, rank FROM r WHERE rank <= 12",
    "q23_score_bands": f"WITH b AS (SELECT CASE WHEN c_acctbal < 0 OR c_acctbal IS NULL THEN 'UNRECORDED' WHEN c_acctbal >= 8500 THEN '85+' WHEN c_acctbal >= 7000 THEN '70+' WHEN c_acctbal >= 5000 THEN '50+' ELSE 'below' END AS score_band, c_mktsegment AS m FROM customer), g AS (SELECT score_band, count(*) AS n, count(*) FILTER (WHERE m = 'BUILDING') AS hits FROM b GROUP BY 1) SELECT *, {_RATE('hits', 'n')} AS hit_rate FROM g",
    "q24_calibration": """WITH x AS (SELECT l_returnflag AS f, unnest(['quantity', 'line', 'discount']) AS component, unnest([l_quantity, l_linenumber::double, round(l_discount * 100)]) AS value FROM lineitem),
        m AS (SELECT component, coalesce(avg(value) FILTER (WHERE f = 'R'), 0.0) AS positive_mean, coalesce(avg(value) FILTER (WHERE f = 'A'), 0.0) AS negative_mean FROM x GROUP BY 1)
        SELECT component, round(positive_mean, 6) AS positive_mean, round(negative_mean, 6) AS negative_mean, round(positive_mean - negative_mean, 6) AS difference FROM m""",
    "q25_report_queue": "WITH r AS (SELECT row_number() OVER (ORDER BY (o_orderstatus = 'O' AND o_totalprice > 499000) DESC, o_totalprice DESC, o_orderkey)::int AS report_number, o_orderkey, o_orderstatus FROM orders) SELECT * FROM r WHERE report_number <= 50",
    "q26_alert_digest": "WITH t AS (SELECT o_orderkey::varchar AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) SELECT substring(sha256(coalesce(string_agg(k, chr(10) ORDER BY k), '')), 1, 10) AS digest FROM t",
    "q27_left_join_defaults": "WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(status, 'NEW') AS status, coalesce(n, 0) AS n FROM customer LEFT JOIN l ON c_custkey = o_custkey",
    "q28_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'large' ELSE 'other' END AS kind FROM customer",
    "q29_rotation": f"""WITH c AS ({_COMPANIES}), d AS (SELECT *, CASE WHEN key::bigint % 7 = 0 THEN 'cooldown_skip' WHEN priority OR ('0x' || substring(sha256(key), 1, 8))::bigint % 5 = 3 THEN 'selected' ELSE 'rotation_skip' END AS decision FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, decision ORDER BY priority DESC, lower(name), lower(key)) AS n FROM d) SELECT source, key, priority, CASE WHEN decision = 'selected' AND n > 6 THEN 'rotation_skip' ELSE decision END AS decision FROM r""",
    "q30_cooldown": """WITH s AS (SELECT *, sum((event_type <> 'error')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events), g AS (SELECT user_id, ok, count(*) FILTER (WHERE event_type = 'error') AS failures FROM s GROUP BY 1, 2),
        l AS (SELECT user_id, arg_max(failures, ok) AS failures, max(failures) AS longest FROM g GROUP BY 1) SELECT user_id, failures, longest, (CASE WHEN failures <= 0 THEN 0 ELSE least(168, 24 * 2 ** least(failures - 1, 8)) END)::int AS hours FROM l""",
    "q31_source_status": """WITH l AS (SELECT source, company_name AS employer, min(n_chars) >= 400 AS ok, count(*) AS jobs FROM documents GROUP BY 1, 2), g AS (SELECT source, count(*) FILTER (WHERE employer IS NOT NULL) AS checked, count(*) FILTER (WHERE employer IS NOT NULL AND ok) AS ok_count, count(*) FILTER (WHERE employer IS NOT NULL AND NOT ok) AS failed_count, sum(jobs)::bigint AS jobs, count(*) AS requests, bool_and(ok) AS a FROM l GROUP BY 1)
        SELECT source, checked, ok_count, failed_count, jobs, requests, CASE WHEN checked = 0 AND requests = 0 AND jobs = 0 THEN 'idle' WHEN ok_count > 0 AND failed_count > 0 THEN 'partial' WHEN NOT a THEN 'failed' ELSE 'ok' END AS status FROM g""",
    "q32_age_bands": "WITH a AS (SELECT greatest(0, floor((epoch(TIMESTAMP '2001-08-02 06:00:00') - epoch(o_orderdate)) / 86400))::int AS days FROM orders) SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 2 THEN 'new' WHEN days <= 7 THEN 'recent' WHEN days <= 30 THEN 'current' ELSE 'older' END AS age, count(*) AS n, min(days) AS youngest FROM a GROUP BY 1",
    "q33_violations": """WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), u AS (SELECT o_custkey, d FROM o WHERE o_custkey IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT o_orderkey, 'o_orderstatus: not allowed' AS rule FROM o WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'o_totalprice: out of range' FROM o WHERE o_totalprice < 1000 OR o_totalprice > 490000 UNION ALL SELECT o_orderkey, 'o_orderpriority: missing in this state' FROM o WHERE o_orderstatus = 'P' AND coalesce(trim(o_orderpriority, ' '), '') = '' UNION ALL SELECT o_orderkey, 'not unique' FROM o SEMI JOIN u USING (o_custkey, d)""",
    "q34_json_field": "SELECT event_type, sum((props::json->>'k')::bigint)::bigint AS k_sum, max((props::json->>'k')::bigint) AS k_max, count(*) FILTER (WHERE props::json->>'k' IS NULL) AS without FROM events GROUP BY 1",
    "q36_first_of_best": "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1",
    "q37_caps": """WITH c AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'P' THEN {'cap': 59, 'why': 'pending'} END, CASE WHEN o_orderpriority = '5-LOW' THEN {'cap': 79, 'why': 'low'} END, CASE WHEN o_totalprice < 50000 THEN {'cap': 59, 'why': 'small'} END], lambda x: x IS NOT NULL) AS caps FROM orders), m AS (SELECT *, coalesce(list_min([x.cap for x in caps]), 100)::int AS cap FROM c)
        SELECT o_orderkey, cap, coalesce(array_to_string([x.why for x in caps if x.cap = cap], ','), '') AS why FROM m""",
    "q38_set_operations": "WITH s AS (SELECT s_nationkey AS k FROM supplier), c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) SELECT k, 'union' AS op FROM (SELECT k FROM s UNION SELECT k FROM c) UNION ALL SELECT k, 'except' FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT k FROM c) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM s INTERSECT SELECT k FROM c)",
    "q39_quality_summary": f"""WITH k AS (SELECT strftime(ts, '%Y-%m-%d') AS day, (hour(ts) // 12)::int AS half, event_type, count(*) AS k, max(event_id) AS last FROM events GROUP BY 1, 2, 3),
        r AS (SELECT day, half, sum(k)::bigint AS n, max(last) AS o, coalesce(sum(k) FILTER (WHERE event_type = 'view'), 0)::bigint AS rel, coalesce(sum(k) FILTER (WHERE event_type = 'signup'), 0)::bigint AS new, coalesce(sum(k) FILTER (WHERE event_type = 'click'), 0)::bigint AS cand, coalesce(sum(k) FILTER (WHERE event_type = 'error'), 0)::bigint AS dup FROM k GROUP BY 1, 2),
        d AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY o DESC) AS rn FROM r WHERE n % 11 <> 0 AND NOT (half = 1 AND n % 5 = 0)), x AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS back FROM d WHERE rn = 1), t AS (SELECT * FROM x WHERE back <= 10),
        p AS (SELECT coalesce(min(day), '2024-01-31') AS a, coalesce(max(day), '2024-01-31') AS b FROM t),
        c AS (SELECT CASE WHEN k % 4 = 0 THEN 'failed' WHEN k % 4 = 1 THEN 'partial' WHEN k % 9 = 0 THEN 'idle' ELSE 'ok' END AS st FROM k SEMI JOIN t USING (day, half)),
        v AS (SELECT event_type FROM events, p WHERE event_type IN ('purchase', 'error') AND strftime(ts, '%Y-%m-%d') BETWEEN a AND b),
        m AS (SELECT count(*) AS c FROM events, p WHERE event_type = 'signup' AND value > 90 AND strftime(ts, '%Y-%m-%d') BETWEEN a AND b),
        u AS (SELECT count(*) AS runs, coalesce(sum(rel), 0) AS rel, coalesce(sum(new), 0) AS new, coalesce(sum(n), 0) AS n, coalesce(sum(cand), 0) AS cand, coalesce(sum(dup), 0) AS dup, round(avg(n / 10) FILTER (WHERE n % 3 > 0), 1) AS dur, count(*) FILTER (WHERE n % 3 > 0) AS cov FROM t),
        s AS (SELECT count(*) FILTER (WHERE st <> 'idle') AS n, count(*) FILTER (WHERE st = 'failed') AS f, count(*) FILTER (WHERE st = 'partial') AS h FROM c), f AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM v)
        SELECT unnest(['runs', 'relevant_jobs_in_current_run', 'new_jobs', 'jobs_collected', 'security_title_candidates', 'duplicates_removed', 'average_workflow_duration_seconds', 'workflow_duration_coverage_runs', 'duplicate_rate_percent']) AS metric, unnest([runs::double, rel, new, n, cand, dup, dur, cov, {_RATE('dup', 'cand')}]) AS value FROM u
        UNION ALL SELECT unnest(['source_checks', 'source_failures', 'source_partials', 'source_failure_rate_percent']), unnest([n::double, f, h, {_RATE('f', 'n')}]) FROM s
        UNION ALL SELECT unnest(['reviewed_jobs', 'suitable_jobs_confirmed', 'false_positives', 'false_positive_rate_percent', 'false_positive_rate_is_reliable']), unnest([n::double, good, bad, {_RATE('bad', 'n')}, (n >= 5)::int]) FROM f UNION ALL SELECT 'missed_suitable_jobs', c::double FROM m""",
    "q40_ranked_limit": "WITH r AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 8000 THEN 'strong' ELSE 'other' END AS section, row_number() OVER (PARTITION BY s_acctbal >= 8000 ORDER BY s_acctbal DESC, s_name, s_suppkey)::int AS position FROM supplier) SELECT * FROM r WHERE position <= CASE WHEN section = 'strong' THEN 10 ELSE 50 END",
    "q47_weekly_stream": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q48_seen_batch": f"""WITH o AS ({_OBS}), f AS (SELECT job_key, arg_max(content_hash, run) AS h, max(run) AS l FROM o WHERE run < DATE '2024-01-15' GROUP BY 1), b AS (SELECT o.*, row_number() OVER k AS n, lag(o.content_hash) OVER k AS p, lead(o.run) OVER k IS NULL AS last, f.h, f.job_key IS NOT NULL AS known FROM o LEFT JOIN f USING (job_key) WHERE run >= DATE '2024-01-15' WINDOW k AS (PARTITION BY o.job_key ORDER BY run)),
        e AS (SELECT *, CASE WHEN n = 1 AND NOT known THEN 'NEW' WHEN content_hash = CASE WHEN n = 1 THEN h ELSE p END THEN 'SEEN_BEFORE' ELSE 'UPDATED' END AS status FROM b), g AS (SELECT job_key, count(*) FILTER (WHERE status = 'UPDATED') AS updates, count(*) FILTER (WHERE status = 'NEW') AS news FROM e GROUP BY 1)
        SELECT job_key, status, '2024-01-31' AS last_seen, content_hash, updates, news, 0::bigint AS removals FROM e JOIN g USING (job_key) WHERE last
        UNION ALL SELECT job_key, CASE WHEN l < DATE '2024-01-31' - 20 THEN 'REMOVED' ELSE 'SEEN_BEFORE' END, strftime(l, '%Y-%m-%d'), h, 0, 0, (l < DATE '2024-01-31' - 20)::int FROM f ANTI JOIN b USING (job_key)""",
    "q50_health_merge": """WITH o AS (SELECT s_suppkey, s_nationkey % 4 AS f FROM supplier WHERE s_suppkey % 3 <> 0), r AS (SELECT s_suppkey, s_acctbal > 2000 AS ok, CASE WHEN s_acctbal < 0 THEN 404 ELSE 200 END AS st FROM supplier WHERE s_suppkey % 5 <> 0),
        b AS (SELECT coalesce(o.s_suppkey, r.s_suppkey)::varchar AS key, CASE WHEN ok IS NULL THEN coalesce(f, 0) WHEN ok THEN 0 ELSE coalesce(f, 0) + 1 END AS failures, CASE WHEN ok IS NULL THEN 500 ELSE st END AS http_status, ok, st FROM o FULL JOIN r ON o.s_suppkey = r.s_suppkey)
        SELECT key, failures::int AS failures, http_status::int AS http_status, CASE WHEN ok = false THEN CASE WHEN st = 404 THEN 720 ELSE least(168, 24 * 2 ** least(failures - 1, 8)) END ELSE -1 END::int AS hours FROM b""",
    "q51_health_and_selection": f"""WITH c AS ({_COMPANIES}), d AS (SELECT *, CASE WHEN key::bigint % 7 = 0 THEN 'c' WHEN priority OR ('0x' || substring(sha256(key), 1, 8))::bigint % 5 = 3 THEN 's' ELSE 'r' END AS decision FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, decision ORDER BY priority DESC, lower(name), lower(key)) AS n FROM d), x AS (SELECT source, priority, CASE WHEN decision = 's' AND n > 6 THEN 'r' ELSE decision END AS decision FROM r),
        g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE priority) AS p, count(*) FILTER (WHERE decision = 's') AS s, count(*) FILTER (WHERE decision = 'r') AS r, count(*) FILTER (WHERE decision = 'c') AS c FROM x GROUP BY 1)
        SELECT source, unnest(['configured_enabled', 'priority_configured', 'selected', 'skipped_by_rotation', 'skipped_by_cooldown']) AS metric, unnest([n, p, s, r, c]) AS value FROM g
        UNION ALL SELECT 'all', unnest(['configured', 'healthy', 'cooling_down', 'invalid_identifiers']), unnest([count(*), count(*) FILTER (WHERE s_suppkey % 14 = 0), count(*) FILTER (WHERE s_suppkey % 7 = 0), count(*) FILTER (WHERE s_suppkey % 21 = 0 AND s_suppkey % 2 = 1)]) FROM supplier""",
    "q52_alert": """WITH c AS (SELECT *, floor(o_totalprice / 5000)::int AS score FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0 AND floor(o_totalprice / 5000) >= 40), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey)::int AS position FROM c)
        SELECT position, o_orderkey::varchar AS job_key, o_orderpriority AS title, score, 'GO' AS recommendation, strftime(o_orderdate, '%Y-%m-%d') AS published_at, 'https://o.example/' || o_orderkey AS url, 'a,b,c,d' AS reasons FROM r WHERE position <= 10""",
    "q53_alert_counts": """WITH c AS (SELECT *, floor(o_totalprice / 5000)::int AS score FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0 AND floor(o_totalprice / 5000) >= 40), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey) AS position FROM c)
        SELECT count(*) AS candidate_count, least(count(*), 10) AS included_count, greatest(count(*) - 10, 0) AS truncated_count, substring(sha256(coalesce(string_agg(o_orderkey::varchar, chr(10) ORDER BY o_orderkey::varchar) FILTER (WHERE position <= 10), '')), 1, 10) AS digest FROM r""",
    "q54_bounded_log": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 400",
    "q55_partial_update": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT -c_custkey, 'new', NULL FROM customer WHERE c_custkey % 50 = 0 AND c_custkey > 0""",
    "q57_skill_gaps": """WITH s AS (SELECT DISTINCT l_orderkey AS id, p_brand AS skill, CASE l_returnflag WHEN 'R' THEN 'mandatory' WHEN 'A' THEN 'mentioned' ELSE 'optional' END AS q, CASE right(p_brand, 1) WHEN '1' THEN 'strong' WHEN '2' THEN 'partial' ELSE 'missing' END AS st FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT id, string_agg(q || ':' || skill, ',' ORDER BY q, skill) AS skills, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (WHERE q = 'mandatory' AND st <> 'strong'), '') AS mandatory_gaps, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (WHERE q = 'mentioned' AND st = 'missing'), '') AS potential_gaps, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (WHERE q = 'optional' AND st <> 'strong'), '') AS optional_gaps FROM s GROUP BY 1""",
    "q58_enriched": "SELECT o_orderkey, o_custkey AS job_key, coalesce(CASE WHEN o_orderkey % 3 = 1 THEN nullif(trim(o_orderpriority, ' '), '') END, nullif(trim(c_name, ' '), '')) AS company, nullif(trim(c_mktsegment, ' '), '') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "q59_families": "WITH c AS (SELECT coalesce(nullif(trim(lang, ' '), ''), 'Other') AS family, count(*) AS rows, min(doc_id) AS f FROM documents GROUP BY 1) SELECT family, rows, row_number() OVER (ORDER BY rows DESC, f)::int AS rank FROM c",
    "q60_seen_stream": f"""WITH o AS ({_OBS}), w AS (SELECT *, lag(content_hash) OVER (PARTITION BY job_key ORDER BY run) AS p FROM o) SELECT job_key::varchar AS job_key, count(*) FILTER (WHERE p IS NULL) AS news, count(*) FILTER (WHERE p <> content_hash) AS updates, count(*) FILTER (WHERE p = content_hash) AS seen FROM w GROUP BY 1""",
}
SQL["q56_all_failed"] = f"WITH s AS ({SQL['q31_source_status']}), t AS (SELECT 'all' AS sources, status FROM s UNION ALL SELECT 'bad', status FROM s WHERE status IN ('failed', 'idle')), g AS (SELECT sources, count(*) FILTER (WHERE status <> 'idle') > 0 AND bool_and(status IN ('failed', 'idle')) AS f FROM t GROUP BY 1) SELECT x.sources, coalesce(f, false) AS all_failed FROM (VALUES ('all'), ('bad')) x(sources) LEFT JOIN g USING (sources)"
