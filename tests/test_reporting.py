import datetime as dt

from pyspark.sql import functions as F

from brimfold.functions import keys, text
from brimfold.operators import reporting, review, rules, summaries

ALERT = "_ord int, job_key string, title string, company string, location string, status string, score int, application_status string, priority boolean, published_at string, recommendation string, family string, apply_url string, url string, reasons array<string>, warnings array<string>"


def test_alert(spark):
    row = lambda i, status="NEW", score=90, applied=None, priority=False, at="2026-08-01T10:00:00": (i, f"k{i}", "T", "C", None, status, score, applied, priority, at, "APPLY - now", None, "", f"u{i}", list("abcdef"), list("uvwxyz"))
    rows = [row(1), row(2, score=95), row(3, status="updated", priority=True), row(4, at="2026-08-02T00:00:00"), row(5, score=10), row(6, applied="APPLIED"), row(7, status="REMOVED"), row(8, score=None)]
    jobs, counts = reporting.alert(spark.createDataFrame(rows, ALERT), ["NEW", "UPDATED"], 80, 3)
    got = jobs.orderBy("position").collect()
    assert [x.job_key for x in got] == ["k2", "k3", "k4"] and got[0].reasons == list("abcd") and got[0].warnings == list("uvwxy") and (got[0].recommendation, got[0].url, got[0].published_at, got[0].family) == ("APPLY", "u2", "2026-08-01", "Other")
    c = counts.first()
    assert (c.candidate_count, c.included_count, c.truncated_count) == (4, 3, 1) and len(c.digest) == 10
    none, counts = reporting.alert(spark.createDataFrame([], ALERT), ["NEW"], 80, 3)
    assert none.count() == 0 and (counts.first().candidate_count, counts.first().truncated_count) == (0, 0)


def test_orders_sections_and_counts(spark):
    df = spark.createDataFrame([(1, "REMOVED", 99, "A", "x"), (2, "NEW", 70, "B", "y"), (3, None, 80, None, None), (4, "NEW", 80, "A", "y"), (5, "NEW", None, "C", " ")], "_ord int, status string, score int, company string, family string")
    assert [x._ord for x in df.orderBy(*reporting.job_order()).collect()] == [3, 4, 2, 5, 1]
    assert [(x.family, x.rows) for x in reporting.family_counts(df, "family", "_ord").orderBy("rank").collect()] == [("y", 2), ("Other", 2), ("x", 1)]
    parts = reporting.report_sections(df, reporting.job_order(), 75, 2, 1).collect()
    assert {(x._ord, x.section, x.position) for x in parts} == {(3, "strong", 1), (4, "strong", 2), (2, "other", 1)}
    assert [x.jobs for x in reporting.jobs_by_source(spark.createDataFrame([("s", 2), ("s", None)], "source string, jobs bigint")).collect()] == [2]
    applied = spark.createDataFrame([("NEW", None), ("REMOVED", None), ("NEW", "rejected"), (None, "applied")], "status string, application_status string")
    assert reporting.active(applied, ["REJECTED"]).count() == 2


def test_handoff_and_compact(spark):
    df = spark.createDataFrame([(2, "b", "2026-08-01T00:00:00", None), (1, "a", "no date", 7), (3, "c", None, None)], "report_number int, title string, published_at string, age_days int")
    assert [tuple(x) for x in reporting.handoff(df, ["title", "salary"], 2).collect()] == [(1, "a", None), (2, "b", None)]
    now = F.lit(dt.datetime(2026, 8, 4, 12)).cast("timestamp")
    assert {x.title: x.age_days for x in reporting.compact(df, ["title", "nothing"], now).collect()} == {"a": 7, "b": 3, "c": None}


def test_interviews(spark):
    shape = "stage int, interview_date string, interview_stage string, response_date string"
    df = spark.createDataFrame([(3, None, None, "2026-08-02"), (1, "2026-08-02T10:00:00", "", None), (1, None, "first", "2026-09-01"), (1, "", " ", "2026-08-02"), (None, None, None, None)], shape)
    s, e = F.lit("2026-08-01"), F.lit("2026-08-02")
    got = df.select(review.is_interview(F.col("stage")).alias("i"), review.interview_in_period(F.col("stage"), s, e).alias("p")).collect()
    assert [(x.i, x.p) for x in got] == [(True, True), (True, True), (True, False), (False, False), (False, False)]


def test_health_and_selection(spark):
    now = dt.datetime(2026, 8, 4)
    companies = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    health = spark.createDataFrame([("a", 0, 200, None), ("b", 2, 500, now + dt.timedelta(days=1)), ("c", 1, 404, now - dt.timedelta(days=1)), ("z", 0, 200, None)], "key string, failures int, http_status int, next_retry_at timestamp")
    assert tuple(review.health_summary(companies, health, F.lit(now).cast("timestamp")).first()) == (5, 1, 1, 1)
    decisions = spark.createDataFrame([("s", "a", True, "selected"), ("s", "b", False, "rotation_skip"), ("s", "c", False, "cooldown_skip"), ("t", "d", None, "selected")], "source string, key string, priority boolean, decision string")
    assert {tuple(x) for x in review.selection_summary(decisions).collect()} == {("s", 3, 1, 1, 1, 1), ("t", 1, 0, 1, 0, 0)}


def test_joins_with_postings(spark):
    jobs = spark.createDataFrame([("k1", "Acme", "T", {"a": 1}), ("k2", "B", "U", None), ("k3", "C", "V", {})], "job_key string, company string, title string, score_breakdown map<string,int>")
    apps = spark.createDataFrame([("k1", " ", None), ("k2", "Own", ""), ("k9", None, "P")], "job_key string, company string, position string")
    got = {x.job_key: (x.company, x.position) for x in review.enriched(apps, jobs, {"company": ["company"], "position": ["title"]}).collect()}
    assert got == {"k1": ("Acme", "T"), "k2": ("Own", "U"), "k9": (None, "P")}
    assert [x.job_key for x in review.with_components(apps, jobs).collect()] == ["k1"]
    assert [x.here for x in review.flagged(apps, jobs.unionByName(jobs), "job_key", "here").orderBy("job_key").collect()] == [True, True, False]


def test_skills(spark):
    skills = spark.createDataFrame([(1, "sql", "mandatory"), (1, "go", "optional"), (1, "java", "mentioned"), (1, "aws", "mandatory"), (2, "sql", "optional")], "id int, skill string, requirement string")
    profile = spark.createDataFrame([("sql", "partial"), ("aws", "strong")], "skill string, profile_status string")
    rows = {x.id: x for x in review.skill_gaps(review.skill_list(review.with_skill_status(skills, profile), "id")).collect()}
    assert [s.skill for s in rows[1].skills] == ["aws", "sql", "java", "go"]
    assert (rows[1].mandatory_gaps, rows[1].potential_gaps, rows[1].optional_gaps, rows[2].optional_gaps) == (["sql"], ["java"], ["go"], ["sql"])
    scored = spark.createDataFrame([(40,), (None,), (60,)], "score int")
    assert [x.r for x in scored.select(rules.reasons([review.below(F.col("score"), 50)]).alias("r")).collect()] == [["score 40 is below 50"], ["score 0 is below 50"], []]


def test_keys(spark):
    df = spark.createDataFrame([(" ACME ", "Lever")], "id string, source string")
    assert df.select(keys.company_key(F.col("source"), F.col("id"))).first()[0] == "lever:acme"
    assert len(df.select(keys.missed_key(F.col("id"), F.lit(None), F.lit("u"))).first()[0]) == 16
    try:
        summaries.keys_digest(spark.range(20).select(F.col("id").cast("string").alias("k")), "k", 10).collect()
        raise AssertionError
    except Exception as e:
        assert "more than 10 keys" in str(e)


def test_normalised_text_resolves_markup(spark):
    df = spark.createDataFrame([("<p>R&amp;D</p>",), ("a < b",), (None,), ("x&y",)], "v string")
    assert [x[0] for x in df.select(text.normalize_text(F.col("v"))).collect()] == ["r and d", "a b", "", "x and y"]
