import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brimfold.operators.components import components
from brimfold.operators import dedup, postings, prefix, rules, state, summaries, validation

T = lambda d: dt.datetime(2026, 1, d)


def test_first_match_and_reasons(spark):
    df = spark.createDataFrame([("senior lead dev",), ("senior dev",), ("dev",), (None,)], "t string")
    got = df.select(rules.first_match(F.col("t"), [("lead", r"\blead\b"), ("senior", r"\bsenior\b")], "none").alias("m"), rules.reasons([(F.col("t").contains("dev"), F.lit("d")), (F.col("t").contains("lead"), F.lit("l"))]).alias("r")).collect()
    assert [(x.m.level, x.m.evidence, x.r) for x in got] == [("lead", "lead", ["d", "l"]), ("senior", "senior", ["d"]), ("none", "", ["d"]), ("none", "", [])]


def test_best_family_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("a b", "x"), ("b", "x x y"), ("", ""), (None, None)], "t string, b string")
    fam = [("one", ["a"], ["x"]), ("two", ["b"], ["y"])]
    assert [x.f.id for x in df.select(rules.best_family(F.col("t"), F.col("b"), fam, "none").alias("f")).collect()] == ["one", "two", "none", "none"]


def test_sections_carry_over_and_strongest_mentions(spark):
    text = "Requirements\nWe expect python.\nNice to have\nsome rust\nBenefits\nrust lunches. Must have go"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = rules.carried_sections(rules.sentence_rows(df, "id", "text"), "id", ["nice to have"], ["requirements", "benefits"])
    assert [(x.sentence, x.optional) for x in rows.orderBy("id", "pos").collect()] == [("Requirements", False), ("We expect python.", False), ("Nice to have", True), ("some rust", True), ("Benefits", False), ("rust lunches.", False), ("Must have go", False)]
    got = {x.name: tuple(x)[2:] for x in rules.strongest_mentions(rows, "id", {"python": ["python"], "rust": ["rust"], "go": ["go"]}, ["nice to have"], ["expect", "must have"]).collect()}
    assert got == {"python": ("mandatory", "We expect python.", 1, False), "rust": ("optional", "some rust", 2, False), "go": ("mandatory", "Must have go", 1, False)}


def test_running_totals_over_any_group(spark):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.5 else f"g{i % 7}", r.randrange(5)) for i in range(3000)]
    r.shuffle(rows)
    got = {x.i: (x.t, x.k) for x in prefix.running_total(prefix.running_total(spark.createDataFrame(rows, "i bigint, g string, v bigint"), ["g"], F.floor(F.col("i") / 100), ["i"], F.col("v"), "t"), ["g"], F.floor(F.col("i") / 70), ["i"], F.lit(1), "k").collect()}
    total, rank = {}, {}
    for i, g, v in sorted(rows):
        assert got[i] == (total.get(g, 0), rank.get(g, 0))
        total[g], rank[g] = total.get(g, 0) + v, rank.get(g, 0) + 1


def raw(spark, rows):
    return spark.createDataFrame(rows, "_ord bigint, source string, source_job_id string, company string, title string, location string, url string, description string, tags array<string>")


def test_postings_are_merged(spark):
    long = "we build things for people who like long descriptions. " * 20
    rows = [
        (0, "a", "1", "Acme GmbH", "Engineer (m/w/d)", "Berlin", "https://x.example/1?utm_source=q", "short", ["b"]),
        (1, "b", "9", "ACME", "Engineer", "Berlin", "https://y.example/9", "a longer text", ["a", "b"]),  # same fingerprint
        (2, "b", "10", "Other", "Else", "Rome", "https://x.example/1", "zz", []),  # same URL as 0
        (3, "c", "1", "Solo", "Cook", "Paris", "https://z.example/3", long, None),
        (4, "c", "2", "Solo", "Chef", "Lyon", "https://z.example/4", long, None),  # same description
        (5, "c", "3", "Solo", "Baker", "Nice", "https://z.example/5", long + "extra.", None),  # nearly the same
        (6, "d", None, None, None, None, None, None, None),
    ]
    df = raw(spark, rows).withColumns({"_keys": F.lit(1), "group": F.lit("clash")}).drop("_keys", "group")
    done = dedup.deduplicate(postings.normalise_postings(df), "_ord", ["y.example"]).orderBy("_ord").collect()
    assert [(x["_ord"], x.merged) for x in done] == [(0, 3), (3, 3), (6, 1)]
    assert done[0].sources == ["a", "b"] and done[0].tags == ["a", "b"] and done[0].description == "a longer text" and done[0].source_urls["b"] == "https://x.example/1"
    assert done[2].company == "Unknown company" and done[2].title == "Untitled role" and done[2].location == "Unspecified" and len(done[2].job_key) == 20
    again = dedup.deduplicate(postings.normalise_postings(df), "_ord", ["y.example"]).orderBy("_ord").collect()
    assert again == done
    assert dedup.deduplicate(postings.normalise_postings(df.limit(0)), "_ord").count() == 0


def test_similar_titles_are_linked(spark):
    body = "You will maintain the booking system of our hotels and answer the phone at night. "
    rows = [(0, "a", "1", "Inn", "Night Auditor", "Rome", "https://a.example/1", body + "Start in May.", []), (1, "a", "2", "Inn", "Night Auditors", "Rome", "https://a.example/2", body + "Start in June.", []), (2, "a", "3", "Inn", "Night Auditor", "Oslo", "https://a.example/3", body + "Start in July.", []), (3, "a", "4", "Inn", "Night Porter", "Rome", "https://a.example/4", body, []), (4, "a", "5", "Inn", "Night Auditor!", "Rome", "https://a.example/5", "Something else entirely, with other words.", [])]
    done = {x["_ord"]: x.merged for x in dedup.deduplicate(postings.normalise_postings(raw(spark, rows)), "_ord").collect()}
    assert done == {0: 3, 2: 1, 3: 1}  # 4 has the fingerprint of 0; Oslo is another place


def words_of(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_likeness_is_that_of_difflib():
    r = random.Random(5)
    for _ in range(300):
        a = "".join(r.choice("abcd ") for _ in range(r.randrange(60)))
        b = "".join(c for c in a if r.random() > 0.1) if r.random() < 0.7 else "".join(r.choice("abcd ") for _ in range(r.randrange(60)))
        assert [dedup.alike(a, b, x) for x in (0.6, 0.88, 0.97)] == [dedup.SequenceMatcher(None, a, b).ratio() >= x for x in (0.6, 0.88, 0.97)]


def test_similar_postings_far_apart_are_linked(spark):
    r = random.Random(3)
    body, opening = words_of(r, 60), words_of(r, 70)
    rows = [(i, "a", str(i), "Inn", words_of(r, 3), f"Place {i}", f"https://a.example/{i}", words_of(r, 60), []) for i in range(150)]
    rows[0] = (0, "a", "0", "Inn", "Night Auditor", "Rome", "https://a.example/0", body + " may", [])
    rows[149] = (149, "a", "149", "Inn", "Night Auditors", "Oslo", "https://a.example/149", body + " june", [])  # 149 rows later, both remote
    # one anchor block: the same opening, and endings of the same length that differ but for two of them
    rows += [(200 + i, "b", str(i), "Mill", words_of(r, 3), f"Place {i}", f"https://b.example/{i}", opening + " " + words_of(r, 40), []) for i in range(40)]
    rows[-1] = (*rows[-1][:7], rows[150][7][:-3] + "xyz", [])
    done = {x["_ord"]: x.merged for x in dedup.deduplicate(postings.normalise_postings(raw(spark, rows).withColumn("remote", F.lit(True))), "_ord").collect()}
    assert done == {x[0]: 2 if x[0] in (0, 200) else 1 for x in rows if x[0] not in (149, 239)}


def test_links_form_groups(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in got} and all(a in got for a, b in edges if a != b)


def simulate(history, days, expire):
    seen, events = {}, []
    for day in days:
        for k, h in sorted(history.get(day, {}).items()):
            old = seen.get(k)
            events.append((k, day, "NEW" if old is None else "UPDATED" if old[2] or old[1] != h else "SEEN_BEFORE"))
            seen[k] = (day, h, False)
        for k, (last, h, gone) in seen.items():
            if k not in history.get(day, {}) and not gone and last < day - dt.timedelta(days=expire):
                seen[k] = (last, h, True)
                events.append((k, day, "REMOVED"))
    return events, seen


def test_seen_tracking_in_batches_and_at_once(spark):
    r = random.Random(3)
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=2 * i) for i in range(8)]
    history = {d: {k: r.choice("xy") for k in range(25) if r.random() < 0.4} for d in days}
    want, final = simulate(history, days, 5)
    rows = [(k, d, h) for d in days for k, h in history[d].items()]
    once = state.seen_history(spark.createDataFrame(rows, "job_key bigint, run date, content_hash string"), spark.createDataFrame([(d, True) for d in days], "run date, allow_expiry boolean"), 5)
    assert sorted(map(tuple, once.collect())) == sorted(want)

    shape = "job_key bigint, first_seen timestamp, last_seen timestamp, content_hash string, status string"
    table, events = [], []
    for d in days:
        now = F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp")
        _, new, out = state.track_seen(spark.createDataFrame(list(history[d].items()), "job_key bigint, content_hash string"), spark.createDataFrame(table, shape), now, 5)
        table = [tuple(x) for x in new.collect()]
        events += [(x.job_key, d, x.event) for x in out.collect()]
    assert sorted(events) == sorted(e for e in want if e[2] != "SEEN_BEFORE")
    assert {(x[0], x[2].date(), x[4] == "REMOVED") for x in table} == {(k, last, gone) for k, (last, _, gone) in final.items()}


def test_a_key_twice_in_a_batch(spark):
    batch = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 2), (None, "z", 3)], "job_key bigint, content_hash string, o int")
    empty = spark.createDataFrame([], "job_key bigint, first_seen timestamp, last_seen timestamp, content_hash string, status string")
    seen, new, _ = state.track_seen(batch, empty, F.lit(T(1)).cast("timestamp"), 5, order="o")
    assert [x.status for x in seen.orderBy("o").collect()] == ["NEW", "UPDATED", "SEEN_BEFORE"] and new.count() == 1


def test_health_and_rotation(spark):
    now = F.lit(T(5)).cast("timestamp")
    old = spark.createDataFrame([("a", 0, None, None), ("b", 2, 500, T(4)), ("c", 1, 404, T(20))], "key string, failures int, http_status int, next_retry_at timestamp")
    got = {x.key: (x.failures, x.next_retry_at) for x in state.update_health(old, spark.createDataFrame([("a", False, 500), ("b", True, 200), ("d", False, 410)], "key string, ok boolean, http_status int"), now).collect()}
    assert got == {"a": (1, T(6)), "b": (0, None), "c": (1, T(20)), "d": (1, T(5) + dt.timedelta(hours=720))}
    companies = spark.createDataFrame([("s", f"k{i}", f"n{i}", i == 3) for i in range(40)], "source string, key string, name string, priority boolean")
    nobody = spark.createDataFrame([], "key string, next_retry_at timestamp")
    due = [{x.key for x in state.rotation(companies, nobody, F.lit(T(5 + d)).cast("timestamp"), 5, 100).where("decision = 'selected'").collect()} for d in range(5)]
    assert set().union(*due) == {f"k{i}" for i in range(40)} and all("k3" in d for d in due) and sum(map(len, due)) == 39 + 5
    assert state.rotation(companies, nobody, now, 5, 7, full=True).where("decision = 'selected'").count() == 7


def test_upserts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, state.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, state.replace_period(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, validation.partial_update(a, spark.createDataFrame([(1, None), (4, "n")], "k int, v string"), "k").collect())) == [(1, "x"), (2, "y"), (4, "n")]


def test_validation(spark):
    df = spark.createDataFrame([(1, "A", "5", "2026-02-30"), (2, None, "x", "2026-02-28"), (3, "a", "500", None)], "id int, name string, score string, day string")
    got = validation.violations(df, "id", [validation.required("name"), validation.between("score", 0, 100), validation.iso_date("day")], [[F.lower("name")]])
    assert sorted(map(tuple, got.collect())) == [(1, "day: no date"), (1, "not unique"), (2, "name: missing"), (2, "score: out of range"), (3, "not unique"), (3, "score: out of range")]
    with pytest.raises(validation.InvalidRecords):
        validation.require_valid(got, "jobs")
    validation.require_valid(got.limit(0), "jobs")


def test_summaries_of_nothing(spark):
    df = spark.createDataFrame([], "k string, a boolean, b boolean, g string, n int")
    assert [(x.rows, x.b_rate) for x in summaries.funnel(df, ["a", "b"], [[]]).collect()] in ([], [(0, 0.0)])
    assert summaries.top_counts(df, "g", "k", "n").collect() == []
    assert summaries.keys_digest(df, "k").first().digest == "e3b0c44298"
    log = spark.createDataFrame([], "source string, employer string, ok boolean, jobs bigint, requests bigint")
    assert summaries.all_failed(summaries.source_status(log)).first().all_failed is False


def test_source_status(spark):
    log = spark.createDataFrame([("a", None, True, 5, 1), ("b", "x", True, 1, 1), ("b", "y", False, 0, 1), ("c", "x", False, 0, 1), ("d", None, True, 0, 0)], "source string, employer string, ok boolean, jobs bigint, requests bigint")
    assert {x.source: x.status for x in summaries.source_status(log).collect()} == {"a": "ok", "b": "partial", "c": "failed", "d": "idle"}
    assert summaries.all_failed(summaries.source_status(log.where("source in ('c', 'd')"))).first().all_failed is True
