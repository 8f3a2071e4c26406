import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from brimfold.operators import summaries
from brimfold.operators.postings import normalise_postings
from brimfold.plans import pipeline
from brimfold.plans.shared import materialize
from brimfold.sources import feeds, providers, rest, sinks


@pytest.fixture()
def landed(tmp_path):
    def put(name, value):
        p = tmp_path / name
        p.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
        return str(p)

    return put


def rows(df):
    return [x.asDict(recursive=True) for x in df.collect()]


def test_paged_and_single_documents(spark, landed):
    a = landed("a.json", {"pages": [{"data": [{"slug": "s1", "company_name": "Acme", "title": "Dev", "description": "<p>x</p>", "remote": True, "url": "https://a.example/1", "tags": ["q"], "job_types": ["Full", "Perm"], "location": "Berlin", "created_at": 1788076032}]}, {"data": []}]})
    r = providers.arbeitnow(providers.payloads(spark, a, "arbeitnow")).first()
    assert (r.source, r.source_job_id, r.employment_type, r.published_at, r.remote, r.tags) == ("arbeitnow", "s1", "Full, Perm", "2026-08-30T07:47:12Z", True, ["q"])
    b = landed("r.json", {"jobs": [{"id": 7, "title": "T", "company_name": "C", "url": "https://r.example/7", "candidate_required_location": "", "publication_date": "2026-08-01T10:00:00"}, {"id": None}]})
    got = providers.remotive(providers.payloads(spark, b, "remotive")).orderBy("source_job_id").collect()
    assert [(x.source_job_id, x.location, x.remote) for x in got] == [("", "Remote", True), ("7", "Remote", True)]


def test_documents_by_employer(spark, landed):
    g = landed("g.json", {"boards": {"acme": {"jobs": [{"id": 1, "title": "T", "updated_at": "2026-08-14T09:30:00-04:00", "location": {"name": "Remote, EU"}, "absolute_url": "https://g.example/1", "content": "&lt;p&gt;x&lt;/p&gt;", "metadata": [{"name": "Level", "value": "3"}, {"name": "Employment Type", "value": "Full-time"}], "departments": [{"name": "Eng"}], "offices": [{"name": "Berlin"}]}]}, "empty": {"jobs": []}, "broken": {}}})
    docs = providers.payloads(spark, g, "greenhouse")
    r = providers.greenhouse(docs).first()
    assert (r.company, r.employment_type, r.tags, r.remote) == ("acme", "Full-time", ["Eng", "Berlin"], True)
    log = {x.employer: (x.ok, x.jobs) for x in providers.collection_log(docs, "greenhouse", "boards", "jobs").collect()}
    assert log["acme"] == (True, 1) and log["empty"] == (True, 0) and log["broken"][0] in (False, None)
    a = landed("as.json", {"boards": {"b": {"jobs": [{"id": None, "title": "T", "location": "Berlin", "secondaryLocations": [{"location": "Rome"}, {"location": "Berlin"}], "isListed": True, "workplaceType": "Remote", "jobUrl": "https://as.example/b/xyz/", "descriptionPlain": "d", "department": "D", "team": None}, {"id": "2", "isListed": False}]}}})
    r = providers.ashby(providers.payloads(spark, a, "ashby")).collect()
    assert len(r) == 1 and (r[0].source_job_id, r[0].location, r[0].remote, r[0].tags) == ("xyz", "Berlin | Rome", True, ["D"])
    lv = landed("l.json", {"sites": {"s": [{"id": "i", "text": "T", "categories": {"location": "Berlin", "allLocations": ["Berlin", "Rome"], "commitment": "Full", "team": "X"}, "descriptionPlain": "d", "lists": [{"text": "Do", "content": "<li>a</li>"}], "additionalPlain": "z", "hostedUrl": "https://l.example/i", "createdAt": 1780390872000, "salaryRange": {"currency": "EUR", "min": 1000.0, "max": 2000.0, "interval": "month"}}]}})
    r = providers.lever(providers.payloads(spark, lv, "lever")).first()
    assert (r.description, r.salary, r.published_at, r.location) == ("d\n\nDo\n<li>a</li>\n\nz", "EUR 1000-2000 month", "2026-06-02T09:01:12Z", "Berlin | Rome")
    rc = landed("rc.json", {"subdomains": {"s": {"offers": [{"id": 1, "status": "published", "company_name": "C", "title": "T", "description": "a", "requirements": "b", "salary": {"currency": "EUR", "min": "1", "max": "2", "period": "year"}}, {"id": 2, "status": "draft"}]}}})
    r = providers.recruitee(providers.payloads(spark, rc, "recruitee")).collect()
    assert len(r) == 1 and (r[0].description, r[0].salary) == ("a\n\nb", "1-2 EUR year")


def test_xml_details(spark, landed):
    p = landed("d.xml", "<workzag-jobs><position><id> 9 </id><office>Remote</office><department>IT</department><name>Dev</name><employmentType>permanent</employmentType><schedule>full-time</schedule><yearsOfExperience>gt-15</yearsOfExperience><jobDescriptions><jobDescription><name>Tasks</name><value></value></jobDescription></jobDescriptions></position></workzag-jobs>")
    r = providers.personio(spark, p, "acme", "Acme Inc", "de").first()
    assert (r.company, r.url, r.employment_type, r.tags, r.description, r.remote) == ("Acme Inc", "https://acme.jobs.personio.de/job/9?language=de", "permanent / full-time", ["IT", "gt-15"], "Tasks\n\n15+ years of experience", True)


def test_xml_positions(spark, landed):
    p = landed("p.xml", "<workzag-jobs><position><id>5</id><office>Berlin</office><department>D</department><name>Dev</name><jobDescriptions><jobDescription><name>Tasks</name><value>build</value></jobDescription></jobDescriptions><employmentType>permanent</employmentType><yearsOfExperience>2-5</yearsOfExperience><createdAt>2026-08-14T09:30:00+0200</createdAt></position></workzag-jobs>")
    r = providers.personio(spark, p, "acme").first()
    assert (r.company, r.title, r.description) == ("acme", "Dev", "Tasks\nbuild\n\n2-5 years of experience") and r.url.endswith("/5?language=en")


def test_feed_posts(spark, landed):
    item = lambda t, link, d: f"<item><title>{t}</title><link>{link}</link><guid>{'g' * 200}</guid><author>Ann</author><pubDate>Fri, 14 Aug 2026 09:30:00 +0200</pubDate><description>{d}</description></item>"
    redirect = "https://g.example/url?q=https%3A%2F%2Fwww.posts.example%2Fposts%2F1%3Futm_source%3Dx&amp;sa=1"
    f = landed("f.xml", "<rss><channel>" + item("We are hiring a security engineer", redirect, "cloud security, remote") + item("again hiring security", redirect, "x") + item("cats", "https://posts.example/posts/2", "no topic") + "</channel></rss>")
    got = feeds.feed_postings(feeds.feed_entries(spark, f), "feed1", "posts.example", "/posts/", ["security"], ["hiring"]).collect()
    assert len(got) == 1 and (got[0].url, got[0].company, got[0].published_at, got[0].lead_type, len(got[0].source_job_id)) == ("https://www.posts.example/posts/1", "Ann", "2026-08-14T07:30:00Z", "post", 64)


def test_a_broken_document_fails_alone(spark, landed):
    docs = providers.payloads(spark, landed("x.json", "{not json"), "remotive")
    assert providers.remotive(docs).count() == 0
    log = rows(providers.collection_log(docs, "remotive"))
    assert len(log) == 1 and log[0]["ok"] is False and "x.json" in log[0]["error"]
    assert spark.range(1).select(providers.http_status(F.lit("HTTP Error 404: gone")).alias("s")).first().s == 404


def test_a_mistyped_field_costs_itself_only(spark, landed):
    instants = [1788076032, "1788076032", " 1788076032 ", 1788076032.25, 1.788076032e9, 1788076032000, "2026-08-14 09:30", None, "", "9" * 30]
    want = ["2026-08-30T07:47:12Z"] * 3 + ["2026-08-30T07:47:12.250000Z"] + ["2026-08-30T07:47:12Z"] * 2 + ["2026-08-14 09:30", "", "", "9" * 30]
    jobs = [{"slug": f"s{i}", "title": "T", "created_at": x} for i, x in enumerate(instants)] + [{"slug": "t", "title": "T", "tags": "none", "remote": "yes"}]
    docs = providers.payloads(spark, landed("a.json", {"pages": [{"data": jobs[:4]}, {"data": jobs[4:]}]}), "arbeitnow")
    got = {x.source_job_id: x.published_at for x in providers.arbeitnow(docs).collect()}
    assert got == {f"s{i}": x for i, x in enumerate(want)} | {"t": ""}
    assert [(x.ok, x.jobs) for x in providers.collection_log(docs, "arbeitnow").collect()] == [(True, 11)]
    docs = providers.payloads(spark, landed("l.json", {"sites": {"a": [{"id": "1", "createdAt": "2026-08-14"}, {"id": "2", "createdAt": 1780390872000}], "b": [{"id": "3", "createdAt": 1780390872000, "salaryRange": "much"}]}}), "lever")
    assert {x.source_job_id: (x.company, x.published_at) for x in providers.lever(docs).collect()} == {"1": ("a", "2026-08-14"), "2": ("a", "2026-06-02T09:01:12Z"), "3": ("b", "2026-06-02T09:01:12Z")}
    docs = providers.payloads(spark, landed("r.json", {"jobs": [{"id": "x7"}, {"id": 8}]}), "remotive")
    assert {x.source_job_id for x in providers.remotive(docs).collect()} == {"x7", "8"}
    for text in ('{"jobs": [{"id": 1}, {"id"', '{"jobs": "none"}'):
        docs = providers.payloads(spark, landed("r.json", text), "remotive")
        assert [x.ok for x in providers.collection_log(docs, "remotive").collect()] == [False] and providers.remotive(docs).count() == 0


def test_rest_reader(spark, landed, tmp_path):
    good = "file://" + landed("page.json", '{"a": 1}')
    spark.dataSource.register(rest.PagedRest)
    got = spark.read.format("paged_rest").option("urls", json.dumps([good, f"file://{tmp_path}/none.json"])).option("attempts", "1").option("pause", "0").load().orderBy("url").collect()
    assert sorted((x.body, bool(x.error)) for x in got if x.body) == [('{"a": 1}', False)] and sum(bool(x.error) for x in got) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|x"), (1, None)], "k int, v string")
    out = f"{tmp_path}/deep/o.json"
    for _ in range(2):  # the second replaces the first
        assert sinks.list_json(df, out) == 2 and sinks.get_json(spark, out)[0]["k"] == 2
    assert [f for f in os.listdir(tmp_path / "deep") if f.endswith(".new")] == []
    assert sinks.get_json(spark, f"{tmp_path}/none.json", 5) == 5
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(sinks.BrokenDocument):
        sinks.get_json(spark, f"{tmp_path}/bad.json")
    assert sinks.markdown_table(df, {"k": "Key", "v": "Value"}) == "| Key | Value |\n|---|---|\n| 2 | b\\|x |\n| 1 |  |\n"
    sinks.one_csv(df, ["v", "k"], "k", str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == '"v","k"'
    day = df.withColumn("day", F.lit("2026-01-01"))
    sinks.archive(day, str(tmp_path / "arc"), "day")
    sinks.archive(day.withColumn("day", F.lit("2026-01-02")), str(tmp_path / "arc"), "day")
    sinks.archive(day.limit(1), str(tmp_path / "arc"), "day")
    assert {x.day.isoformat(): x["count"] for x in spark.read.parquet(str(tmp_path / "arc")).groupBy("day").count().collect()} == {"2026-01-01": 1, "2026-01-02": 2}


def test_swapped_table(spark, tmp_path):
    table = sinks.SwappedTable(spark, f"{tmp_path}/t", "k int, v string")
    assert table.read().count() == 0
    table.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    table.replace(table.read().unionByName(spark.createDataFrame([(2, "b")], "k int, v string")))  # computed from what it replaces
    again = sinks.SwappedTable(spark, f"{tmp_path}/t", "k int, v string")
    assert sorted(map(tuple, again.read().collect())) == [(1, "a"), (2, "b")] and len([f for f in os.listdir(tmp_path / "t") if f.startswith("version-")]) == 1
    with pytest.raises(Exception):
        again.replace(spark.createDataFrame([(3, "x")], "k int, v string").withColumn("v", F.raise_error(F.lit("no"))))
    assert again.read().count() == 2  # a run that fails leaves what was


class Pages(BaseHTTPRequestHandler):
    """Pages 1 to 3 of postings, a fourth without any, and an address that fails twice before it answers."""

    tries = 0

    def do_GET(self):
        path, _, query = self.path.partition("?")
        n = int(dict(x.split("=") for x in query.split("&") if x).get("page", 1))
        status, body = 200, {"data": [{"slug": f"p{n}", "title": f"Title {n}"}] if n < 4 else [], "links": {"next": f"/jobs?page={n + 1}" if n < 5 else None}}
        if path == "/gone":
            status = 404
        if path == "/slow":
            Pages.tries += 1
            status = 503 if Pages.tries < 3 else 200
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paging(spark, server):
    get = lambda *urls, **o: materialize(rest.fetched(spark, [server + u for u in urls], delay=0, pause=0, **o), "answers").orderBy("ord", "page")
    by_link = get("/jobs?page=1", max_pages=8)
    assert [(x.page, x.status) for x in by_link.collect()] == [(1, 200), (2, 200), (3, 200), (4, 200)]  # the empty page ends it
    assert [x.page for x in get("/jobs?x=1", max_pages=2, page_param="page").collect()] == [1, 2]
    docs = providers.parsed(by_link, "arbeitnow")
    assert sorted(x.title for x in providers.arbeitnow(docs).collect()) == ["Title 1", "Title 2", "Title 3"]
    assert [(x.ok, x.jobs, x.http_status) for x in providers.collection_log(docs, "arbeitnow").orderBy("jobs").collect()] == [(True, 0, 200), (True, 1, 200), (True, 1, 200), (True, 1, 200)]


def test_failures_of_addresses(spark, server):
    answers = materialize(rest.fetched(spark, [server + u for u in ("/gone", "/slow", "/jobs")] + ["http://127.0.0.1:9/none"], delay=0, pause=0, attempts=3, workers=2), "answers")
    assert {x.ord: x.status for x in answers.collect()} == {0: 404, 1: 200, 2: 200, 3: None}
    found = {x.company.rpartition("/")[2]: x for x in providers.failure_rows(answers, "arbeitnow").collect()}
    assert (found["gone"].http_status, found["gone"].exception_type) == (404, "HTTPError") and found["gone"].message.startswith("arbeitnow | http") and found["none"].exception_type == "URLError" and set(found) == {"gone", "none"}
    log = {x.error[:8]: x.http_status for x in providers.collection_log(providers.parsed(answers, "arbeitnow"), "arbeitnow").where("not ok").collect()}
    assert log["HTTP 404"] == 404 and len(log) == 2


def test_one_address_an_employer(spark):
    rows = spark.createDataFrame([('a "b"', '{"jobs": [{"id": 7, "title": "T"}]}', "", 200), ("c", None, "HTTP Error 404: none", None)], "board string, body string, error string, status int").withColumn("url", F.lit("http://x.example/"))
    docs = providers.parsed(rows, "greenhouse", "board")
    assert [(x.company, x.source_job_id) for x in providers.greenhouse(docs).collect()] == [('a "b"', "7")]
    assert {x.employer: (x.ok, x.http_status) for x in providers.collection_log(docs, "greenhouse", "boards", "jobs").collect()} == {'a "b"': (True, 200), "c": (False, 404)}


def test_feed_configuration():
    more = json.dumps(["https://f.example/b", {"url": "https://f.example/a", "name": "again"}, {"url": "https://f.example/off", "enabled": False}, ""])
    got = feeds.configured_feeds([{"url": " https://f.example/a ", "name": "A"}], more)
    assert [(f["name"], f["url"]) for f in got] == [("A", "https://f.example/a"), ("feed 2", "https://f.example/b")]
    for listed, more in (([5], ""), (["ftp://x"], ""), ([], "{}"), ([], "[")):
        with pytest.raises(feeds.FeedConfigurationError):
            feeds.configured_feeds(listed, more)


def test_one_bad_feed_costs_itself(spark, landed):
    item = "<item><title>Hiring: security engineer</title><link>https://posts.example/in/1</link><guid>g1</guid><pubDate>Fri, 14 Aug 2026 09:30:00 +0000</pubDate><description>We are hiring</description></item>"
    good = landed("good.xml", f"<rss><channel>{item}</channel></rss>")
    bad, cut = landed("bad.xml", "no feed"), landed("cut.xml", f"<rss><channel>{item}")
    listed = [{"name": n, "url": "https://f.example", "path": p} for n, p in (("good", good), ("bad", bad), ("cut", cut), ("none", good + ".gone"))]
    rows, log = feeds.collect_feeds(spark, listed, r"posts\.example", "/in/", ["security"], ["hiring"])
    assert [x.feed_name for x in rows.collect()] == ["good"]
    assert {x.employer: (x.ok, x.jobs) for x in log.collect()} == {"good": (True, 1), "bad": (False, 0), "cut": (False, 0), "none": (False, 0)}
    assert summaries.source_status(log).first().status == "partial" and summaries.source_status(log.where("not ok")).first().status == "failed"
    none, empty = feeds.collect_feeds(spark, [], "x", "/", [], [])
    assert none.count() == 0 and empty.count() == 0


def test_pipeline(spark, landed):
    docs = {"jobs": [{"id": i, "title": t, "company_name": "Acme", "url": f"https://r.example/{i}", "publication_date": "2026-08-01T10:00:00", "description": "d"} for i, t in enumerate(["Security Engineer", "Security Engineer (m/w/d)", "Cook", "Senior Security Analyst"])]}
    raw = providers.union_sources([providers.remotive(providers.payloads(spark, landed("r.json", docs), "remotive"))])
    empty = spark.createDataFrame([], "job_key string, first_seen timestamp, last_seen timestamp, content_hash string, status string")
    import datetime as dt

    out = pipeline.run(raw, empty, F.lit(dt.datetime(2026, 8, 15)).cast("timestamp"), ["security"], ["cook"], [F.col("published_at").desc(), F.col("_ord")])
    assert sorted(x.title_normalized for x in out["report"].collect()) == ["security engineer", "senior security analyst"]
    assert {x.event for x in out["events"].collect()} == {"NEW"} and out["state"].count() == 2


def test_normalising_a_frame_without_columns(spark):
    got = normalise_postings(spark.range(1).select(F.lit("x").alias("title"))).first()
    assert got.source == "Unknown" and got.tags == [] and got.source_job_ids == {} and got.working_model == "on-site"
