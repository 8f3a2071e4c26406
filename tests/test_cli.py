import json

from brimfold.plans import cli, tracker
from brimfold.sources.sinks import SwappedTable


def config(tmp_path, sources):
    p = tmp_path / "config.json"
    p.write_text(json.dumps({"sources": sources, "state": str(tmp_path / "state"), "out": str(tmp_path / "out"), "now": "2026-08-15T12:00:00Z", "accept": ["security"], "veto": ["cook"]}))
    return [str(p)]


def test_runs_and_exit_status(spark, tmp_path):
    good, bad = tmp_path / "r.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"jobs": [{"id": 1, "title": "Security Engineer", "company_name": "A", "url": "https://x.example/1", "publication_date": "2026-08-01", "description": "d"}, {"id": 2, "title": "Cook", "company_name": "B"}]}))
    bad.write_text("{")
    both = [{"kind": "remotive", "path": str(good)}, {"kind": "arbeitnow", "path": str(bad)}, {"kind": "lever", "path": "none", "enabled": False}]
    assert cli.main(config(tmp_path, both)) == 0
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert [(x["title"], x["status"]) for x in report] == [("Security Engineer", "NEW")]
    assert {x["source"]: x["status"] for x in json.loads((tmp_path / "out/sources.json").read_text())} == {"remotive": "ok", "arbeitnow": "failed"}
    assert cli.main(config(tmp_path, both)) == 0
    assert [x["status"] for x in json.loads((tmp_path / "out/report.json").read_text())] == ["SEEN_BEFORE"]
    assert SwappedTable(spark, str(tmp_path / "state"), cli.STATE).read().count() == 1
    alert = json.loads((tmp_path / "out/alert.json").read_text())
    assert (alert["candidate_count"], alert["truncated_count"], alert["has_alert"]) == (0, 0, False)  # seen before
    assert SwappedTable(spark, str(tmp_path / "out/history"), cli.HISTORY).read().count() == 2
    assert "## Sources" in (tmp_path / "out/report.md").read_text()
    assert cli.main(config(tmp_path, both[1:2])) == 2
    assert cli.main(config(tmp_path, [{"kind": "nobody", "path": "x"}])) == 1 and cli.main([str(tmp_path / "missing.json")]) == 1


def test_feeds_in_a_run(spark, tmp_path):
    feed = tmp_path / "f.xml"
    feed.write_text("<rss><channel><item><title>Hiring: security engineer</title><link>https://posts.example/in/1</link><guid>g1</guid><author>Acme</author><description>We are hiring</description></item></channel></rss>")
    source = {"kind": "feed", "feeds": [{"url": "https://f.example/a", "path": str(feed)}, {"url": "https://f.example/b", "path": str(tmp_path / "none.xml")}], "host": r"posts\.example", "path_part": "/in/", "topic": ["security"], "call": ["hiring"]}
    assert cli.main(config(tmp_path, [source])) == 0
    assert [x["company"] for x in json.loads((tmp_path / "out/report.json").read_text())] == ["Acme"]
    assert {x["source"]: x["status"] for x in json.loads((tmp_path / "out/sources.json").read_text())} == {"feed_posts": "partial"}
    health = {x.key: x.failures for x in SwappedTable(spark, str(tmp_path / "out/health"), cli.HEALTH).read().collect()}
    assert health == {"feed_posts:feed 1": 0, "feed_posts:feed 2": 1}


def test_tracker(spark, tmp_path, capsys):
    root = str(tmp_path / "kept")
    run = lambda *a: tracker.main([root, *a])
    spark.createDataFrame([("k1", "Acme", "Security Engineer", 80, "https://x.example/1", "2026-08-10")], tracker.JOBS).write.parquet(f"{root}/jobs")
    (tmp_path / "kept/tracker.json").write_text(json.dumps({"statuses": ["REVIEW", "APPLIED"], "dated": ["APPLIED"], "verdicts": ["SUITABLE", "FALSE_POSITIVE"]}))
    assert run("applications", "set", "--job-key", "k1", "--notes", "first") == 0  # company, title, score and address from the posting
    assert run("applications", "set", "--job-key", "k1", "--status", "applied") == 1 and "missing in this state" in capsys.readouterr().err
    assert run("applications", "set", "--job-key", "k1", "--status", "applied", "--date", "2026-08-12") == 0
    assert run("applications", "set", "--job-key", "k2") == 1 and run("applications", "set", "--job-key", "k1", "--score", "500") == 1
    assert [tuple(x)[:8] for x in tracker.Tracker(spark, root).applications.read().collect()] == [("k1", "Acme", "Security Engineer", "APPLIED", 80, "2026-08-12", "https://x.example/1", "first")]
    capsys.readouterr()
    assert run("applications", "list") == 0 and "Acme | Security Engineer | 2026-08-12" in capsys.readouterr().out
    assert run("applications", "export") == 0
    assert run("review", "mark", "--job-key", "k1", "--verdict", "suitable") == 0 and run("review", "mark", "--job-key", "k1", "--verdict", "false-positive") == 0
    assert run("review", "mark", "--job-key", "none", "--verdict", "suitable") == 1 and run("review", "mark", "--job-key", "k1", "--verdict", "maybe") == 1
    assert run("review", "missed", "--company", "B", "--position", "P", "--url", "https://b.example", "--found-date", "2026-08-11") == 0
    assert run("review", "missed", "--company", "B", "--position", "P", "--url", "ftp://b", "--found-date", "2026-08-11") == 1 and run("review", "missed", "--company", "B", "--position", "P", "--url", "https://b.example", "--found-date", "11.8.") == 1
    capsys.readouterr()
    assert run("review", "list") == 0 and capsys.readouterr().out.splitlines() == ["FALSE_POSITIVE  Acme | Security Engineer", "MISSED          B | P"]
    history = "_ord int, generated_at string, employer_mode string, quality_review_schema_version int, relevant_jobs_in_current_run int, new_jobs int, jobs_collected int, security_title_candidates int, duplicates_removed int, workflow_duration_seconds double, source_status map<string,struct<status:string>>"
    rows = [(1, "2026-08-10T06:00:00Z", "daily", 1, 9, 9, 9, 9, 9, 9.0, {}), (2, "2026-08-10T09:00:00Z", "daily", 1, 3, 1, 100, 10, 2, 20.0, {"a": ("ok",), "b": ("failed",), "c": ("idle",)}), (3, "2026-08-12T06:00:00Z", None, 1, 4, None, 50, 6, 2, None, {"a": ("partial",), "b": (None,)}), (4, "2026-08-13", "full", 1, 5, 5, 5, 5, 5, 5.0, {}), (5, None, "daily", 1, 1, 1, 1, 1, 1, 1.0, {}), (6, "2026-08-14", "daily", 0, 1, 1, 1, 1, 1, 1.0, {})]
    spark.createDataFrame(rows, history).write.parquet(f"{root}/runs")
    assert run("review", "report", "--runs", f"{root}/runs") == 0
    got = {x["metric"]: x["value"] for x in json.loads((tmp_path / "kept/review.json").read_text())}
    want = {"runs": 2, "relevant_jobs_in_current_run": 7, "new_jobs": 1, "jobs_collected": 150, "duplicates_removed": 4, "duplicate_rate_percent": 25.0, "average_workflow_duration_seconds": 20.0, "workflow_duration_coverage_runs": 1, "source_checks": 4, "source_failures": 2, "source_partials": 1, "source_failure_rate_percent": 50.0, "reviewed_jobs": 1, "false_positives": 1, "suitable_jobs_confirmed": 0, "false_positive_rate_percent": 100.0, "false_positive_rate_is_reliable": 0, "missed_suitable_jobs": 1}
    assert {k: got[k] for k in want} == want
