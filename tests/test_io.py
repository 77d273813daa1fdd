import gzip
import json

from pyspark.sql import functions as F

from pagesieve.operators.snapshots import newest
from pagesieve.sources import io


def test_snapshot_files(spark, tmp_path):
    good = {"history": {"version": 2, "pages": {"https://e.com/": {"baseline_id": "b", "snapshots": [{"id": "b", "name": "n", "created_at": "2024-01-01", "snapshot": "{}"}]}}}}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps({"other": 1}))
    rows = io.read_snapshots(spark, str(tmp_path)).collect()
    assert [(r["url"], r["baseline_id"], r["position"], r["id"]) for r in rows] == [("https://e.com/", "b", 0, "b")]


def test_robots_and_sitemaps(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "e.com.txt").write_text("User-agent: *\nDisallow: /")
    row = io.read_robots(spark, str(tmp_path / "r")).first()
    assert row["host"] == "e.com" and row["text"].startswith("User-agent")
    (tmp_path / "s").mkdir()
    with gzip.open(tmp_path / "s" / "a.xml.gz", "wt") as f:
        f.write("<urlset></urlset>")
    assert io.read_sitemaps(spark, str(tmp_path / "s"), "https://e.com/").first()["text"] == "<urlset></urlset>"


def test_rules_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"thresholds": {"title_min": 80, "title_max": 20}, "disabled_checks": ["a", "no good"]}))
    r = io.read_rules(spark, str(tmp_path / "rules.json")).first()["rules"]
    assert (r["thresholds"]["title_min"], r["thresholds"]["title_max"], r["disabled_checks"]) == (20, 80, ["a"])


def test_csv_sink(spark, tmp_path):
    rows = spark.createDataFrame([("https://e.com/", 'a "q", b', 200)], "url string, title string, status int")
    io.write_crawl_csv(rows, str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")).decode()
    # Every part file has the header, also one without rows.
    header = text.split("\r\n")[0]
    [line] = [x for x in text.split("\r\n") if x and x != header]
    assert header.startswith("Depth,Requested URL,Final URL,Status") and header.count(",") == 23
    assert ',"a ""q"", b",' in line


def test_json_text_and_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "warning", "T", "m")], "id string, severity string, title string, message string")
    io.write_audit_json(rows, rows, str(tmp_path / "j"))
    io.write_reports(rows, str(tmp_path / "p"))
    io.write_issue_text(rows, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "[WARNING] T: m"
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    history = spark.createDataFrame([("u", "1", "n", "2024-01-01", "{}")], "url string, id string, name string, created_at string, snapshot string")
    io.write_snapshots(newest(history.withColumn("created_at", F.to_timestamp("created_at"))), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 1


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("https://e.com/?q=\"x\"", "1", 'a "b"', "2024-01-01 10:00:00", '{"title":"T é","n":1}'), ("https://e.com/?q=\"x\"", "2", "c", "2024-01-02 10:00:00", '{"title":null}'), ("https://f.com/", "9", "d", "2024-01-03 00:00:00", "{}")]
    history = spark.createDataFrame(rows, "url string, id string, name string, created_at string, snapshot string").withColumn("created_at", F.to_timestamp("created_at"))
    baselines = spark.createDataFrame([("https://f.com/", "9")], "url string, baseline_id string")
    io.write_snapshots(history, str(tmp_path / "h"), baselines)
    back = io.read_snapshots(spark, str(tmp_path / "h"), lines=True).withColumn("created_at", F.to_timestamp("created_at"))
    got = sorted((r["url"], r["id"], r["name"], str(r["created_at"]), json.loads(r["snapshot"])) for r in back.collect())
    assert got == sorted((u, i, n, t, json.loads(s)) for u, i, n, t, s in rows)
    assert {(r["url"], r["baseline_id"]) for r in back.collect()} == {("https://e.com/?q=\"x\"", None), ("https://f.com/", "9")}
    assert [r["id"] for r in back.where("position = 0 AND url LIKE '%q=%'").collect()] == ["2"]


def test_bare_history(spark, tmp_path):
    (tmp_path / "bare.json").write_text(json.dumps({"version": 2, "pages": {"https://e.com/": {"baselineId": "b", "snapshots": [{"id": "b", "name": "n", "createdAt": "2024-01-01", "snapshot": {"title": "x"}}]}}}, indent=1))
    row = io.read_snapshots(spark, str(tmp_path)).first()
    assert (row["baseline_id"], row["created_at"], json.loads(row["snapshot"])) == ("b", "2024-01-01", {"title": "x"})


def test_pages_profiles_and_audit_csv(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.com/", "x" * 3_000_000), (2, "https://e.com/2", "y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert io.read_pages(spark, str(tmp_path / "pages")).count() == 2
    assert io.read_pages(spark, str(tmp_path / "pages"), 100).count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"hostname": "e.com", "label": "E", "enabled": True, "schema_types": ["Product"], "ignore_checks": ["a.b"]}))
    p = io.read_profiles(spark, str(tmp_path / "p.json")).first()
    assert (p["hostname"], p["enabled"], p["schema_types"]) == ("e.com", True, ["Product"])
    io.write_audit_csv(spark.createDataFrame([("https://e.com/", 7)], "url string, critical int"), str(tmp_path / "a"))
    row = spark.read.csv(str(tmp_path / "a"), header=True).first()
    assert row["URL"] == "https://e.com/" and row["Critical"] == "7" and len(row) == 21
