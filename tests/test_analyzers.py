"""Analyzers by name and tier, errors by line, merged records, and the report of two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import analyzers, normalize, quality, tracking
from spindrift.sources import crawl as sources

COLUMNS = "ordinal long, url string, depth double, title string, status_code int, content_type string, response_time_ms double, discovered_at double, links array<string>, note string"
ROWS = [
    (0, "https://a.example/x/#one", 2.0, "", 200, None, 1.0, 50.0, ["/p"], "first"),
    (1, "https://a.example/x", 1.0, "T", 200, "text/html", 2.0, 90.0, ["/q", "/p"], "best"),
    (2, "https://a.example/y", None, None, None, None, -1.0, None, None, None),
]


def records(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_failing_analyzer_is_isolated(spark, tmp_path):
    known = {"good": lambda c: c.select("url"), "bad": lambda c: c.select("missing"), "late": lambda c: c.select(F.raise_error(F.lit("no")).alias("x"))}
    got = {r["name"]: r for r in analyzers.run(records(spark), str(tmp_path), ["good", "bad", "unknown", "late"], "basic", known).collect()}
    assert set(got) == {"basic_good", "basic_bad", "basic_late"}
    assert got["basic_good"]["rows"] == 3 and got["basic_good"]["error"] is None
    assert got["basic_bad"]["rows"] is None and "missing" in got["basic_bad"]["error"] and got["basic_late"]["error"]
    assert spark.read.parquet(f"{tmp_path}/basic_good").count() == 3


def test_tiers(spark, tmp_path):
    got = analyzers.run_tiers(records(spark), str(tmp_path), ["basic", "enhanced", "patterns"]).collect()
    assert [r["name"] for r in got] == [f"{t}_{n}" for t, names in analyzers.TIERS.items() for n in names]
    assert all(r["error"] is None for r in got), [r["error"] for r in got]
    assert analyzers.run_tiers(records(spark), str(tmp_path), []).count() == 0


def test_embedded_ids_have_six_digits(spark, tmp_path):
    """Order pages as in `site`: numbers of six digits are ids, shorter ones aren't, so the section's rows in the log depend on the tables."""
    for keys, rows in (([99998, 99999], 0), ([99999, 100000, 100001], 1)):
        pages = spark.createDataFrame([(i, f"https://shop.example.com/order/{k}") for i, k in enumerate(keys)], "ordinal long, url string")
        path = f"{tmp_path}/{rows}"
        log = analyzers.run(pages, path, ["url_components"]).first()
        assert log["error"] is None and log["sections"]["embedded"] == rows
        found = [tuple(r) for r in spark.read.schema("kind string, count long, unique_values long").parquet(f"{path}/url_components/embedded").collect()]
        assert found == [("id", 2, 2)][:rows]


def test_errors_by_line(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"url": "a"}\n\n{broken\n"b"\nnope\n')
    got = sources.jsonl_errors(spark, str(tmp_path / "c.jsonl")).orderBy("line_number").collect()
    assert [tuple(r) for r in got] == [(3, "Line 3: Invalid JSON"), (5, "Line 5: Invalid JSON")]
    assert sources.jsonl_errors(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_errors_by_record(spark):
    got = {tuple(r) for r in quality.record_errors(records(spark)).collect()}
    assert got == {(0, "content_type"), (2, "depth"), (2, "response_time_ms"), (2, "status_code"), (2, "content_type")}
    assert [r["ordinal"] for r in quality.valid_records(records(spark)).collect()] == [1]


def test_merged_records_keep_all_columns(spark):
    got = {r["url"]: r for r in normalize.merged_records(records(spark)).collect()}
    r = got["https://a.example/x"]
    assert (r["note"], r["title"], r["links"], r["fragments"], r["discovered_at"], r["merged_count"]) == ("best", "T", ["/p", "/q"], ["one"], 50.0, 2)
    r = got["https://a.example/y"]
    assert (r["links"], r["fragments"], r["discovered_at"], r["merged_count"], r["note"]) == ([], None, None, 1, None)
    plain = {r["url"]: r for r in normalize.merged_records(records(spark), merge_metadata=False).collect()}
    assert plain["https://a.example/x"]["links"] == ["/q", "/p"] and plain["https://a.example/x"]["discovered_at"] == 90.0
    assert normalize.merged_records(records(spark).limit(0)).count() == 0
    assert sorted(r["ordinal"] for r in normalize.merged_sources(records(spark)).where("canonical = 'https://a.example/x'").collect()) == [0, 1]


def test_report_of_last_two_snapshots(spark):
    rows = [(f"s{i}", None, {"error_rate": 10.0 - i, "total_urls": 5.0}) for i in range(6)]
    p = tracking.points(spark.createDataFrame(rows, "snapshot_id string, ts timestamp, metrics map<string,double>"))
    got = {r["metric"]: r for r in tracking.last_two(p).collect()}
    assert (got["error_rate"]["baseline"], got["error_rate"]["current"], got["error_rate"]["verdict"], got["error_rate"]["trend"]) == (6.0, 5.0, "none", "worsening")
    assert got["total_urls"]["trend"] is None
    assert tracking.last_two(p.where("snapshot_id = 's0'")).count() == 0


def test_key_metrics(spark):
    one = lambda **v: spark.createDataFrame([tuple(v.values())], list(v))
    got = {r["metric"]: r["value"] for r in tracking.key_metrics({"statistical": one(total_urls=7, depth_mean=1.5), "network": one(density=0.25), "pathway": one(max_depth=12)}).collect()}
    assert list(got) == tracking.KEY_METRICS
    assert (got["total_urls"], got["avg_depth"], got["graph_density"], got["depth_efficiency"], got["error_rate"]) == (7.0, 1.5, 0.25, 0.0, 0.0)


def test_analyzers_share_what_they_look_for(spark, tmp_path, monkeypatch):
    """Links are resolved once, and so are the parts of URLs, those of records and of pages; no Python where nothing needs it."""
    from spindrift.operators import graph

    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or staged(df, label))
    rows = [(i, f"https://e.com/a/{i}", "https://e.com/a/0" if i else None, min(i, 1)) for i in range(4)]
    site = spark.createDataFrame(rows, "ordinal long, url string, parent_url string, depth int")
    links = spark.createDataFrame([(f"https://e.com/a/{i}", x) for i in range(4) for x in ("/a/0", "/a/1", "#x", "https://f.com/")], "src string, link string")
    log = analyzers.run(analyzers.Crawl(site, links), str(tmp_path), ["network", "pathway", "subdomain", "url_components"]).collect()
    assert all(r["error"] is None for r in log), [r["error"] for r in log]
    assert all(written.count(x) == 1 for x in ("links", "parsed", "named", "locations", "edges", "classes"))
    got = spark.read.parquet(f"{tmp_path}/network/link_patterns").first().asDict()
    assert got == {"self_links": 6, "fragment_links": 4, "external_links": 4, "sibling_links": 2, "cross_depth_links": 4}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/pathway/dead_ends").collect()] == []


def test_orphans_by_degrees_and_by_links(spark):
    from spindrift.operators import graph

    rows = [(0, "https://e.com/0", None, 0), (1, "https://e.com/1", "https://e.com/0", 1), (2, "https://e.com/2", "", 1), (3, "https://e.com/3", "https://e.com/3", 2), (4, "https://e.com/4", None, None)]
    site = spark.createDataFrame(rows, "ordinal long, url string, parent_url string, depth int")
    e = spark.createDataFrame([("https://e.com/1", "https://e.com/4"), ("https://e.com/0", "https://e.com/9")], "src string, dst string")
    by_links = graph.architecture(site, e).first()
    assert by_links["orphans"] == 3 and graph.architecture(graph.full_degrees(site, e), e).first() == by_links
