"""Analyzers side by side, suffix rules, schemas, batches, snapshots of runs, reports and even reads of relational tables."""

from __future__ import annotations

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from spindrift.operators import analyzers, datasets, domains, graph, schema, snapshots, suffixes
from spindrift.sources import crawl as sources
from spindrift.sources import ingest, report


# --- analyzers side by side
@pytest.fixture(scope="module")
def crawl(spark):
    rows = [(i, f"https://a.example/{'x' if i % 2 else 'y'}/{i}", float(i % 3), f"https://a.example/{'x' if i % 2 else 'y'}/{i // 2}" if i else None, [f"/x/{(i * 7) % 20}", "#top"]) for i in range(20)]
    return analyzers.Crawl(spark.createDataFrame(rows, "ordinal long, url string, depth double, parent_url string, links array<string>"))


def test_shared_tables_are_built_once(spark, crawl):
    made, wait = [], threading.Barrier(4)

    def slow():
        made.append(1)
        time.sleep(0.2)
        return len(made)

    def ask():
        wait.wait()
        got.append(crawl.once("slow", slow))

    got: list[int] = []
    threads = [threading.Thread(target=ask) for _ in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert made == [1] and got == [1] * 4


def test_a_failed_builder_leaves_it_to_the_next(crawl):
    def fail():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        crawl.once("later", fail)
    assert crawl.once("later", lambda: 5) == 5


def test_named_analyzers_and_a_failing_one(spark, crawl, tmp_path):
    broken = analyzers.Sections({"good": lambda c: c.pages, "bad": lambda c: c.pages.select(F.raise_error(F.lit("lost it")).alias("x"))})
    log = {r["name"]: r for r in analyzers.run(crawl, str(tmp_path), ["network", "broken", "unknown"], "t", analyzers.ANALYZERS | {"broken": broken}).collect()}
    assert set(log) == {"t_network", "t_broken"}
    assert log["t_network"]["error"] is None and log["t_network"]["sections"]["hits"] == 20 and log["t_network"]["rows"] == sum(log["t_network"]["sections"].values())
    assert log["t_broken"]["rows"] is None and log["t_broken"]["sections"] == {} and "lost it" in log["t_broken"]["error"] and "\n" not in log["t_broken"]["error"]
    one = spark.read.parquet(f"{tmp_path}/t_network/metrics").first()
    assert one["edges"] == graph.edges(crawl.links).count() == crawl.edges.count()


def test_a_late_analyzer_is_cancelled(spark, crawl, tmp_path):
    slow = F.udf(lambda x: time.sleep(60) or x, "string")
    known = {"late": lambda c: c.select(slow("url")), "quick": lambda c: c.select("url")}
    began = time.time()
    log = {r["name"]: r for r in analyzers.run(crawl, str(tmp_path), ["late", "quick"], analyzers=known, seconds=8).collect()}
    assert time.time() - began < 50
    assert log["quick"]["rows"] == 20 and log["late"]["rows"] is None and log["late"]["error"] == "stopped after 8 seconds"


# --- suffix rules
RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.compute.example", "example", "// a comment", "", "co.uk // twice"]
HOSTS = {
    "a.b.shop.co.uk": ("a.b", "shop", "co.uk"), "shop.uk": ("", "shop", "uk"), "co.uk": ("", "", "co.uk"), "x.y.z.ck": ("x", "y", "z.ck"), "www.ck": ("", "www", "ck"), "a.www.ck": ("a", "www", "ck"), "ck": ("", "ck", ""),
    "z.ck": ("", "", "z.ck"), "h.eu.compute.example": ("", "h", "eu.compute.example"), "compute.example": ("", "compute", "example"), "A.Shop.COM": ("a", "shop", "com"), "localhost": ("", "localhost", ""), "a.unknown": ("a", "unknown", ""),
    "10.0.0.1": ("", "10.0.0.1", ""), "::1": ("", "::1", ""), "shop.com.": ("", "shop", "com"),
}


def test_suffix_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, *HOSTS, None]], "host string")
    got = {r["host"]: (r["subdomain"], r["domain"], r["suffix"]) for r in suffixes.split_hosts(hosts, rules).collect()}
    assert got == HOSTS
    named = {r["host"]: (r["registered_domain"], r["fqdn"]) for r in suffixes.with_names(suffixes.split_hosts(hosts, rules)).collect()}
    assert named["a.b.shop.co.uk"] == ("shop.co.uk", "a.b.shop.co.uk") and named["co.uk"] == named["localhost"] == ("", "")


def plain_split(host, rules):
    labels, best = host.split("."), None
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts, labels[len(labels) - len(parts) :], strict=True)):
            best = max(best or (False, 0), (rule.startswith("!"), len(parts)))
    n = best[1] - best[0] if best else 0
    return ".".join(labels[: max(len(labels) - n - 1, 0)]), labels[len(labels) - n - 1] if len(labels) > n else "", ".".join(labels[len(labels) - n :]) if n else ""


def test_suffix_rules_against_a_plain_match(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcd")
    rules = sorted({".".join(word() for _ in range(r.randrange(1, 4))) for _ in range(12)} | {"*." + ".".join(word() for _ in range(r.randrange(1, 3))) for _ in range(6)})
    rules += sorted({"!" + word() + x[1:] for x in rules if x.startswith("*.")})
    hosts = sorted({".".join(word() for _ in range(r.randrange(1, 6))) for _ in range(400)})
    found = suffixes.split_hosts(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(x,) for x in rules], "rule string"))
    assert {x["host"]: (x["subdomain"], x["domain"], x["suffix"]) for x in found.collect()} == {h: plain_split(h, rules) for h in hosts}


def test_no_rules(spark):
    none = spark.createDataFrame([], "rule string")
    hosts = spark.createDataFrame([("a.b.c",)], "host string")
    assert tuple(suffixes.split_hosts(hosts, none).first())[1:4] == ("a.b", "c", "")
    assert tuple(suffixes.split_hosts(hosts, none, default_rule=True).first())[1:4] == ("a", "b", "c")


def test_all_parts_of_a_url(spark):
    pages = spark.createDataFrame([(0, "https://u@A.Shop.co.uk:81/x/y.tar.Gz?k=1&k=2&e=&z=a%20b#f"), (1, "/only/path/"), (2, None)], "ordinal long, url string")
    got = {r["ordinal"]: r for r in suffixes.components(pages, spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()}
    one = got[0]
    assert (one["registered_domain"], one["fqdn"], one["netloc"], one["filename"], one["file_extension"]) == ("shop.co.uk", "a.shop.co.uk", "u@A.Shop.co.uk:81", "y.tar.Gz", "Gz")
    assert one["query_params"] == {"k": ["1", "2"], "z": ["a b"]} and one["query_param_count"] == 2 and one["path_segments"] == ["x", "y.tar.Gz"]
    assert got[1]["fqdn"] == "" and got[1]["filename"] is None and got[1]["path_depth"] == 2 and len(got) == 3


# --- schemas
NESTED = {
    "type": "object", "required": ["id"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 1, "maximum": 9}, "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 3}}, "kind": {"enum": ["a", 1, None]}, "in": {"type": "object", "properties": {"a b": {"type": ["boolean", "null"]}}}},
}


def found_errors(spark, lines, rules=None):
    df = spark.createDataFrame(list(enumerate(lines)), "ordinal long, line string")
    out: dict[int, set] = {}
    for r in schema.error_rows(df, rules).collect():
        out.setdefault(r["line_number"] - 1, set()).add((r["path"], r["message"]))
    return out


def test_all_errors_of_a_record(spark):
    lines = [json.dumps(x) for x in ({"id": 1, "tags": ["a"], "kind": None, "in": {"a b": None}}, {"id": 0.5, "tags": [], "kind": 2, "more": 1, "in": {"a b": 3}}, {"id": 12, "tags": ["abcd", 5, "A", "x"]}, [], {"id": 2.0, "kind": "a"}, {"id": None})] + ["", "{"]
    assert found_errors(spark, lines, NESTED) == {
        1: {("<root>", "Additional properties are not allowed: more"), ("id", "0.5 is not of type 'integer'"), ("id", "0.5 is less than the minimum of 1"), ("tags", "[] is too short"), ("kind", '2 is not one of ["a", 1, null]'), ("in -> a b", "3 is not of type 'boolean', 'null'")},
        2: {("id", "12 is greater than the maximum of 9"), ("tags", '["abcd",5,"A","x"] is too long'), ("tags -> 0", "'abcd' is too long"), ("tags -> 1", "5 is not of type 'string'"), ("tags -> 2", "'A' does not match '^[a-z]+$'")},
        3: {("<root>", "[] is not of type 'object'")},
        5: {("id", "null is not of type 'integer'")},
        7: {("<line>", "Line 8: Invalid JSON")},
    }


def test_crawl_records(spark):
    good = {"url": "u", "depth": 1, "status_code": None, "content_type": None, "links": []}
    found = found_errors(spark, [json.dumps(x) for x in (good, good | {"url": ""}, {"url": "u"}, good | {"depth": True, "title": 3})])
    assert found[1] == {("url", "'' should be non-empty")} and found[2] == {("<root>", f"'{c}' is a required property") for c in ("depth", "status_code", "content_type", "links")}
    assert found[3] == {("depth", "true is not of type 'number'"), ("title", "3 is not of type 'string', 'null'")} and 0 not in found


def test_counts_come_with_the_pass(spark, tmp_path):
    lines = spark.createDataFrame([(0, '{"url": "u"}'), (1, "{"), (2, ""), (3, '{"url": "u", "depth": 1, "status_code": 1, "content_type": "x", "links": []}')], "ordinal long, line string")
    rows, seen = schema.validated(lines)
    rows.select("line_number").write.parquet(str(tmp_path / "x"))
    assert seen.get == {"lines": 3, "valid": 1, "errors": 5, "malformed": 1}
    assert [r["line_number"] for r in schema.valid_lines(lines).collect()] == [4]


def test_one_scan_and_no_shuffle(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"url": "u"}\n')
    lines = spark.read.text(str(tmp_path / "c.jsonl")).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("line"))
    plan = schema.error_rows(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match="anyOf"):
        schema.errors(F.col("v"), {"anyOf": []})


# --- batches
BATCH = [(0, "https://a.example/x/y.Html", 200, 10.0), (1, "https://a.example/x", None, None), (2, "nowhere", 404, 5.0), (3, "https://a.example/x", 500, 7.0), (4, "", 1, 1.0), (5, None, 1, 1.0)]
OTHER = [(0, "https://a.example/x", 301, 2.0), (1, "https://b.example/", 200, None)]


def test_batches_in_either_order_and_twice(spark, tmp_path):
    frames = {k: spark.createDataFrame(rows, "ordinal long, url string, status_code int, crawled_at double") for k, rows in (("one", BATCH), ("two", OTHER))}
    tables = []
    for n, order in enumerate((["one", "two"], ["two", "one"], ["two", "two", "one", "two", "one"])):
        store = ingest.UrlStore(spark, str(tmp_path / str(n)), 4)
        assert store.read().count() == 0
        for k in order:
            store.insert(frames[k], k)
        tables.append(sorted(map(tuple, store.read().select("url", "domain", "path", "status_code", "file_extension").collect())))
    assert tables[0] == tables[1] == tables[2] == [("https://a.example/x", "a.example", "x", None, None), ("https://a.example/x/y.Html", "a.example", "x/y.Html", 200, "Html"), ("https://b.example/", "b.example", "", 200, None), ("nowhere", None, None, 404, None)]
    before = store.stored().count()
    store.insert(frames["one"], "one")
    assert store.stored().count() == before == 5  # the record of "one" that precedes that of "two" came later
    assert not [p for p in (tmp_path / "2" / "_staging").iterdir()]


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    store = ingest.UrlStore(spark, str(tmp_path), 4)
    store.insert(spark.createDataFrame(OTHER, "ordinal long, url string, status_code int, crawled_at double"), "two")
    bad = spark.createDataFrame(BATCH, "ordinal long, url string, status_code int, crawled_at double").withColumn("content_type", F.when(F.col("ordinal") == 2, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        store.insert(bad, "one")
    assert store.read().count() == 2


# --- snapshots of runs
def test_snapshots_of_drifting_files(spark, tmp_path):
    files = {
        "basic/analysis_results.json": {"metadata": {"total_urls": 7, "analysis_timestamp": "t"}, "insights": {"key_findings": ["a", 2, "c"], "alerts": ["⚠ high"], "scores": {"q": 1.25, "text": "x", "flag": True}}},
        "basic/other.json": {"metadata": {"total_urls": 99}}, "enhanced/enhanced_analysis_results.json": {"metadata": {"raw_urls": 5}, "insights": {"key_findings": "one", "alerts": {}, "scores": []}},
        "mlx/analysis_results.json": {"metadata": {"total_urls": 50}}, "unknown/analysis_results.json": {},
    }
    for name, value in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    found = snapshots.extract(snapshots.read_files(spark, str(tmp_path)), now="now")
    rows = [tuple(r)[0:1] + tuple(r)[3:] for r in found.orderBy("position").collect()]
    assert rows == [("basic", 7, "t", ["a", "2", "c"], ["⚠ high"], {"q": 1.25}), ("enhanced", 5, "now", ["one"], [], {})]
    assert tuple(snapshots.summary(found).first()) == (12, 1, ["basic", "enhanced"], ["a", "2", "one"])
    lines = [r["line"] for r in snapshots.report(found, "today").orderBy("line_number").collect()]
    assert lines[0] == "# Unified Analysis Summary" and {"- Alerts detected: **1**", "- high", "- Total URLs analyzed: **12**", "**Key Findings**", "- one"} <= set(lines)
    assert any(x.startswith("- Scores: q: 1.") for x in lines)
    assert lines.index("## Basic Analysis") < lines.index("## Enhanced Analysis")


def test_the_first_file_of_a_run_counts(spark):
    files = spark.createDataFrame([("run", "b.json", '{"metadata":{"total_urls":2}}'), ("run", "a.json", '{"metadata":{"total_urls":1}}'), ("bad", "a.json", "[1]")], "pipeline string, file string, text string")
    assert [(r["pipeline"], r["file"], r["total_urls"]) for r in snapshots.extract(files, {"run": ("a.json", "b.json"), "bad": ("a.json",)}).collect()] == [("run", "a.json", 1)]


# --- the report
def test_a_report_gives_its_results_back(spark, tmp_path):
    results = {
        "numbers": spark.range(300).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 2 == 0, F.lit("a\n\"b\"")).alias("text")), "nested": spark.createDataFrame([(1, [1, 2], {"k": 1.5})], "a int, b array<int>, m map<string,double>"),
        "none": spark.createDataFrame([], "a int"),
    }
    path = str(tmp_path / "report.json")
    for _ in range(2):  # the second replaces the first
        report.write_report(results, path, {"total_urls": 3})
    whole = json.loads((tmp_path / "report.json").read_text())
    assert whole["metadata"] == {"total_urls": 3} and whole["sections"] == ["numbers", "nested", "none"]
    assert [r["section"] for r in whole["results"][1:]] == ["numbers"] * 300 + ["nested"]
    again = report.read_report(spark, path, {"numbers": "id BIGINT, x DOUBLE, text STRING", "nested": "a INT, b ARRAY<INT>, m MAP<STRING, DOUBLE>", "none": "a INT"})
    for name, df in results.items():
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, df.collect()))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]


# --- relational tables
def test_even_reads_of_a_table(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    skewed = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.pow(F.col("id") / 100, F.lit(6)).cast("long")).alias("K"), F.col("id").alias("V"))
    try:
        skewed.write.jdbc(options["url"], "T", properties={"driver": options["driver"]})
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database: {type(e).__name__}")
    even = sources.read_table_evenly(spark, options, "T", "K", 5)
    sizes = [len(x) for x in even.rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 5 and max(sizes) < 330
    assert sorted(map(repr, even.collect())) == sorted(map(repr, skewed.collect()))
    assert "PushedFilters" in even.where("V = 5")._jdf.queryExecution().executedPlan().toString()
    assert sources.read_table_evenly(spark, options, "T", "V", 1).rdd.getNumPartitions() == 1


# --- what is new of domains and files
def test_blocks_of_the_hierarchy(spark):
    pages = spark.range(1000).select(F.concat(F.lit("https://a.b.example.com/"), F.format_string("%04d", F.col("id"))).alias("url"), F.col("id").alias("ordinal"), F.lit(1).alias("depth"))
    found = domains.hierarchy_urls(pages.union(pages), 64).orderBy("block").collect()
    assert [len(r["urls"]) for r in found] == [64] * 15 + [40] and sum((r["urls"] for r in found), []) == sorted(r["url"] for r in pages.collect())
    assert {(r["domain"], r["subdomain"]) for r in found} == {("example.com", "a.b")}


def test_normalized_file_keeps_fields(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(x) + "\n" for x in ({"url": "https://a.example/x/#s", "links": ["/b"], "content_length": 5}, {"url": "https://a.example/x", "title": "T", "content_type": "t", "links": ["/a"]})))
    sources.normalize_file(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "out"))
    one = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert len(one) == 1 and one[0]["links"] == ["/a", "/b"] and one[0]["fragments"] == ["s"] and one[0]["merged_count"] == 2 and one[0]["title"] == "T"


def test_probe(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/probe;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert sources.probe(spark, options, "SELECT 1 AS one FROM SYSIBM.SYSDUMMY1")
    assert not sources.probe(spark, options | {"url": "jdbc:none:x"}, retries=2, pause=0.0)


def test_status_of_a_run(spark):
    log = spark.createDataFrame([("b", 1, 1.0, None, {}), ("a", None, 0.0, "Error: no", {})], analyzers.LOG)
    lines = [r["line"] for r in analyzers.status_lines(log, "c.jsonl", 12345, 1.5).orderBy("line_number").collect()]
    assert lines == ["Analysis Summary", "Input File: c.jsonl", "Total URLs Analyzed: 12,345", "Total Execution Time: 1.50s", "", "Completed Analyses:", "- a: ERROR", "- b: OK"]


def test_registry_pages_and_counts(spark):
    spark.range(25).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).createOrReplaceTempView("numbers")
    own = {"numbers": lambda: spark.range(3), "letters": lambda: spark.range(5)}
    plain, merged = datasets.Datasets(spark, {}), datasets.Datasets(spark, own)
    assert {x["key"]: x["is_custom"] for x in merged.names()} | {"letters": True, "numbers": True} == {x["key"]: x["is_custom"] for x in merged.names()}
    assert merged.count("numbers") == 3 and plain.count("numbers") == 25  # a predefined name wins
    found = plain.query("numbers", 10, 20, {"kind": "even"})
    assert (found["total"], found["has_more"], found["data"].count()) == (13, False, 0)
    found = plain.query("numbers", 10, 0, {"kind": "even", "no such": 1, "bad name;": 2})
    assert (found["total"], found["has_more"], found["data"].count()) == (13, True, 10)
    assert plain.page("numbers", -5, -5).count() == 25 and datasets.valid_limit(10**9) == 10000
    spark.range(1).createOrReplaceTempView("later")
    assert "later" not in {x["key"] for x in plain.names()} and "later" in {x["key"] for x in plain.names(refresh=True)}
    with pytest.raises(ValueError, match="no dataset"):
        plain.frame("absent")
    [spark.catalog.dropTempView(n) for n in ("numbers", "later")]


def test_pages_and_truncated_texts(spark):
    assert [datasets.page_count(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2]
    texts = spark.createDataFrame([("abc",), ("abcd",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(datasets.truncated(F.col("t"), 3)).collect()] == ["abc", "abc...", "", None]
