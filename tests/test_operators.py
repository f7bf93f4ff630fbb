"""Known small results of the graph, statistics, dataset and tracking operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import datasets, graph, normalize, stats, tracking


def site(spark, links, parents=()):
    names = sorted({a for a, _ in links})
    parent = dict(parents)
    pages = spark.createDataFrame([(i, f"https://e.com/{n}", f"https://e.com/{parent[n]}" if n in parent else None, 0) for i, n in enumerate(names)], "ordinal long, url string, parent_url string, depth int")
    return pages, graph.edges(spark.createDataFrame([(f"https://e.com/{a}", f"/{b}") for a, b in links if b], "src string, link string"))


def test_simple_graph(spark):
    pages, e = site(spark, [("A", "B"), ("A", "D"), ("B", "C"), ("D", "C"), ("C", "")])
    m = graph.network_metrics(pages, e).first()
    assert (m["nodes"], m["edges"], m["reciprocity"]) == (4, 4, 0.0)
    assert m["density"] == pytest.approx(1 / 3)
    top = graph.hits(graph.degrees(pages, e), e)
    assert top.where("hub = 1").first()["url"].endswith("/A")
    assert top.where("authority = 1").first()["url"].endswith("/C")


def test_mutual_and_complete_graphs(spark):
    pages, e = site(spark, [(a, b) for a, b in ("AB", "BA", "AC", "CA", "BD", "DB", "CD", "DC")])
    m = graph.network_metrics(pages, e).first()
    assert (m["reciprocity"], m["density"]) == (1.0, pytest.approx(8 / 12))
    pages, e = site(spark, [(a, b) for a in "ABC" for b in "ABC" if a != b])
    assert [r["coefficient"] for r in graph.clustering(pages, e).collect()] == [1.0] * 3


def test_reach_components_against_search(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        n = 12
        links = [(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, n, (14, 2))] + [(f"n{i:02}", "") for i in range(n)]
        parents = [(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, n, (3, 2)) if a != b]
        pages, e = site(spark, links, parents)
        got = {r["url"][-3:]: r["component"] for r in graph.reach_components(pages, e).collect()}
        ways = {}
        for a, b in [x for x in links if x[1]] + list(dict(parents).items()) + [(b, a) for a, b in dict(parents).items()]:
            ways.setdefault(a, set()).add(b)
        seen: dict[str, int] = {}
        for i in range(n):
            todo = [f"n{i:02}"] if f"n{i:02}" not in seen else []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += ways.get(x, ())
        assert got == seen


def test_chains_cut_cycles(spark):
    pages, _ = site(spark, [(x, "") for x in "ABC"], [("A", "B"), ("B", "C"), ("C", "A")])
    chains = {r["url"][-1]: [c[-1] for c in r["chain"]] for r in graph.parent_chains(pages).collect()}
    assert chains["A"] == ["C", "B", "A"]


def test_shapiro_and_p_values():
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert (w, p) == (pytest.approx(0.79, abs=0.005), pytest.approx(0.0067, abs=0.002))
    assert stats.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_histogram_of_equal_values(spark):
    rows = stats.histogram(spark.createDataFrame([(3,)] * 4, "x int"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 4, 0]
    assert (rows[0]["low"], rows[-1]["high"]) == (2.5, 3.5)


def test_constant_columns_have_no_correlation(spark):
    f = spark.createDataFrame([(i, 1, i) for i in range(5)], "ordinal long, a int, b int")
    assert stats.correlations(f, [("a", "b")]).first()["r"] is None


def test_guards(spark):
    assert [datasets.valid_limit(x) for x in (5, 0, -1, "7", None, 10**6)] == [5, 100, 100, 100, 100, 10_000]
    assert [datasets.valid_offset(x) for x in (5, -1, "x")] == [5, 0, 0]
    for bad in ("'; DROP TABLE urls; --", "1abc", "a b", "a.b", "", "urls;", "x--"):
        assert not datasets.valid_identifier(bad)
    d = datasets.Datasets(spark, {})
    assert d.columns("no_such_table") == []
    with pytest.raises(ValueError, match="no dataset"):
        d.page("missing")


def test_merge_prefers_fuller_records(spark):
    rows = [(0, "https://e.com/a#x", None, None, 1, 5.0, ["l1"]), (1, "https://e.com/a", "T", "text/html", 2, 9.0, ["l2"]), (2, "https://e.com/b", None, None, None, None, None)]
    crawl = spark.createDataFrame(rows, "ordinal long, url string, title string, content_type string, depth int, discovered_at double, links array<string>")
    got = {r["canonical"]: r for r in normalize.merged(crawl).collect()}
    a = got["https://e.com/a"]
    assert (a["url"], a["records"], a["discovered_at"], a["had_fragment"]) == ("https://e.com/a", 2, 5.0, 1)
    assert normalize.merged_links(crawl).where("canonical like '%/a'").first()["links"] == ["l1", "l2"]


def test_trend_labels(spark):
    p = spark.createDataFrame([("s1", 1, "error_rate", 10.0), ("s2", 2, "error_rate", 5.0), ("s1", 1, "urls_per_second", 1.0), ("s2", 2, "urls_per_second", 9.0)], "snapshot_id string, ts int, metric string, value double")
    got = {r["metric"]: r["trend"] for r in tracking.trends(p).collect()}
    assert got == {"error_rate": "worsening", "urls_per_second": "improving"}


def test_stream_equals_batch(spark, tmp_path):
    from spindrift.streaming.clusters import event_stream, stream_clusters

    ticks = spark.range(400).select(F.timestamp_seconds(F.col("id") * 20).alias("ts"), (F.col("id") % 4).cast("int").alias("depth"), F.concat(F.lit("p"), F.col("id") % 3).alias("parent_url"))
    ticks.write.parquet(str(tmp_path / "in"))
    q = stream_clusters(event_stream(spark, str(tmp_path / "in"), "ts timestamp, depth int, parent_url string")).writeStream.format("memory").queryName("clusters").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["count"]) for r in spark.table("clusters").collect()}
    want = {(r["window_start"], r["count"]) for r in stats.temporal_clusters(ticks).collect()}
    assert got
    assert got <= want
