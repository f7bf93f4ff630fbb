"""What the graph operators hold and move, beside their results on small graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import graph


def pages(spark, parents):
    return spark.createDataFrame([(i, u, p, 0) for i, (u, p) in enumerate(parents)], "ordinal long, url string, parent_url string, depth int")


def edges(spark, pairs):
    return spark.createDataFrame([(f"https://e.com/{a}", f"https://e.com/{b}") for a, b in pairs], "src string, dst string")


def test_chains_join_once_a_level_and_match_a_walk(spark):
    rng = np.random.default_rng(3)
    for n in (2, 9, 30):
        parents = [(f"u{i}", None if rng.random() < 0.2 else f"u{rng.integers(0, n + 2)}") for i in range(n)]
        parent = {u: p for u, p in parents if p and p != u}
        for steps in (1, 3, 10):
            got = {r["url"]: r["chain"] for r in graph.parent_chains(pages(spark, parents), steps).collect()}
            for u, _ in parents:
                chain, at = [u], u
                while len(chain) <= steps and at in parent and parent[at] not in chain:
                    at = parent[at]
                    chain.insert(0, at)
                assert got[u] == chain
    plan = graph.parent_chains(pages(spark, [("a", None), ("b", "a"), ("c", "b")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # two levels; pages that have no parent left aren't joined again


def test_clustering_asks_along_the_fewer_targets(spark, monkeypatch):
    """Many pages link to two of few hubs with many targets: what is looked up goes by the pages' two links, not by the links to hubs."""
    asked, spread = [], graph.spread
    monkeypatch.setattr(graph, "spread", lambda df, rows, *by: asked.append(rows) or spread(df, rows, *by))
    pairs = [(f"p{i}", f"h{i % 2}") for i in range(100)] + [(f"p{i}", f"h{2 + i % 2}") for i in range(100)] + [(f"h{i}", f"t{j}") for i in range(4) for j in range(40)]
    graph.clustering(pages(spark, [(f"https://e.com/p{i}", None) for i in range(100)]), edges(spark, pairs)).collect()
    assert len(pairs) == max(asked[:-2]) and asked[-1] <= 2 * 200  # 100 ways from each hub over 40 targets would be 8,000


def test_clustering_against_its_definition(spark):
    rng = np.random.default_rng(8)
    for n, m in ((6, 18), (14, 70)):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))})
        out = {u: {b for a, b in pairs if a == u} for u in range(n)}
        got = {r["url"]: r["coefficient"] for r in graph.clustering(pages(spark, [(f"https://e.com/{i}", None) for i in range(n)]), edges(spark, pairs)).collect()}
        for u, near in out.items():
            k = len(near)
            want = sum(b in near for a in near for b in out[a] if a != b) / (k * (k - 1)) if k > 1 else 0.0
            assert abs(got[f"https://e.com/{u}"] - want) < 1e-12


def test_partitions_grow_with_the_links(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 10, raising=False)
    links = spark.range(200).select(F.concat(F.lit("https://e.com/"), F.col("id") % 150).alias("src"), F.concat(F.lit("/"), F.col("id") % 150 + 1).alias("link"))
    e = graph.edges(links)
    assert e.count() == 150 and e.rdd.getNumPartitions() == 20


def test_link_patterns_of_repeated_links(spark):
    site = pages(spark, [("https://e.com/a", None), ("https://e.com/b", None)]).withColumn("depth", F.col("ordinal").cast("int"))
    rows = [("a", "/b"), ("a", "/b"), ("a", "#x"), ("a", "/a"), ("b", "https://f.com/"), ("b", "/none"), ("c", "/a"), ("a", None), ("b", "rel")]
    links = spark.createDataFrame([(f"https://e.com/{a}", x) for a, x in rows], "src string, link string")
    assert tuple(graph.link_patterns(site, links).first()) == (2, 1, 1, 0, 2)


def test_links_inside_a_group_of_parents_are_no_ways(spark, monkeypatch):
    """Pages that parents connect are one node of the rounds, and links among them none of their ways."""
    sizes, staged = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: sizes.setdefault(label, []).append(out := staged(df, label)) or out)
    site = pages(spark, [("https://e.com/n0", None)] + [(f"https://e.com/n{i}", f"https://e.com/n{i // 2}") for i in range(1, 40)] + [("https://e.com/p", None), ("https://e.com/q", None)])
    links = [(f"n{i}", f"n{j}") for i in range(10) for j in range(10)] + [(f"n{i}", "p") for i in range(40)] + [("p", "n3"), ("q", "n1"), ("q", "missing")]
    got = {r["url"][14:]: r["component"] for r in graph.reach_components(site, edges(spark, links * 2)).collect()}
    assert got == {**{f"n{i}": 0 for i in range(40)}, "p": 0, "q": 41}
    assert sizes["ways"][0].count() == 3 and sizes["labels"][0].count() == 3


def test_groups_of_parents_against_search(spark):
    rng = np.random.default_rng(6)
    for n, m in ((5, 3), (30, 24), (60, 80)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b]
        got = {r["id"]: r["root"] for r in graph.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
        group = {x: {x} for p in pairs for x in p}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        assert all((got[a] == got[b]) == (group[a] is group[b]) for a in group for b in group) and set(got) == set(group)


def test_facts_by_location(spark):
    from spindrift.operators import domains

    site = spark.createDataFrame([("https://a.e.com/1", 1), ("https://a.e.com/1", 3), ("https://b.e.com/2", None), (None, 5), ("https://f.org/", 2)], "url string, depth int")
    rows = [("https://a.e.com/1", "https://a.e.com/x"), ("https://a.e.com/1", "https://A.e.com/y"), ("https://a.e.com/1", "http://u@c.e.com:80/"), ("https://b.e.com/2", "/z"), ("https://b.e.com/2", None), ("https://f.org/", "https://f.net")]
    links = spark.createDataFrame(rows, "src string, link string")
    got = {r["domain"]: tuple(r)[1:] for r in domains.facts(site, links).collect()}
    assert got == {"e.com": (2, 2, 2.0, 2, 1, 1 / 3), "f.org": (1, 1, 2.0, 0, 1, 1.0), "": (0, 1, 5.0, 0, 0, 0.0)}
    assert domains.link_targets(links.union(links)).count() == 4  # a row a pair of locations
    assert tuple(domains.cross_domain_totals(links).first())[0] == 2 and tuple(domains.cross_domain_totals(links.limit(0)).first()) == (0,) * 5


def test_links_are_resolved_once_and_without_python_where_none_need_it(spark, monkeypatch):
    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or staged(df, label))
    rows = [("a", "/b"), ("a", "/b"), ("a", "#x"), ("a", ""), ("a", None), ("a", "/a"), ("b", "https://f.com/"), ("b", "https://e.com/c"), ("c", "//e.com/d"), ("c", "//f.com/d")]
    plain = graph.edges(spark.createDataFrame([(f"https://e.com/{a}", x) for a, x in rows], "src string, link string"))
    want = {("a", "b"), ("a", "a"), ("b", "c"), ("c", "d")}
    ends = lambda df: sorted((r["src"][14:], r["dst"][14:]) for r in df.collect())
    assert ends(plain) == sorted(want) and written == ["links"]
    assert "Python" not in plain._jdf.queryExecution().optimizedPlan().toString()
    rows += [("x/y", "../z"), ("x/y", "w"), ("x/y", "/q/../r"), ("x/y", "mailto:m@e.com"), ("x/y", "w")]
    some = graph.edges(spark.createDataFrame([(f"https://e.com/{a}", x) for a, x in rows], "src string, link string"))
    assert ends(some) == sorted(want | {("x/y", "z"), ("x/y", "x/w"), ("x/y", "r")})


def test_all_ends_are_counted_in_one_aggregation(spark):
    rng = np.random.default_rng(4)
    parents = [(f"https://e.com/{i}", None if i % 4 == 0 else f"https://e.com/{rng.integers(0, 14)}") for i in range(12)]
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 16, (60, 2))})
    d = graph.full_degrees(pages(spark, parents), edges(spark, pairs))
    for r in d.collect():
        i = r["ordinal"]
        assert r["out_degree"] == sum(a == i for a, _ in pairs) and r["in_degree"] == sum(b == i for _, b in pairs)
        assert r["children"] == sum(p == r["url"] and u != p for u, p in parents)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
    hubs = graph.navigation_hubs(graph.degrees(pages(spark, parents), edges(spark, pairs)))
    assert "BroadcastHashJoin" not in hubs._jdf.queryExecution().executedPlan().toString()  # the pages, which seem small


def test_hits_against_their_definition(spark, monkeypatch):
    """Of crawled pages 0 to 7, uncrawled ones link and are linked too; links are joined once, and each maximum reads what is written."""
    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or staged(df, label))
    rng = np.random.default_rng(5)
    for m in (0, 3, 40):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (m, 2))})
        site, e = pages(spark, [(f"https://e.com/{i}", None) for i in range(8)]), edges(spark, pairs) if pairs else edges(spark, [(0, 0)]).limit(0)
        n = [sum(b == i for _, b in pairs) for i in range(8)]
        h = [sum(n[b] for a, b in pairs if a == i and b < 8) for i in range(12)]
        out = graph.hits(graph.degrees(site, e), e)
        got = {r["ordinal"]: (r["authority"], r["hub"]) for r in out.collect()}
        assert got == {i: (n[i] / max(n) if any(n) else 0.0, h[i] / max(h) if any(h) else 0.0) for i in range(8)}
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert written == ["degrees", "hubs"] * 3


def test_the_best_pages_are_found_before_they_are_numbered(spark, monkeypatch):
    from spindrift.plans import registry, views

    df = spark.createDataFrame([(f"u{i}",) for i in (5, 3, 11, 1, 20, 7)], "url string")
    want = {r["url"]: r["ordinal"] for r in graph.numbered(df, "url").collect()}
    found = df.where("url in ('u1', 'u20', 'u7')").select("url", F.col("url").alias("ordinal"))
    got = graph.ordinals(found.unionByName(found), df, "url")
    assert sorted((r["url"], r["ordinal"]) for r in got.collect()) == sorted((u, want[u]) for u in ("u1", "u20", "u7") * 2)
    assert got.schema["ordinal"].dataType.typeName() == "long"

    def refused(*_):
        raise AssertionError("all pages are numbered")

    monkeypatch.setattr(views, "numbered", refused)
    for name in ("nw_centrality", "nw_bottlenecks", "pm_navigation_hubs", "pm_importance", "pm_entry_points"):
        assert "ordinal" in registry.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_links_that_close_nothing_by_their_classes_arent_numbered(spark, monkeypatch):
    """Shops in which orders link to parts, parts to suppliers and customers to orders and back: no way of three closes, so no link is
    numbered. With links from orders to suppliers, ways close, and what they need is numbered."""
    sizes, staged = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: sizes.setdefault(label, []).append(out := staged(df, label)) or out)
    rng = np.random.default_rng(2)
    pairs = {(f"o/{i}", f"p/{rng.integers(0, 9)}") for i in range(60)} | {(f"p/{i}", f"s/{rng.integers(0, 5)}") for i in range(9) for _ in range(4)} | {(f"c/{i % 7}", f"o/{i}") for i in range(60)}
    pairs |= {(b, a) for a, b in pairs if a.startswith("c")}
    site = pages(spark, [(f"https://e.com/{u}", None) for u in sorted({u for p in pairs for u in p})])
    assert graph.clustering(site, edges(spark, sorted(pairs))).where("coefficient > 0").count() == 0
    assert sizes["numbers"][0].count() == 0
    pairs |= {(f"o/{i}", f"s/{rng.integers(0, 5)}") for i in range(60)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    got = {r["url"][14:]: r["coefficient"] for r in graph.clustering(site, edges(spark, sorted(pairs))).collect()}
    want = {u: sum(b in out[u] for a in out[u] for b in out.get(a, ()) if a != b) / (len(out[u]) * (len(out[u]) - 1)) if len(out.get(u, ())) > 1 else 0.0 for u in got}
    assert got == want and any(want.values())
    assert 0 < sizes["numbers"][1].count() == sum(not a.startswith("c") and not b.startswith("c") for a, b in pairs)


def test_parents_are_flattened_in_few_rounds(spark, monkeypatch):
    """Pages of a tree have numbers by depth, so that their least neighbours are their parents: one forest, flattened by halves, and no pairs left."""
    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or staged(df, label))
    rng = np.random.default_rng(9)
    up = {i: i // 5 for i in range(1, 300)}
    depth = {0: 0}
    for i, p in up.items():
        depth[i] = depth[p] + 1
    names = rng.permutation(300)
    rows = [(int(names[i]), f"https://e.com/{names[i]}", f"https://e.com/{names[up[i]]}" if i else None, depth[i]) for i in range(300)]
    site = spark.createDataFrame(rows, "ordinal long, url string, parent_url string, depth int").repartition(7, "url")
    got = graph.reach_components(site, edges(spark, [(0, 1)])).collect()
    assert len(got) == 300 and {r["component"] for r in got} == {0}
    assert written.count("pairs") == 1 and written.count("trees") <= 1 + 3  # four levels: two rounds and one that finds none


def test_site_metrics_dont_look_for_links_back(spark, monkeypatch):
    from spindrift.operators import tracking

    def refused(*_):
        raise AssertionError("links back are looked for")

    monkeypatch.setattr(graph, "network_metrics", refused)
    site = pages(spark, [("https://e.com/0", None), ("https://e.com/1", "https://e.com/0"), ("https://e.com/2", None), ("https://e.com/3", None)])
    got = tracking.network_result(site, edges(spark, [(0, 1), (1, 0), (3, 3)])).first().asDict()
    assert got == {"density": 3 / 12, "isolated_pages": 1, "largest_component_percentage": 50.0}


def test_links_back_are_those_of_a_join(spark):
    rng = np.random.default_rng(7)
    for n, m in ((3, 0), (4, 9), (12, 60)):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))})
        e = edges(spark, pairs) if pairs else edges(spark, [(0, 0)]).limit(0)
        assert graph.mutual(e).first()["mutual"] == sum((b, a) in set(pairs) for a, b in pairs)
