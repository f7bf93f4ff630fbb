"""Link graph and navigation paths: edges, degrees, reciprocity, clustering, hubs, components, parent chains."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.functions import urls as U


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). A folder of the driver's own serves where everything
    runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
    return f"{root.rstrip('/')}/spindrift/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: the cut of lineage in loops, and of plans that would repeat df."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition where tables grow beyond what spark.sql.shuffle.partitions was set for.
PART_ROWS = 1 << 19


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by the given columns, in as many partitions as so many rows need, so that a task holds no more of a larger table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)), *by)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with ordinal, its rows' places in that order from 0: ranges are sorted on their own and begin where those before end."""
    ranges = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = staged(ranges, "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    return ranges.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("ordinal"), *df.columns)


def ordinals(found: DataFrame, df: DataFrame, order: str) -> DataFrame:
    """found, the few best rows, whose ordinal is their value of df's order, with the ordinals that numbered() would give: how many rows of
    df are before each. df isn't sorted for them."""
    found = staged(found, "found")
    at = found.select(F.col("ordinal").alias("at")).distinct()
    before = df.select(order).join(F.broadcast(at), F.col(order) < F.col("at")).groupBy("at").agg(F.count("*").alias("before"))  # found: as many as were asked for
    named = [F.coalesce("before", F.lit(0)).alias(c) if c == "ordinal" else F.col(c) for c in found.columns]
    return found.join(F.broadcast(before), F.col("ordinal") == F.col("at"), "left").select(*named)


def placed(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """df with place, its rows' numbers from 0 in their group, in that order: ranges are sorted on their own, and a group's places in a range
    begin where those before end, so that no task holds a group."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, order)]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranges = staged(ranges.withColumn("part", F.shiftright("at", 33)), "placed")
    starts = ranges.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*group).orderBy("part")) - F.col("n")  # a row a group and range
    starts = starts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("part").alias("_part"), (before - F.col("first")).alias("shift"))
    same = F.col("part") == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranges.join(starts, same).select(*df.columns, (F.col("at") + F.col("shift")).alias("place"))


def resolved(links: DataFrame) -> DataFrame:
    """links(src, link, ...) with dst; only links that need merging with their source go through Python."""
    s, x = F.col("src"), F.col("link")
    plain = links.where(~U.is_relative(x)).withColumn("dst", U.resolve_plain(x, s))
    return plain.unionByName(links.where(U.is_relative(x)).withColumn("dst", U.merge_reference(x, s)))


def resolved_once(links: DataFrame) -> DataFrame:
    """(src, link, dst, own, fragment) of links that aren't empty, written, so that none is resolved twice: dst is the target and own whether it is
    known to be internal. Where a link needs merging with its source it is kept, and dst is null; fragment links have no target."""
    s, x = F.col("src"), F.col("link")
    some = links.where(x != "").select("src", "link", U.on_own_site(x, s).alias("own"))
    own = F.col("own")
    return staged(some.select("src", F.when(~own & U.is_relative(x), x).alias("link"), U.resolve_plain(x, s, own).alias("dst"), "own", x.startswith("#").alias("fragment")), "links")


def targets(once: DataFrame) -> DataFrame:
    """(src, dst, same, fragment) of resolved_once(): all links with their targets, and whether these are internal. Python is asked only if there are links for it."""
    s, x = F.col("src"), F.col("link")
    same = U.same_domain(s, F.col("dst"))
    # locations are looked for in the rows that need it; read on their own, these don't slow down the others
    own = once.where(x.isNull() & F.col("own")).select("src", "dst", F.lit(True).alias("same"), "fragment")
    plain = own.unionByName(once.where(x.isNull() & ~F.col("own")).select("src", "dst", same.alias("same"), "fragment"))
    merging = once.where(x.isNotNull())
    if merging.isEmpty():
        return plain
    return plain.unionByName(merging.select("src", U.merge_reference(x, s).alias("dst"), "fragment").select("src", "dst", same.alias("same"), "fragment"))


def internal(once: DataFrame) -> DataFrame:
    """(src, dst) of the internal links of resolved_once(), as often as they are there."""
    return targets(once).where("dst is not null and same").select("src", "dst")


def edges(links: DataFrame) -> DataFrame:
    """Distinct internal (src, dst): targets on the source's own network location, crawled or not, self-links included. Links of a page, which
    come from one record, meet in one task."""
    return edges_of(resolved_once(links))


def edges_of(once: DataFrame) -> DataFrame:
    """edges() of resolved_once()."""
    return spread(internal(once), once.count(), "src").distinct()


#: What the ends of a row (src, dst), and its parent, count as.
ENDS = {"src": "out_degree", "dst": "in_degree", "parent": "children"}


def ends(*tables: DataFrame) -> DataFrame:
    """(url, out_degree, in_degree, children) of all URLs in the tables' columns src, dst and parent, as far as these are there, in one aggregation."""
    rows, of = None, {}
    for t in tables:
        mine = [c for c in ENDS if c in t.columns]
        of.update((c, ENDS[c]) for c in mine)
        part = t.select(*mine).unpivot([], mine, "end", "url")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("url").agg(*[F.count_if(F.col("end") == c).alias(name) for c, name in of.items()])


def with_ends(site: DataFrame, counts: DataFrame) -> DataFrame:
    """site's rows with counts, 0 where there are none. A partition's counts are looked up, so that neither side is sorted, and pages, which
    look smaller than they are, never go to all executors."""
    more = [c for c in counts.columns if c != "url"]
    return site.join(counts.hint("shuffle_hash"), "url", "left").select(*site.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in more])


def degrees(site: DataFrame, e: DataFrame) -> DataFrame:
    """site's rows with out_degree and in_degree."""
    return with_ends(site, ends(e))


#: Classes of URLs: so few that all pairs of them may go to all executors.
CLASSES = 256


def url_class(url: Column) -> Column:
    """A number below CLASSES, the same for URLs whose paths have the same first segment on one site."""
    return F.pmod(F.xxhash64(F.substring_index(url, "/", 4)), F.lit(CLASSES)).cast("int")


def class_pairs(e: DataFrame) -> DataFrame:
    """(x, y): the classes that links go from and to, each pair once."""
    return staged(e.select(url_class(F.col("src")).alias("x"), url_class(F.col("dst")).alias("y")).distinct(), "classes")


def between(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links from a class x to a class y of the pairs, with what else these have."""
    pairs = F.broadcast(pairs)  # CLASSES times CLASSES rows at most
    return e.join(pairs, (url_class(e["src"]) == pairs["x"]) & (url_class(e["dst"]) == pairs["y"])).drop("x", "y")


def mutual(e: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One row: how many links there is one back for, links of a page to itself included. Only links between classes with links both ways
    are looked at, and the two of a pair of pages meet in one group."""
    pairs = class_pairs(e) if classes is None else classes
    both = between(e.select("src", "dst"), pairs.join(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi"))
    way = F.when(F.col("src") < F.col("dst"), 1).when(F.col("src") > F.col("dst"), -1).otherwise(0)
    met = spread(both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), way.alias("way")), e.count(), "a", "b").groupBy("a", "b")
    n = met.agg(F.count("*").alias("n"), (F.min("way") == -F.max("way")).alias("both"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("both"), F.col("n"))), F.lit(0)).alias("mutual"))


def density(edges: Column, nodes: Column) -> Column:
    return F.coalesce(F.try_divide(edges.cast("double"), nodes * (nodes - 1)), F.lit(0.0))


def network_metrics(site: DataFrame, e: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Of pages, whose degrees are counted unless they have them, and their edges."""
    d = site if {"out_degree", "in_degree"} <= set(site.columns) else degrees(site, e)
    one = d.agg(F.count("*").alias("nodes"), F.avg("out_degree").alias("avg_out_degree"), F.max("out_degree").alias("max_out_degree"), F.avg("in_degree").alias("avg_in_degree"), F.max("in_degree").alias("max_in_degree"))
    n_edges = e.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(mutual(e, classes)))  # one row each
    both = one.crossJoin(F.broadcast(n_edges))
    return both.select("*", density(F.col("edges"), F.col("nodes")).alias("density"), F.coalesce(F.try_divide(F.col("mutual").cast("double"), F.col("edges")), F.lit(0.0)).alias("reciprocity"))


def centrality(d: DataFrame, n: int = 20) -> DataFrame:
    """The n pages of each measure with the highest value, ties by first occurrence; betweenness prefers crawl depth 3."""
    d = staged(d, "degrees")  # read once a measure
    measures = {"degree": (F.col("in_degree") + F.col("out_degree")).cast("double"), "in_degree": F.col("in_degree").cast("double"), "out_degree": F.col("out_degree").cast("double"), "betweenness": 1 / (1 + F.abs(F.col("depth") - 3.0))}
    parts = [d.select(F.lit(k).alias("measure"), "url", v.alias("value"), "ordinal").orderBy(F.desc("value"), "ordinal").limit(n) for k, v in measures.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_number(e: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(url, id) of all that is linked or links, and the edges by id: (u, v, ...), of so many rows at most."""
    more = [c for c in e.columns if c not in ("src", "dst")]
    both = e.select(F.explode(F.array("src", "dst")).alias("url"))
    ids = staged(spread(both.groupBy("url").agg(F.count("*").alias("n")), rows, "url").select("url", F.monotonically_increasing_id().alias("id")), "ids")
    number = lambda c, name: spread(ids.select(F.col("url").alias(c), F.col("id").alias(name)), rows, c).hint("shuffle_hash")
    u = spread(e, rows, "src").join(number("src", "u"), "src").select("u", "dst", *more)
    return ids, staged(spread(u, rows, "dst").join(number("dst", "v"), "dst").select("u", "v", *more), "numbers")


def closing(pairs: DataFrame) -> DataFrame:
    """The pairs of classes whose links may be part of a closed way u -> a -> b with u -> b, which is one of classes too: as its first
    link (way), or as one of the two that have the same end (near)."""
    after, across = pairs.select(F.col("x").alias("y"), F.col("y").alias("z")), pairs.select("x", F.col("y").alias("z"))
    part = lambda a, b, first: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(first).alias("way"), F.lit(not first).alias("near"))
    found = pairs.join(after, "y").join(across, ["x", "z"]).select(F.explode(F.array(part("x", "y", True), part("y", "z", False), part("x", "z", False))).alias("p"))
    return staged(found.select("p.*").groupBy("x", "y").agg(F.max("way").alias("way"), F.max("near").alias("near")), "closing")


def closed_ways(e: DataFrame, classes: DataFrame) -> DataFrame:
    """(url, closed): the links among a page's targets, of pages with any. For each link u -> a the targets of that of the two with fewer
    are looked up among the other's, so hubs aren't multiplied out. Links that can't be part of it by their classes are left out first; URLs
    are numbers then, and targets with one link only, which close nothing, are left out too."""
    rows = e.count()
    ids, e = by_number(between(e, closing(classes)), rows)
    ends = e.where("near").select("u", "v")
    near = staged(ends.join(ends.groupBy("v").agg(F.count("*").alias("n")).where("n >= 2"), "v", "left_semi").select("u", "v"), "near")
    n = staged(near.groupBy("u").agg(F.count("*").alias("n")), "targets")
    ways = e.where("way and u <> v").join(n.withColumnRenamed("n", "nu"), "u").join(n.select(F.col("u").alias("v"), F.col("n").alias("nv")), "v")
    mine = F.col("nu") <= F.col("nv")
    ways = staged(ways.select(F.when(mine, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(mine, F.col("v")).otherwise(F.col("u")).alias("other"), mine.alias("mine"), F.least("nu", "nv").alias("n")), "ways")
    rows = ways.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # of what follows
    a, page = F.when(F.col("mine"), F.col("other")).otherwise(F.col("u")), F.when(F.col("mine"), F.col("u")).otherwise(F.col("other"))
    asked = ways.drop("n").join(near, "u").where(F.col("v") != a).select(page.alias("page"), F.col("other").alias("u"), "v")
    closed = spread(asked, rows, "u", "v").join(spread(near, rows, "u", "v"), ["u", "v"]).groupBy(F.col("page").alias("id")).agg(F.count("*").alias("closed"))
    return closed.join(ids, "id").select("url", "closed")


def clustering(site: DataFrame, e: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Local directed clustering of each page: links among its out-neighbours over k (k - 1). A page that links to itself is a neighbour of
    its own, for which its other links count."""
    e = e.select("src", "dst")
    k = e.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("k"), F.count_if(F.col("src") == F.col("dst")).alias("own")).where("k >= 2")
    closed = F.coalesce("closed", F.lit(0)) + F.when(F.col("own") > 0, F.col("k") - 1).otherwise(0)
    found = k.join(closed_ways(e, class_pairs(e) if classes is None else classes), "url", "left").select("url", (closed / (F.col("k") * (F.col("k") - 1))).alias("coefficient")).where("coefficient > 0")
    return site.select("ordinal", "url").join(found, "url", "left").select("ordinal", "url", F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"))


def link_patterns(site: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of self, fragment, external, sibling (same crawl depth) and cross-depth links; targets must be crawled for the last two.
    A link that a page repeats counts as often as it is there."""
    return patterns_of(site, resolved_once(links))


def patterns_of(site: DataFrame, once: DataFrame) -> DataFrame:
    """link_patterns() of resolved_once()."""
    rows = once.count()
    depth = spread(site.select(F.col("url").alias("src"), F.col("depth").alias("d1")), rows, "src").hint("shuffle_hash")
    target = spread(site.select(F.col("url").alias("dst"), F.col("depth").alias("d2")), rows, "dst").hint("shuffle_hash")
    # what a link is, before the joins: they carry flags in place of expressions over URLs
    kinds = targets(once).select("src", "dst", "fragment", "same", (F.col("dst") == F.col("src")).alias("itself"))
    r = spread(kinds, rows, "src").join(depth, "src").drop("src")
    # how often each target is linked from each depth; what has none isn't looked up
    r = spread(r, rows, "dst").groupBy("dst", "d1", "fragment", "same", "itself").agg(F.count("*").alias("n")).join(target, "dst", "left")
    own = F.coalesce(F.col("fragment") | F.col("itself"), F.lit(False))
    internal = F.col("same") & ~F.col("fragment") & ~own
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return r.agg(
        total(own).alias("self_links"), total(F.col("fragment")).alias("fragment_links"), total(F.col("dst").isNotNull() & ~F.col("same")).alias("external_links"),
        total(internal & (F.col("d1") == F.col("d2"))).alias("sibling_links"), total(internal & (F.col("d1") != F.col("d2"))).alias("cross_depth_links"),
    )


def linked_domains(links: DataFrame, n: int = 20) -> DataFrame:
    absolute = links.where(F.col("link").startswith("http"))
    return absolute.groupBy(U.netloc(F.col("link")).alias("domain")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "domain").limit(n)


def hits(d: DataFrame, e: DataFrame) -> DataFrame:
    """One round of hubs and authorities, each divided by its maximum (0 if that is 0). Hubs are summed over whole in-degrees, which the
    greatest one divides all alike; degrees and sums are written, as each is needed for its maximum too."""
    d = staged(d.select("ordinal", "url", "in_degree"), "degrees")
    linked = d.where("in_degree > 0").select(F.col("url").alias("dst"), "in_degree").hint("shuffle_hash")  # links aren't sorted
    h = staged(e.join(linked, "dst").groupBy(F.col("src").alias("url")).agg(F.sum("in_degree").alias("h")), "hubs")
    most = d.agg(F.max("in_degree").alias("most_in")).crossJoin(F.broadcast(h.agg(F.max("h").alias("most_h"))))  # one row
    share = lambda c, m: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(m)), F.lit(0.0))
    return d.join(h.hint("shuffle_hash"), "url", "left").crossJoin(F.broadcast(most)).select("ordinal", "url", share("in_degree", "most_in").alias("authority"), share("h", "most_h").alias("hub"))


def communities(pages: DataFrame, n: int = 20) -> DataFrame:
    """First path segments (root if none) with the most pages."""
    seg = F.coalesce(F.get(U.segments(U.part(pages, "path")), F.lit(0)), F.lit("root"))
    counts = pages.groupBy(seg.alias("community")).agg(F.count("*").alias("pages"))
    return counts.withColumn("percentage", F.col("pages") * 100.0 / F.sum("pages").over(W.partitionBy())).orderBy(F.desc("pages"), "community").limit(n)


def bottlenecks(d: DataFrame, n: int = 20) -> DataFrame:
    return d.where("in_degree = 1 and out_degree > 5").select("url", "out_degree", "ordinal").orderBy(F.desc("out_degree"), "ordinal").limit(n)


def parent_pairs(site: DataFrame) -> DataFrame:
    return site.where("parent_url is not null and parent_url <> '' and parent_url <> url").select("ordinal", F.col("parent_url").alias("parent"), F.col("url").alias("child"))


def child_counts(site: DataFrame) -> DataFrame:
    return parent_pairs(site).groupBy(F.col("parent").alias("url")).agg(F.count("*").alias("children"))


def full_degrees(site: DataFrame, e: DataFrame) -> DataFrame:
    """site's rows with out_degree, in_degree and children."""
    return with_ends(site, ends(e, parent_pairs(site).select("parent")))


def architecture(site: DataFrame, e: DataFrame) -> DataFrame:
    """Average children of parents, depth, orphans (no parent and no link to them), and the class that these make. Links are looked at unless pages have degrees."""
    kids = child_counts(site).agg(F.avg("children").alias("avg_children"), F.count("*").alias("parents"))
    if "in_degree" in site.columns:  # a row a URL
        has_parent = F.coalesce((F.col("parent_url") != "") & (F.col("parent_url") != F.col("url")), F.lit(False))
        orphans = site.agg(F.count_if(~has_parent & (F.col("in_degree") == 0)).alias("orphans"))
    else:
        pairs = parent_pairs(site)
        orphans = site.select("url").join(pairs.select(F.col("child").alias("url")), "url", "left_anti").join(e.select(F.col("dst").alias("url")), "url", "left_anti").agg(F.count("*").alias("orphans"))
    one = site.agg(F.count("*").alias("pages"), F.greatest(F.lit(0), F.max(F.coalesce("depth", U.path_depth(F.col("url"))))).alias("max_depth"))
    out = one.crossJoin(F.broadcast(kids)).crossJoin(F.broadcast(orphans)).withColumn("avg_children", F.coalesce("avg_children", F.lit(0.0)))  # one row each
    m, a = F.col("max_depth"), F.col("avg_children")
    return out.withColumn("type", F.when((m <= 3) & (a > 10), "flat").when((m > 5) & (a < 5), "deep").when(a > 7, "wide").otherwise("balanced"))


def entry_points(d: DataFrame, n: int = 20) -> DataFrame:
    return d.where("depth <= 2").select("url", "depth", "children", "out_degree", (F.col("children") + F.col("out_degree")).alias("score"), "ordinal").orderBy(F.desc("score"), "ordinal").limit(n)


def navigation_hubs(d: DataFrame, n: int = 20) -> DataFrame:
    return d.where("out_degree > 20 or in_degree > 10").select("url", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("score"), "ordinal").orderBy(F.desc("score"), "ordinal").limit(n)


def dead_ends(site: DataFrame, e: DataFrame) -> DataFrame:
    return site.select("ordinal", "url", "depth").join(e.select(F.col("src").alias("url")), "url", "left_anti")


def parent_chains(site: DataFrame, max_steps: int = 10) -> DataFrame:
    """(ordinal, url, depth, chain): parents up to the root first, at most max_steps of them, cycles cut. Levels are the pages with a parent, their
    parents that have one, and so on; chains are made from the highest level down, once for each parent and not for each page below it."""
    last = staged(parent_pairs(site).groupBy("child").agg(F.max_by("parent", "ordinal").alias("parent")), "parents")
    levels = [last]
    for _ in range(max_steps - 1):
        above = staged(last.join(levels[-1].select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "parents")
        if above.isEmpty():
            break
        levels.append(above)
    chains = levels.pop().select("child", F.array("parent", "child").alias("chain"))
    before = F.coalesce("before", F.array("parent"))
    at = F.array_position(before, F.col("child"))  # 0, or where the way up comes back to the page; what is above that is cut
    for level in reversed(levels):
        above = chains.select(F.col("child").alias("parent"), F.col("chain").alias("before"))
        chains = level.join(above, "parent", "left").select("child", F.concat(F.slice(before, (at + 1).cast("int"), F.size(before)), F.array("child")).alias("chain"))
    return site.select("ordinal", "url", "depth").join(chains.withColumnRenamed("child", "url"), "url", "left").select("ordinal", "url", "depth", F.coalesce("chain", F.array("url")).alias("chain"))


def simplified(url: Column) -> Column:
    """The last two parts of a URL's path, or root."""
    p = F.regexp_replace(F.when(url.rlike(U.SIMPLE), U.simple_path(url)).otherwise(U.path(url)), r"^/+|/+$", "")
    return F.when(p == "", "root").otherwise(F.substring_index(p, "/", -2))


def pathways(chains: DataFrame, n: int = 30) -> DataFrame:
    named = chains.where(F.size("chain") > 1).select(F.array_join(F.transform("chain", simplified), " -> ").alias("pathway"))
    return named.groupBy("pathway").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "pathway").limit(n)


def breadcrumbs(chains: DataFrame) -> DataFrame:
    return chains.agg(F.count("*").alias("pages"), F.count_if(F.size("chain") - 1 == F.col("depth")).alias("matching"), F.avg(F.size("chain")).alias("avg_length"))


def depth_flow(d: DataFrame) -> DataFrame:
    return d.groupBy("depth").agg(F.count("*").alias("pages"), F.avg("children").alias("avg_children"), F.max("children").alias("max_children"), F.sum("children").alias("total_children"), F.avg("out_degree").alias("avg_links"))


def page_importance(d: DataFrame, n: int = 30) -> DataFrame:
    capped = lambda c, m: F.least(F.col(c), F.lit(m))
    score = F.greatest(F.lit(0), 10 - F.col("depth")) * 10 + capped("out_degree", 50) * 2 + capped("in_degree", 20) * 5 + capped("children", 30) * 3
    return d.select("url", score.cast("long").alias("importance"), "ordinal").orderBy(F.desc("importance"), "ordinal").limit(n)


def roots(pairs: DataFrame) -> DataFrame:
    """(id, root) of all ids in pairs(a, b) of numbers, root being one of those that pairs connect both ways: a forest of a's least
    neighbours is flattened, pairs between its trees are left, and so on until there are none."""
    both = lambda p: p.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    known = None
    while True:
        tree = staged(both(pairs).groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "trees")
        while True:  # each id takes its root's root
            up = tree.select(F.col("id").alias("root"), F.col("root").alias("top")).where("root <> top")
            further = staged(tree.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "trees")
            tree = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        known = tree if known is None else staged(known.join(tree.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")
        number = lambda c: tree.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        pairs = staged(pairs.join(number("a"), "a").join(number("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct(), "pairs")
        if pairs.isEmpty():
            return known


def reach_components(site: DataFrame, e: DataFrame) -> DataFrame:
    """(url, component): the first crawled page, in input order, that reaches a page over parents both ways and links forward.
    Uncrawled parents are members, uncrawled link targets aren't. Pages that parents connect reach each other, so each such group is one
    node; URLs give way to groups once, and links between groups are left. Labels spread along these and jump to the label of the
    group they name, which reaches whatever that group reaches, until no one changes. Each round is one written table; only groups whose
    label changed in the round before send theirs on. e may repeat links."""
    pairs = parent_pairs(site)
    nodes = site.select("url", F.col("ordinal").alias("own"), "depth").unionByName(pairs.select(F.col("parent").alias("url"), F.lit(None).cast("long").alias("own"), F.lit(None).cast(site.schema["depth"].dataType).alias("depth")))
    nodes = nodes.groupBy("url").agg(F.min("own").alias("own"), F.min("depth").alias("depth"))
    # parents have lesser numbers than their children, as far as depths say so: roots() has few rounds then
    level = F.least(F.greatest(F.coalesce("depth", F.lit(0)).cast("long"), F.lit(0)), F.lit(1023))
    known = staged(nodes.select("url", "own", (F.shiftleft(level, 53) + F.monotonically_increasing_id()).alias("id")), "nodes")
    size = known.count()
    number = lambda c: spread(known.select(F.col("url").alias(c), F.col("id").alias(f"{c}_id")), size, c).hint("shuffle_hash")
    by_id = spread(pairs.select(F.col("parent").alias("a"), F.col("child").alias("b")), size, "a").join(number("a"), "a").select("a_id", "b")
    by_id = staged(spread(by_id, size, "b").join(number("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "parents")
    known = staged(known.join(roots(by_id), "id", "left").select("url", "own", F.coalesce("root", "id").alias("id")), "members")
    # links forward start at crawled pages or members and end at crawled pages
    rows = max(e.count(), size)
    group = lambda c, some: spread(some.select(F.col("url").alias(c), F.col("id").alias(f"{c}_id")), rows, c).hint("shuffle_hash")
    ways = spread(e.select("src", "dst"), rows, "src").join(group("src", known), "src").select(F.col("src_id").alias("a"), "dst")
    ways = spread(ways, rows, "dst").join(group("dst", known.where("own is not null")), "dst").select("a", F.col("dst_id").alias("b")).where("a <> b")
    ways = staged(ways.distinct(), "ways")
    own = known.groupBy("id").agg(F.min("own").alias("own"))
    now = staged(own.select("id", "own", F.col("own").alias("label"), F.lit(True).alias("fresh")), "labels")
    while True:
        told = now.where("fresh and label is not null").select(F.col("id").alias("a"), "label")
        near = ways.join(told, "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        spreading = now.join(near, "id", "left").select("id", "own", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = now.where("own is not null and label < own").select(F.col("own").alias("via"), F.col("label").alias("far"))
        new = spreading.join(jump, "via", "left").select("id", "own", "old", F.least("via", "far").alias("label"))
        now = staged(new.select("id", "own", "label", (~F.col("old").eqNullSafe(F.col("label"))).alias("fresh")), "labels")
        if now.where("fresh").isEmpty():
            return known.select("url", "id").join(now.select("id", F.col("label").alias("component")), "id").select("url", "component")
