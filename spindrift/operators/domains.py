"""Domains and subdomains: overview, purposes, cross-domain links, clusters, dependencies, TLDs, authority, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.functions import urls as U
from spindrift.operators.graph import placed

# Keywords of subdomain purposes and of services, in the order in which they are tried.
PURPOSES = {
    "api": ["api", "rest", "graphql", "gateway"],
    "content": ["www", "blog", "news", "content", "cms"],
    "media": ["cdn", "static", "media", "images", "assets"],
    "user": ["user", "account", "profile", "my", "portal"],
    "admin": ["admin", "manage", "control", "dashboard"],
    "staging": ["staging", "dev", "test", "qa", "beta"],
    "mobile": ["m", "mobile", "app"],
    "regional": ["us", "eu", "asia", "uk", "ca"],
    "service": ["mail", "smtp", "ftp", "auth", "sso"],
}
SERVICES = {
    "cdn": ["cloudflare", "akamai", "fastly", "cloudfront"],
    "analytics": ["google-analytics", "ga", "analytics", "mixpanel"],
    "social": ["facebook", "twitter", "linkedin", "instagram", "youtube"],
    "ads": ["doubleclick", "adsense", "adwords", "googlesyndication"],
    "auth": ["okta", "auth0", "azure", "sso"],
    "payments": ["stripe", "paypal", "square"],
    "maps": ["maps.google", "mapbox"],
    "fonts": ["fonts.google", "typekit"],
    "video": ["youtube", "vimeo", "wistia"],
}


def first_match(text: Column, groups: dict[str, list[str]], otherwise: Column) -> Column:
    out = None
    for name, words in groups.items():
        hit = text.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def named(pages: DataFrame) -> DataFrame:
    """pages(url, ...) with netloc, domain (name.suffix), subdomain (root if none), full (subdomain.domain) and suffix, where they don't have them yet."""
    if {"netloc", "domain", "subdomain", "full", "suffix", "name"} <= set(pages.columns):
        return pages
    loc = U.part(pages, "netloc")
    x = U.labels(loc)
    domain = F.when(x["suffix"] != "", F.concat_ws(".", x["domain"], x["suffix"])).otherwise(x["domain"])
    sub = F.when(x["subdomain"] == "", "root").otherwise(x["subdomain"])
    return pages.select("*", loc.alias("netloc"), domain.alias("domain"), sub.alias("subdomain"), F.concat_ws(".", sub, domain).alias("full"), x["suffix"].alias("suffix"), x["domain"].alias("name"))


def total(test: Column | None = None) -> Column:
    """The number of links of link_targets() that pass."""
    return F.coalesce(F.sum("n" if test is None else F.when(test, F.col("n"))), F.lit(0))


def link_targets(links: DataFrame) -> DataFrame:
    """Absolute links: (source domain, target network location, internal, suffix and name of both sides), a row and their number for each
    pair of locations. What this has made of links stays as it is."""
    if {"target", "internal", "n"} <= set(links.columns):
        return links
    absolute = links.where(F.col("link").startswith("http")).groupBy(U.location(F.col("src")).alias("from"), U.location(F.col("link")).alias("to")).agg(F.count("*").alias("n"))
    a, b = U.labels(F.col("from")), U.labels(F.col("to"))
    whole = lambda x: F.when(x["suffix"] != "", F.concat_ws(".", x["domain"], x["suffix"])).otherwise(x["domain"])
    return absolute.select(
        whole(a).alias("domain"), F.lower("to").alias("target"), whole(b).alias("target_domain"), (F.lower("from") == F.lower("to")).alias("internal"),
        (a["suffix"] == b["suffix"]).alias("same_tld"), (a["domain"] == b["domain"]).alias("same_name"), "n",
    )


def facts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per domain: pages, subdomains, average depth, internal and external absolute links."""
    # by URL, then by subdomain: each is counted where it is a row
    once = named(pages).groupBy("domain", "subdomain", "url").agg(F.sum("depth").alias("depths"), F.count("depth").alias("n"))
    subs = once.groupBy("domain", "subdomain").agg(F.count("url").alias("urls"), F.sum("depths").alias("depths"), F.sum("n").alias("n"))
    d = subs.groupBy("domain").agg(F.sum("urls").alias("urls"), F.count("subdomain").alias("subdomains"), F.try_divide(F.sum("depths").cast("double"), F.sum("n")).alias("avg_depth"))
    n = link_targets(links).groupBy("domain").agg(total(F.col("internal")).alias("internal_links"), total(~F.col("internal")).alias("external_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = d.join(n, "domain", "left").select("domain", "urls", "subdomains", "avg_depth", zero("internal_links"), zero("external_links"))
    return out.withColumn("external_ratio", F.coalesce(F.try_divide(F.col("external_links").cast("double"), F.col("internal_links") + F.col("external_links")), F.lit(0.0)))


def overview(pages: DataFrame, n: int = 20) -> DataFrame:
    return named(pages).groupBy("domain").agg(F.count("*").alias("urls"), F.countDistinct("subdomain").alias("subdomains"), F.avg("depth").alias("avg_depth"), F.countDistinct(U.part(pages, "scheme")).alias("schemes")).orderBy(F.desc("urls"), "domain").limit(n)


def top_segments(pages: DataFrame, n: int = 10) -> DataFrame:
    """Per domain its most frequent first path segments."""
    seg = F.split_part(F.regexp_replace(U.part(pages, "path"), r"^/+|/+$", ""), F.lit("/"), F.lit(1))
    counts = named(pages).where(seg != "").groupBy("domain", seg.alias("segment")).agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("count"), "segment"))).where(F.col("rank") <= n)


def subdomains(pages: DataFrame) -> DataFrame:
    """Each full subdomain with its pages, purpose by its first label, and whether it has several levels."""
    label = F.lower(F.split_part("full", F.lit("."), F.lit(1)))
    purpose = first_match(label, PURPOSES, F.when(label != "root", "other"))
    return named(pages).groupBy("full").agg(F.countDistinct("url").alias("urls")).select("full", "urls", purpose.alias("purpose"), (F.size(F.split("full", r"\.")) > 2).alias("multi_level"))


def cross_domain(links: DataFrame, n: int = 20) -> DataFrame:
    """Pairs of source and target domain of external absolute links, with how their TLDs relate."""
    x = link_targets(links).where(~F.col("internal"))
    kind = F.when(F.col("same_tld"), "same_tld").when(F.col("same_name"), "same_org_different_tld").otherwise("different_tld")
    return x.groupBy("domain", "target", kind.alias("relation")).agg(total().alias("links")).orderBy(F.desc("links"), "domain", "target").limit(n)


def clusters(f: DataFrame) -> DataFrame:
    n, s, r = F.col("urls"), F.col("subdomains"), F.col("external_ratio")
    return f.select("domain", F.when(n < 10, "tiny").when(n < 100, "small").when(n < 1000, "medium").otherwise("large").alias("size"), F.when(s == 1, "simple").when(s < 5, "moderate").otherwise("complex").alias("complexity"), F.when(r < 0.2, "mostly_internal").when(r < 0.5, "balanced").otherwise("mostly_external").alias("link_balance"))


def external_dependencies(links: DataFrame) -> DataFrame:
    """Targets of external links: service category, total links and criticality."""
    x = link_targets(links).where(~F.col("internal")).groupBy("target").agg(total().alias("links"))
    return x.select("target", first_match(F.lower("target"), SERVICES, F.lit("other")).alias("category"), "links", F.when(F.col("links") > 100, "high").when(F.col("links") > 20, "medium").otherwise("low").alias("criticality"))


def tlds(pages: DataFrame, n: int = 20) -> DataFrame:
    t = F.col("suffix")
    kind = F.when(t.isin("com", "net", "org"), "generic").when(F.char_length(t) == 2, "country_code").when(t.isin("edu", "gov", "mil"), "sponsored").otherwise("new_gtld")
    return named(pages).select("url", "suffix").distinct().where(t != "").groupBy("suffix").agg(F.count("*").alias("urls")).withColumn("kind", kind).orderBy(F.desc("urls"), "suffix").limit(n)


def authority(f: DataFrame) -> DataFrame:
    score = F.least(F.col("urls") / 10, F.lit(50.0)) + F.least(F.try_divide(F.col("internal_links").cast("double"), F.col("urls")) * 10, F.lit(30.0)) + F.least(F.col("subdomains") * 2, F.lit(10)) + F.when(F.col("avg_depth").between(2, 4), 10).otherwise(0)
    return f.select("domain", F.least(score, F.lit(100.0)).alias("authority"), "urls", "internal_links", "subdomains")


def hierarchy(pages: DataFrame) -> DataFrame:
    parts = F.split("full", r"\.")
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(1))), ".")).otherwise("root")
    return named(pages).where(F.size(parts) >= 2).groupBy(F.array_join(F.slice(parts, -2, 2), ".").alias("domain"), rest.alias("subdomain")).agg(F.countDistinct("url").alias("urls"))


def hierarchy_urls(pages: DataFrame, size: int = 1000) -> DataFrame:
    """(domain, subdomain, block, urls): the URLs of each place of the hierarchy in order, in numbered blocks of at most size."""
    parts = F.split("full", r"\.")
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(1))), ".")).otherwise("root")
    once = named(pages).where(F.size(parts) >= 2).select(F.array_join(F.slice(parts, -2, 2), ".").alias("domain"), rest.alias("subdomain"), "url").distinct()
    numbered = placed(once, ["domain", "subdomain"], "url").withColumn("block", F.expr(f"place div {size}"))
    return numbered.groupBy("domain", "subdomain", "block").agg(F.sort_array(F.collect_list("url")).alias("urls"))  # size URLs at most


def cross_domain_totals(links: DataFrame) -> DataFrame:
    """One row: external absolute links, their distinct targets, and how their TLDs relate; links between TLDs of one name are counted there too."""
    x = link_targets(links).where(~F.col("internal"))
    other = ~F.col("same_tld")
    return x.agg(total().alias("total_cross_domain_links"), F.countDistinct("target").alias("unique_external_domains"), total(F.col("same_tld")).alias("same_tld"), total(other).alias("different_tld"), total(other & F.col("same_name")).alias("same_org_different_tld"))


def external_targets(links: DataFrame, n: int = 20) -> DataFrame:
    """The n targets with most external links."""
    return link_targets(links).where(~F.col("internal")).groupBy("target").agg(total().alias("links")).orderBy(F.desc("links"), "target").limit(n)


def dependencies_by_source(links: DataFrame) -> DataFrame:
    """(domain, target, category, links): what each domain depends on, by service category."""
    x = link_targets(links).where(~F.col("internal")).groupBy("domain", "target").agg(total().alias("links"))
    return x.select("domain", "target", first_match(F.lower("target"), SERVICES, F.lit("other")).alias("category"), "links")


def critical_dependencies(links: DataFrame, n: int = 10) -> DataFrame:
    return external_targets(links, n).withColumn("criticality", F.when(F.col("links") > 100, "high").when(F.col("links") > 20, "medium").otherwise("low"))


def health_issues(f: DataFrame) -> DataFrame:
    """(domain, issue) of each domain that has one."""
    dense = F.coalesce(F.try_divide(F.col("internal_links").cast("double"), F.col("urls")), F.lit(0.0))
    found = {"High external dependency ratio": F.col("external_ratio") > 0.7, "Low internal linking": dense < 1, "High subdomain complexity": F.col("subdomains") > 10}
    return f.select("domain", F.explode(F.array_compact(F.array(*[F.when(test, issue) for issue, test in found.items()]))).alias("issue"))


def health(f: DataFrame) -> DataFrame:
    dense = F.try_divide(F.col("internal_links").cast("double"), F.col("urls"))
    bad = [(F.col("external_ratio") > 0.7, 20), (dense < 1, 15), (F.col("subdomains") > 10, 10)]
    score = F.lit(100)
    issues = F.lit(0)
    for test, penalty in bad:
        score = score - F.when(test, penalty).otherwise(0)
        issues = issues + test.cast("int")
    return f.select("domain", F.greatest(score, F.lit(0)).alias("health_score"), "urls", issues.alias("issues"))
