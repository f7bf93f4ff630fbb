"""Hosts split by public-suffix rules that are given as a table: the longest rule prevails, exceptions before all others.

A rule is a run of labels ("co.uk"), may begin with a wildcard for one label ("*.ck"), or with an exclamation mark, and is then an exception
to a wildcard ("!www.ck": its suffix is "ck"). Comments (// ...) and blank lines of such lists are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import urls as U


def rule_table(rules: DataFrame) -> DataFrame:
    """(pattern, labels, exception) of rules(rule): a row a distinct pattern; one that is rule and exception is an exception."""
    text = F.lower(F.regexp_extract(F.trim("rule"), r"^\S*", 0))
    kept = rules.select(text.alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("//"))
    pattern = F.regexp_replace(F.regexp_replace("text", "^!", ""), r"^\.+|\.+$", "")
    return kept.select(pattern.alias("pattern"), F.col("text").startswith("!").alias("exception")).where("pattern <> ''").groupBy("pattern").agg(F.bool_or("exception").alias("exception")).select("pattern", F.size(F.split("pattern", r"\.")).alias("labels"), "exception")


def is_address(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains(":")


def split_hosts(hosts: DataFrame, rules: DataFrame, default_rule: bool = False) -> DataFrame:
    """(host, subdomain, domain, suffix, rule) of each distinct host of hosts(host). A host without a rule has no suffix and its last label as
    domain, or with default_rule its last label as suffix; addresses are domains. Each host looks up its own endings, so that rules are matched
    by equality, and the join goes by the rules' size."""
    table = rule_table(rules)
    most = table.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("most"))
    named = hosts.select("host").where("host is not null").distinct().withColumn("labels", F.split(F.regexp_replace(F.lower("host"), r"\.$", ""), r"\."))
    ending = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    depths = F.sequence(F.lit(1), F.least(F.size("labels"), F.greatest("most", F.lit(1))))
    wild = lambda k: F.when(k == 1, "*").otherwise(F.concat(F.lit("*."), ending(F.greatest(k - 1, F.lit(1)))))
    keys = F.flatten(F.transform(depths, lambda k: F.array(F.struct(k.alias("n"), ending(k).alias("pattern")), F.struct(k.alias("n"), wild(k).alias("pattern")))))
    asked = named.where(~is_address(F.col("host"))).crossJoin(F.broadcast(most)).select("host", F.inline(keys))  # most: one row
    best = asked.join(table, "pattern").groupBy("host").agg(F.max(F.struct("exception", "n", "pattern")).alias("best"))
    found = named.join(best, "host", "left")
    none = F.when(is_address(F.col("host")), 0).otherwise(F.lit(int(default_rule)))
    taken = F.coalesce(F.col("best.n") - F.col("best.exception").cast("int"), none)
    size, address = F.size("labels"), is_address(F.col("host"))
    part = lambda start, n: F.array_join(F.slice("labels", F.greatest(start, F.lit(1)), F.greatest(n, F.lit(0))), ".")
    rule = F.concat(F.when(F.col("best.exception"), "!").otherwise(""), F.col("best.pattern"))
    out = found.select("host", "labels", taken.alias("taken"), rule.alias("rule"))
    taken = F.col("taken")
    return out.select(
        "host", F.when(address, "").otherwise(part(F.lit(1), size - taken - 1)).alias("subdomain"),
        F.when(address, F.col("host")).when(size > taken, F.element_at("labels", F.when(size > taken, size - taken).otherwise(1))).otherwise("").alias("domain"),
        part(size - taken + 1, taken).alias("suffix"), "rule",
    )


def with_names(split: DataFrame) -> DataFrame:
    """split with registered_domain (domain.suffix) and fqdn (all parts), empty where domain or suffix is."""
    both = (F.col("domain") != "") & (F.col("suffix") != "")
    whole = F.array_join(F.filter(F.array("subdomain", "domain", "suffix"), lambda x: x != ""), ".")
    return split.withColumns({"registered_domain": F.when(both, F.concat_ws(".", "domain", "suffix")).otherwise(""), "fqdn": F.when(both, whole).otherwise("")})


def components(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """All parts of the URL of each of pages(ordinal, url): its plain parts, the host's by the rules, and those of its path and query. Hosts are
    split once each; a page without a host has empty parts."""
    u = F.col("url")
    rows = pages.select("ordinal", "url", F.coalesce(U.host(u), F.lit("")).alias("host"), U.scheme(u).alias("scheme"), U.netloc(u).alias("netloc"), F.explode(F.array(U.path(u))).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))
    names = with_names(split_hosts(rows.where("host <> ''"), rules)).drop("rule")
    last = F.element_at(F.split("path", "/"), -1)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    parameters = U.parameters(F.col("query"), keep_blank=False)
    keys = F.array_distinct(F.transform(parameters, lambda p: p["key"]))
    values = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(parameters, lambda p: p["key"] == k), lambda p: p["value"])))
    blank = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("subdomain", "domain", "suffix", "registered_domain", "fqdn")}
    return rows.join(names, "host", "left").select(
        "ordinal", "url", "scheme", "netloc", "host", "path", "query", "fragment", *blank.values(), segments.alias("path_segments"), F.size(segments).alias("path_depth"), values.alias("query_params"), F.size(keys).alias("query_param_count"),
        F.nullif(last, F.lit("")).alias("filename"), F.when(last.contains("."), F.element_at(F.split("path", r"\."), -1)).alias("file_extension"),
    )


def registered_domains(pages: DataFrame, rules: DataFrame, n: int = 20) -> DataFrame:
    """The n registered domains with most URLs: their suffix, the rule that made it, URLs and subdomains."""
    rows = pages.select("url", U.host(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.countDistinct("url").alias("urls"))
    names = with_names(split_hosts(rows, rules)).where("registered_domain <> ''")
    return rows.join(names, "host").groupBy("registered_domain", "suffix").agg(F.max("rule").alias("rule"), F.sum("urls").alias("urls"), F.countDistinct("subdomain").alias("subdomains")).orderBy(F.desc("urls"), "registered_domain").limit(n)
