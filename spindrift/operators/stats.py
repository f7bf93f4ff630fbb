"""Statistics of a crawl: summaries, distributions, correlations, outliers, health, time and content patterns, depths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from spindrift.functions import urls as U

FEATURES = ["depth", "path_length", "query_count", "link_count"]


def features(crawl: DataFrame, link_count: Column) -> DataFrame:
    """A row a record: crawl depth (0 if missing), path length, query parameters, fragment flag and number of links."""
    return crawl.select("ordinal", "url", F.coalesce(F.col("depth"), F.lit(0)).alias("depth"), F.char_length(U.path(F.col("url"))).alias("path_length"), U.query_param_count(F.col("url")).alias("query_count"), (U.fragment(F.col("url")) != "").alias("has_fragment"), F.coalesce(link_count, F.lit(0)).alias("link_count"))


def unpivoted(f: DataFrame) -> DataFrame:
    return f.unpivot(["ordinal"], FEATURES, "feature", "value").withColumn("value", F.col("value").cast("double"))


def summary(f: DataFrame) -> DataFrame:
    """Count, mean, median, population deviation, range and quartiles of each feature."""
    v = F.col("value")
    return unpivoted(f).groupBy("feature").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def histogram(f: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from least to greatest value (half a unit each way if they are equal), empty ones included."""
    spark = f.sparkSession
    x = F.col(column).cast("double")
    ends = f.agg(F.min(x).alias("low"), F.max(x).alias("high")).select(F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    at = F.least(F.floor((x - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)).cast("int")
    counts = f.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))  # ends: one row
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    edge = lambda k: F.col("low") + (F.col("high") - F.col("low")) * (F.col("bin") + k) / bins
    return every.join(counts, "bin", "left").select("bin", edge(0).alias("low"), edge(1).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def interpretation(r: Column) -> Column:
    a = F.abs(r)
    strength = F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong").otherwise("very strong")
    return F.concat(strength, F.lit(" "), F.when(r > 0, "positive").otherwise("negative"), F.lit(" correlation"))


def correlations(f: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's r of each pair from moments in one pass; null where a column is constant."""
    d = lambda c: F.col(c).cast("double")
    aggs = []
    for i, (a, b) in enumerate(pairs):
        cov = F.covar_pop(d(a), d(b))
        aggs.append(F.try_divide(cov, F.stddev_pop(d(a)) * F.stddev_pop(d(b))).alias(f"r{i}"))
    one = f.agg(F.count("*").alias("n"), *aggs)
    rows = [one.select(F.lit(f"{a}_{b}").alias("pair"), "n", F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("interpretation", interpretation(F.col("r")))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom: the beta tail of 1 - r squared."""
    return pd.Series([None if x is None or np.isnan(x) or k < 3 else incomplete_beta((k - 2) / 2, 0.5, max(0.0, 1 - x * x)) for x, k in zip(r, n, strict=True)])


def normal_quantile(p: float) -> float:
    """By Newton steps on the error function."""
    x = 0.0
    for _ in range(60):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) / max(math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300)
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-13:
            break
    return x


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, total = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(total)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a = m / math.sqrt(phi)
        a[-2], a[1] = before, -before
    else:
        a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = float(min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        y = -math.log(max(-2.273 + 0.459 * n - y, 1e-300))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def normality(f: DataFrame, column: str, most: int = 5000, least: int = 8) -> DataFrame:
    """Shapiro-Wilk on the first most values in input order, if there are more than least; is_normal if p > 0.05."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.concatenate([b["x"].to_numpy() for b in batches] or [np.zeros(0)])
        if len(values) > least:
            w, p = shapiro_wilk(values)
            yield pd.DataFrame({"n": [len(values)], "w": [w], "p": [p], "is_normal": [bool(p > 0.05)]})

    first = f.orderBy("ordinal").limit(most).select(F.col(column).cast("double").alias("x"))
    return first.coalesce(1).mapInPandas(test, "n long, w double, p double, is_normal boolean")


def fenced(long: DataFrame) -> DataFrame:
    """Unpivoted features with the fences at 1.5 quartile ranges of each, whether the value is beyond them, and its z-score."""
    v = F.col("value")
    ends = long.groupBy("feature").agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    iqr = F.col("q3") - F.col("q1")
    z = F.when(F.col("std") > 0, (v - F.col("mean")) / F.col("std")).otherwise(0.0)
    both = long.join(F.broadcast(ends), "feature").withColumns({"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr, "z_score": z})  # ends: a row a feature
    return both.withColumn("outside", (v < F.col("low_fence")) | (v > F.col("high_fence")))


def outliers(f: DataFrame) -> DataFrame:
    """For each feature the fences, and the values beyond 1.5 quartile ranges or 3 deviations, counted."""
    return fenced(unpivoted(f)).groupBy("feature").agg(F.count_if("outside").alias("iqr_outliers"), F.count_if(F.abs("z_score") > 3).alias("z_outliers"), F.min("low_fence").alias("low_fence"), F.max("high_fence").alias("high_fence"))


def outlier_examples(f: DataFrame, n: int = 10) -> DataFrame:
    """The first values in input order beyond each feature's fences."""
    long = f.unpivot(["ordinal", "url"], FEATURES, "feature", "value").withColumn("value", F.col("value").cast("double"))
    rank = F.row_number().over(W.partitionBy("feature").orderBy("ordinal"))
    return fenced(long).where("outside").withColumn("rank", rank).where(F.col("rank") <= n).select("feature", "ordinal", "url", "value", "z_score")


def depth_patterns(f: DataFrame) -> DataFrame:
    frag, q = F.col("has_fragment").cast("int"), (F.col("query_count") > 0).cast("int")
    return f.groupBy("depth").agg(F.count("*").alias("count"), F.avg("path_length").alias("avg_path_length"), F.avg("link_count").alias("avg_links"), F.sum(frag).alias("has_fragment"), F.sum(q).alias("has_query"), (F.avg(frag) * 100).alias("fragment_pct"), (F.avg(q) * 100).alias("query_pct"))


def depth_samples(crawl: DataFrame, n: int = 5) -> DataFrame:
    """(depth, place, url): the first n URLs of each crawl depth, or path depth where that is missing; records without a URL are left out."""
    depth = F.coalesce(F.col("depth").cast("long"), U.path_depth(F.col("url")).cast("long"))
    rows = crawl.where("coalesce(url, '') <> ''").select(depth.alias("depth"), "ordinal", "url")
    # the filter on the number keeps n rows a depth and task before the shuffle
    return rows.withColumn("place", F.row_number().over(W.partitionBy("depth").orderBy("ordinal"))).where(F.col("place") <= n).select("depth", "place", "url")


def link_hubs(f: DataFrame) -> DataFrame:
    """Pages without links, and pages with at least the 95th percentile of links."""
    p = f.agg(F.percentile("link_count", 0.95).alias("p95"))
    return f.crossJoin(F.broadcast(p)).agg(F.count_if(F.col("link_count") == 0).alias("dead_ends"), F.count_if(F.col("link_count") >= F.col("p95")).alias("hubs"), F.max("p95").alias("p95"))  # p: one row


def hub_examples(f: DataFrame, n: int = 10) -> DataFrame:
    """The first pages in input order with at least the 95th percentile of links."""
    p = f.agg(F.percentile("link_count", 0.95).alias("p95"))
    return f.crossJoin(F.broadcast(p)).where(F.col("link_count") >= F.col("p95")).select("ordinal", "url", "link_count").orderBy("ordinal").limit(n)  # p: one row


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def depth_health(crawl: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    inside = U.path_depth(F.col("url")).between(low, high)
    return crawl.agg(F.count_if(inside).alias("optimal"), F.count("*").alias("total"), (F.avg(F.when(inside, 100.0).otherwise(0.0))).alias("depth_score"))


def url_health(crawl: DataFrame) -> DataFrame:
    """Scores of URL length (50 to 100), path depth (2 to 4) and fragments, weighted 0.3, 0.4 and 0.3, with a grade."""
    u = F.col("url")
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    one = crawl.agg(share(F.char_length(u).between(50, 100)).alias("url_length_score"), share(U.path_depth(u).between(2, 4)).alias("depth_score"), F.greatest(F.lit(0.0), 100 - share(U.fragment(u) != "")).alias("fragment_score"))
    one = one.withColumn("overall_health", F.col("url_length_score") * 0.3 + F.col("depth_score") * 0.4 + F.col("fragment_score") * 0.3)
    return one.withColumn("health_grade", grade(F.col("overall_health")))


def timeline(ticks: DataFrame, slots: int = 10) -> DataFrame:
    """Counts of equal time slots from the first to the last time; the last time itself is slot number slots."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ends = ticks.agg(F.min(t).alias("low"), F.max(t).alias("high"))
    slot = F.floor(F.try_divide(t - F.col("low"), (F.col("high") - F.col("low")) / slots)).cast("int")
    return ticks.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(slot, F.lit(0)).alias("slot")).agg(F.count("*").alias("count"))  # ends: one row


def timeline_span(ticks: DataFrame) -> DataFrame:
    """First and last time in epoch seconds, the span between, and discoveries a second."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    one = ticks.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(t).alias("n"))
    span = F.col("last") - F.col("first")
    return one.select("first", "last", "n", span.alias("span"), F.coalesce(F.try_divide("n", span), F.lit(0.0)).alias("rate"))


def status_codes(crawl: DataFrame) -> DataFrame:
    return crawl.where("status_code > 0").groupBy("status_code").agg(F.count("*").alias("count"))


def mime_types(crawl: DataFrame, n: int = 10) -> DataFrame:
    mime = F.trim(F.substring_index("content_type", ";", 1))
    return crawl.where("content_type is not null").groupBy(mime.alias("mime")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "mime").limit(n)


def success(crawl: DataFrame) -> DataFrame:
    code = F.col("status_code")
    return crawl.agg(F.count_if(code > 0).alias("with_status"), F.count_if(code == 200).alias("ok"), (F.try_divide(F.count_if(code == 200), F.count_if(code > 0)) * 100).alias("success_rate"))


def depth_distribution(crawl: DataFrame) -> DataFrame:
    """Number of URLs of each path depth, and how deep that is."""
    d = U.path_depth(F.col("url"))
    return crawl.groupBy(d.alias("path_depth")).agg(F.count("*").alias("count")).withColumn("level", depth_level(F.col("path_depth")))


def depth_level(d: Column) -> Column:
    return F.when(d <= 1, "shallow").when(d.isin(2, 3, 4), "medium").when(d.isin(5, 6, 7), "deep").otherwise("very_deep")


def upper_median(df: DataFrame, value: Column) -> DataFrame:
    """Average, the upper of the middle values, least and greatest of a distribution; ranks run over its distinct values."""
    counts = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))  # distinct depths are few
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("v"))).withColumn("total", F.sum("n").over(W.partitionBy()))
    return upto.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg_depth"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("v"))).alias("median_depth"), F.min("v").alias("min_depth"), F.max("v").alias("max_depth"))


def max_depth(crawl: DataFrame) -> DataFrame:
    return crawl.agg(F.greatest(F.lit(0), F.max(F.coalesce("depth", U.path_depth(F.col("url"))))).alias("max_depth"))


def temporal_clusters(ticks: DataFrame, width: str = "5 minutes", least: int = 10) -> DataFrame:
    """Time windows with at least so many records: count, average depth and distinct parents. Works on streams too."""
    return ticks.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("count"), F.avg("depth").alias("avg_depth"), F.approx_count_distinct("parent_url").alias("parents") if ticks.isStreaming else F.countDistinct("parent_url").alias("parents")).where(F.col("count") >= least).select(F.col("w.start").alias("window_start"), "count", "avg_depth", "parents")


def significant_clusters(ticks: DataFrame, width: str = "5 minutes", least: int = 10, n: int = 20) -> DataFrame:
    """The n windows with most records of those with at least so many."""
    return temporal_clusters(ticks, width, least).orderBy(F.desc("count"), "window_start").limit(n)


def parent_child(pages: DataFrame) -> DataFrame:
    kids = pages.where("parent_url is not null and parent_url <> ''").groupBy("parent_url").agg(F.countDistinct("url").alias("children"))
    return kids.agg(F.count("*").alias("parents"), F.avg("children").alias("avg_children"), F.max("children").alias("max_children"))
