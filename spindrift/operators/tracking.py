"""Metric snapshots: comparison, trends and changes from run to run. A snapshot is (snapshot_id, ts, metrics map)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.operators import graph, normalize, quality

# Metrics that shall rise and metrics that shall fall.
RISE = ["data_quality_score", "extraction_success_rate", "storage_efficiency", "depth_efficiency", "largest_component_percent", "pages_with_title", "pages_with_links", "urls_per_second"]
FALL = ["error_rate", "duplication_rate", "isolated_components", "avg_response_time_ms"]

# Metrics with a trend in the report of the last two snapshots, and the metrics of a snapshot.
TRACKED = ["data_quality_score", "duplication_rate", "urls_per_second", "error_rate", "storage_efficiency"]
KEY_METRICS = [
    "total_urls", "unique_urls", "total_links", "crawl_duration_seconds", "urls_per_second", "avg_response_time_ms", "data_quality_score", "extraction_success_rate", "error_rate", "duplication_rate", "storage_efficiency",
    "depth_efficiency", "max_depth_reached", "avg_depth", "unique_domains", "graph_density", "isolated_components", "largest_component_percent", "pages_with_title", "pages_with_links", "avg_links_per_page",
]
# The result and column that each metric is taken from; a depth efficiency falls by 10 a level.
SOURCES = {
    "total_urls": ("statistical", "total_urls"), "avg_depth": ("statistical", "depth_mean"), "max_depth_reached": ("statistical", "depth_max"), "avg_links_per_page": ("statistical", "outbound_links_mean"),
    "data_quality_score": ("data_quality", "overall_quality_score"), "duplication_rate": ("data_quality", "inflation_rate_percent"), "storage_efficiency": ("data_quality", "efficiency_score"),
    "graph_density": ("network", "density"), "isolated_components": ("network", "isolated_pages"), "largest_component_percent": ("network", "largest_component_percentage"), "depth_efficiency": ("pathway", "max_depth"),
}


def points(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot_id", "ts", F.explode("metrics").alias("metric", "value"))


def better(metric: Column, delta: Column) -> Column:
    return F.when(metric.isin(RISE), delta > 1).when(metric.isin(FALL), delta < -1).otherwise(F.lit(False))


def worse(metric: Column, delta: Column) -> Column:
    return F.when(metric.isin(RISE), delta < -1).when(metric.isin(FALL), delta > 1).otherwise(F.lit(False))


def compare(p: DataFrame, baseline: str, current: str) -> DataFrame:
    a = p.where(F.col("snapshot_id") == baseline).select("metric", F.col("value").alias("baseline"))
    b = p.where(F.col("snapshot_id") == current).select("metric", F.col("value").alias("current"))
    d = F.col("current") - F.col("baseline")
    return a.join(b, "metric").select("metric", "baseline", "current", d.alias("delta"), F.coalesce(F.try_divide(d * 100, F.col("baseline")), F.lit(0.0)).alias("percent_change"), F.when(better(F.col("metric"), d), "improvement").when(worse(F.col("metric"), d), "regression").otherwise("none").alias("verdict"))


def trends(p: DataFrame, last: int = 10) -> DataFrame:
    """First against last of the latest snapshots, by name, with 5 % as stable. A fall is labelled as the tracked tool labels
    it: worsening where it is an improvement."""
    rank = F.row_number().over(W.partitionBy("metric").orderBy(F.desc("snapshot_id")))
    recent = p.withColumn("rank", rank).where(F.col("rank") <= last)
    one = recent.groupBy("metric").agg(F.count("*").alias("points"), F.min_by("value", "snapshot_id").alias("first_value"), F.max_by("value", "snapshot_id").alias("last_value"))
    a, b = F.col("first_value"), F.col("last_value")
    good = better(F.col("metric"), b - a)
    trend = F.when(F.col("points") < 2, "unknown").when(b > a * 1.05, F.when(good, "improving").otherwise("worsening")).when(b < a * 0.95, F.when(good, "worsening").otherwise("improving")).otherwise("stable")
    return one.withColumn("trend", trend)


def changes(p: DataFrame) -> DataFrame:
    """Each point with its change in percent from the point before; under 1 % is stable."""
    before = F.lag("value").over(W.partitionBy("metric").orderBy("ts", "snapshot_id"))
    pct = F.try_divide((F.col("value") - before) * 100, F.abs(before))
    return p.select("metric", "snapshot_id", "value", F.coalesce(pct, F.lit(0.0)).alias("change_pct"), (F.abs(F.coalesce(pct, F.lit(0.0))) < 1).alias("stable"))


def rollup(snapshots: DataFrame) -> DataFrame:
    """Sums over all snapshots of each metric, with the range."""
    return points(snapshots).groupBy("metric").agg(F.count("*").alias("snapshots"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def last_two(p: DataFrame, last: int = 5) -> DataFrame:
    """The latest snapshot against the one before, by name, with the trends of TRACKED metrics over the last snapshots; no rows
    if there are fewer than two."""
    ids = p.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(2).agg(F.min("snapshot_id").alias("a"), F.max("snapshot_id").alias("b"))
    two = p.crossJoin(F.broadcast(ids)).where(F.col("a") < F.col("b"))  # ids: one row
    now = two.groupBy("metric").agg(F.max(F.when(F.col("snapshot_id") == F.col("a"), F.col("value"))).alias("baseline"), F.max(F.when(F.col("snapshot_id") == F.col("b"), F.col("value"))).alias("current")).where("baseline is not null and current is not null")
    d = F.col("current") - F.col("baseline")
    trend = trends(p.where(F.col("metric").isin(TRACKED)), last).select("metric", "trend")
    return now.join(trend, "metric", "left").select("metric", "baseline", "current", d.alias("delta"), F.coalesce(F.try_divide(d * 100, F.col("baseline")), F.lit(0.0)).alias("percent_change"), F.when(better(F.col("metric"), d), "improvement").when(worse(F.col("metric"), d), "regression").otherwise("none").alias("verdict"), "trend")


def network_result(site: DataFrame, e: DataFrame) -> DataFrame:
    """One row of what the key metrics take of the link graph: density, pages without any link, and the largest component's share of all pages."""
    linked = graph.degrees(site, e).agg(F.count("*").alias("nodes"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated_pages"))
    links = e.agg(F.count("*").alias("edges"))
    sizes = graph.reach_components(site, e).groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.coalesce(F.max("n") * 100.0 / F.sum("n"), F.lit(0.0)).alias("largest_component_percentage"))
    both = linked.crossJoin(F.broadcast(links)).select(graph.density(F.col("edges"), F.col("nodes")).alias("density"), "isolated_pages")
    return both.crossJoin(F.broadcast(largest))  # one row each


def quality_result(crawl: DataFrame) -> DataFrame:
    """One row of what the key metrics take of the records: the quick grade's score, and what repeated URLs add and leave, in percent."""
    graded = quality.quick_grade(crawl).select(F.col("score").alias("overall_quality_score"))
    again = normalize.reduction(normalize.merged(crawl)).select(F.col("reduction_pct").alias("inflation_rate_percent"), (100 - F.col("reduction_pct")).alias("efficiency_score"))
    return graded.crossJoin(F.broadcast(again))  # one row each


def key_metrics(results: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of KEY_METRICS from analyzers' results, a row each; what no result has is 0."""
    got = next(iter(results.values())).sparkSession.range(1).select()
    for name, df in results.items():
        wanted = [F.col(column).cast("double").alias(metric) for metric, (source, column) in SOURCES.items() if source == name and column in df.columns]
        got = got.crossJoin(F.broadcast(df.select(*wanted)))  # one row each
    if "depth_efficiency" in got.columns:
        got = got.withColumn("depth_efficiency", 100 - F.least(F.col("depth_efficiency") * 10, F.lit(100.0)))
    whole = got.select(*[F.coalesce(F.col(m), F.lit(0.0)).alias(m) if m in got.columns else F.lit(0.0).alias(m) for m in KEY_METRICS])
    return whole.unpivot([], KEY_METRICS, "metric", "value")
