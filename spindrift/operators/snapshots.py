"""Snapshots of analysis runs from their JSON result files, whose shapes drift: values are taken by path from VARIANT, whatever else is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The runs in their order, and the files that may hold a run's results, the first that is there counts.
TARGETS = {"basic": ("analysis_results.json",), "enhanced": ("enhanced_analysis_results.json",), "mlx": ("enhanced_results.json",)}
HIGHLIGHTS_EACH, HIGHLIGHTS, LISTED = 2, 6, 5


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(pipeline, file, text) of the JSON files in root's folders, a folder a run."""
    at = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True).select(F.element_at(at, -2).alias("pipeline"), F.element_at(at, -1).alias("file"), F.col("value").alias("text"))


def texts(v: Column) -> Column:
    """A list of texts: of a list its texts (other values as JSON), of a text that one, else none."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.to_json(x)))
    one = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    return F.coalesce(items, one, F.array().cast("array<string>"))


def extract(files: DataFrame, targets: dict[str, tuple[str, ...]] | None = None, now: str | None = None) -> DataFrame:
    """(pipeline, position, file, total_urls, timestamp, key_findings, alerts, scores) of files(pipeline, file, text): one row a run that has one of its files. A run
    whose file isn't a JSON object has no row; a missing or foreign value is 0, now, or empty."""
    known = [(p, f, i, k) for i, (p, names) in enumerate((targets or TARGETS).items()) for k, f in enumerate(names)]
    wanted = files.sparkSession.createDataFrame(known, "pipeline string, file string, position int, choice int")
    first = files.join(F.broadcast(wanted), ["pipeline", "file"]).groupBy("pipeline", "position").agg(F.min_by(F.struct("file", "text"), "choice").alias("best"))  # wanted: the names above
    v = F.col("v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = first.select("pipeline", "position", "best.file", F.explode(F.array(F.try_parse_json("best.text"))).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    scores = F.map_filter(F.transform_values(F.try_variant_get(v, "$.insights.scores", "map<string,variant>"), lambda k, x: F.when(~F.schema_of_variant(x).isin("STRING", "BOOLEAN"), F.try_variant_get(x, "$", "double"))), lambda k, x: x.isNotNull())
    return rows.select(
        "pipeline", "position", "file", F.coalesce(get("$.metadata.total_urls", "long"), get("$.metadata.raw_urls", "long"), F.lit(0)).alias("total_urls"),
        F.coalesce(get("$.metadata.analysis_timestamp", "string"), F.lit(now), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        texts(get("$.insights.key_findings", "variant")).alias("key_findings"), texts(get("$.insights.alerts", "variant")).alias("alerts"), F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("scores"),
    )


def summary(snapshots: DataFrame) -> DataFrame:
    """One row: URLs and alerts of all runs, their names in order, and the first findings of each as highlights. Runs are few by their targets."""
    rows = F.sort_array(F.collect_list(F.struct("position", "pipeline", F.slice("key_findings", 1, HIGHLIGHTS_EACH).alias("top"))))
    one = snapshots.agg(F.coalesce(F.sum("total_urls"), F.lit(0)).alias("urls"), F.coalesce(F.sum(F.size("alerts")), F.lit(0)).alias("alerts"), rows.alias("rows"))
    return one.select("urls", "alerts", F.transform("rows", lambda r: r["pipeline"]).alias("pipelines"), F.slice(F.flatten(F.transform("rows", lambda r: r["top"])), 1, HIGHLIGHTS).alias("highlights"))


def report(snapshots: DataFrame, generated: str) -> DataFrame:
    """(line_number, line) of the report in Markdown: overview, highlights, and a part for each run."""
    total = summary(snapshots)
    bullets = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("- "), x))
    none = F.array().cast("array<string>")
    some = lambda xs, title: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(""), F.lit(title)), bullets(F.slice(xs, 1, LISTED)))).otherwise(none)
    head = F.concat(
        F.array(F.lit("# Unified Analysis Summary"), F.lit(""), F.lit(f"_Generated: {generated}_"), F.lit(""), F.lit("## Overview"), F.lit(""), F.format_string("- Total URLs analyzed: **%d**", "urls"), F.format_string("- Pipelines executed: **%s**", F.array_join("pipelines", ", ")), F.format_string("- Alerts detected: **%d**", "alerts"), F.lit("")),
        F.when(F.size("highlights") > 0, F.concat(F.array(F.lit("## Highlights"), F.lit("")), bullets(F.col("highlights")), F.array(F.lit("")))).otherwise(none),
    )
    scores = F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat(e["key"], F.lit(": "), F.format_string("%.1f", e["value"]))), ", ")
    ascii_only = F.transform("alerts", lambda a: F.coalesce(F.nullif(F.trim(F.regexp_replace(a, r"[^\x00-\x7F]", "")), F.lit("")), F.trim(a)))
    part = F.concat(
        F.array(F.concat(F.lit("## "), F.initcap("pipeline"), F.lit(" Analysis")), F.lit(""), F.concat(F.lit("- Results path: `"), F.col("file"), F.lit("`")), F.format_string("- URLs processed: %d", "total_urls"), F.concat(F.lit("- Generated: "), F.col("timestamp"))),
        F.when(F.size("scores") > 0, F.array(F.concat(F.lit("- Scores: "), scores))).otherwise(none), some(F.col("key_findings"), "**Key Findings**"), some(ascii_only, "**Alerts**"), F.array(F.lit("")),
    )
    lines = total.select(F.lit(-1).alias("position"), F.posexplode(head).alias("at", "line")).unionByName(snapshots.select("position", F.posexplode(part).alias("at", "line")))
    return lines.select((F.row_number().over(W.orderBy("position", "at"))).alias("line_number"), "line")  # a report's lines
