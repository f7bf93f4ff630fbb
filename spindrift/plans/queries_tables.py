"""Queries of the dataset layer, tracking and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import datasets, quality, stats, tracking
from spindrift.plans.registry import query, rounded
from spindrift.plans.views import CRAWL, oracle, view  # noqa: F401

MICRO = "CAST({} AS TIMESTAMP)"


@query(oracle("""SELECT domain, COUNT(*) AS url_count, COUNT(DISTINCT file_extension) AS unique_extensions, MAX(last_crawled) AS last_crawled,
  ROUND(AVG(CASE WHEN status_code = 200 THEN 1.0 ELSE 0.0 END) * 100, 6) AS success_rate FROM urls WHERE domain IS NOT NULL GROUP BY domain""", "urls"))
def ds_urls_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(datasets.urls_by_domain(view(spark, sf_dir, "urls")), "success_rate").withColumn("last_crawled", F.col("last_crawled").cast("timestamp_ntz"))


@query(oracle("""SELECT c.id, u.url, u.domain, c.category, c.confidence, c.model_version FROM classifications c JOIN urls u ON c.url_id = u.id""", "urls", "classifications"))
def ds_classifications_with_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = datasets.with_urls(view(spark, sf_dir, "classifications"), view(spark, sf_dir, "urls"), "url", "domain")
    return c.select("id", "url", "domain", "category", "confidence", "model_version").orderBy(F.desc_nulls_first("id"))


@query(oracle("""SELECT m.id, u.url, m.title, m.language, m.word_count, m.has_images, m.has_videos, m.has_forms FROM page_metadata m JOIN urls u ON m.url_id = u.id""", "urls", "page_metadata"))
def ds_page_metadata_with_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = datasets.with_urls(view(spark, sf_dir, "page_metadata"), view(spark, sf_dir, "urls"), "url")
    return m.select("id", "url", "title", "language", "word_count", "has_images", "has_videos", "has_forms")


@query(oracle("""SELECT domain, COUNT(*) AS total_urls, COUNT(CASE WHEN status_code = 200 THEN 1 END) AS successful, COUNT(CASE WHEN status_code >= 400 THEN 1 END) AS errors,
  COUNT(CASE WHEN status_code BETWEEN 300 AND 399 THEN 1 END) AS redirects, COUNT(DISTINCT content_type) AS content_types, MIN(last_crawled) AS first_seen, MAX(last_crawled) AS last_seen,
  ROUND(AVG(CASE WHEN content_type LIKE 'text/html%' THEN 1.0 ELSE 0.0 END) * 100, 6) AS html_percentage FROM urls WHERE domain IS NOT NULL GROUP BY domain HAVING COUNT(*) > 0""", "urls"))
def ds_domain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rounded(datasets.domain_statistics(view(spark, sf_dir, "urls")), "html_percentage")
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


DISTRIBUTION = "SELECT {0}, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6)::DOUBLE AS percentage FROM urls WHERE {0} IS NOT NULL GROUP BY {0}"


@query(oracle(DISTRIBUTION.format("content_type"), "urls"))
def ds_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(datasets.distribution(view(spark, sf_dir, "urls"), "content_type"), "percentage")


@query(oracle(DISTRIBUTION.format("status_code"), "urls"))
def ds_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(datasets.distribution(view(spark, sf_dir, "urls"), "status_code"), "percentage")


@query(oracle("SELECT id, url, domain, status_code FROM urls WHERE status_code = 200 ORDER BY id LIMIT 100 OFFSET 10", "urls"))
def ds_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "urls").createOrReplaceTempView("urls")
    return datasets.Datasets(spark, {}).page("urls", 100, 10, {"status_code": 200, "no such column": 1}, ["id"]).select("id", "url", "domain", "status_code")


@query(oracle("SELECT 'urls' AS dataset, COUNT(*) AS n FROM urls UNION ALL SELECT 'patterns', COUNT(*) FROM patterns UNION ALL SELECT 'crawl_sessions', COUNT(*) FROM crawl_sessions", "urls", "patterns", "crawl_sessions"))
def ds_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["urls", "patterns", "crawl_sessions"]
    sets = datasets.Datasets(spark, {n: lambda n=n: view(spark, sf_dir, n) for n in names})
    return spark.createDataFrame([(n, sets.count(n)) for n in names], "dataset string, n long")


@query(oracle("""SELECT (SELECT COUNT(id) FROM urls) AS total_urls, (SELECT COUNT(DISTINCT domain) FROM urls) AS unique_domains, (SELECT COUNT(id) FROM classifications) AS total_classifications,
  (SELECT COUNT(id) FROM page_metadata) AS total_metadata, (SELECT COUNT(id) FROM crawl_sessions) AS total_sessions""", "urls", "classifications", "page_metadata", "crawl_sessions"))
def ds_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.database_statistics(*[view(spark, sf_dir, n) for n in ("urls", "classifications", "page_metadata", "crawl_sessions")])


@query(oracle("""SELECT u.id, u.url, u.status_code, COALESCE(c.n, 0) AS classifications, c.best_category, c.best_confidence, m.title FROM urls u
  LEFT JOIN (SELECT url_id, COUNT(*) AS n, arg_max(category, (confidence, id)) AS best_category, MAX(confidence) AS best_confidence FROM classifications GROUP BY url_id) c ON c.url_id = u.id
  LEFT JOIN page_metadata m ON m.url_id = u.id""", "urls", "classifications", "page_metadata"))
def ds_url_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.url_details(view(spark, sf_dir, "urls"), view(spark, sf_dir, "classifications"), view(spark, sf_dir, "page_metadata")).select("id", "url", "status_code", "classifications", "best_category", "best_confidence", "title")


@query(oracle("SELECT id, url, domain, status_code, content_type FROM urls WHERE domain = 'www.example.com' AND status_code = 200 ORDER BY last_crawled DESC, id LIMIT 100", "urls"))
def ds_urls_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.urls_where(view(spark, sf_dir, "urls"), "www.example.com", 200).select("id", "url", "domain", "status_code", "content_type").limit(100)


@query(oracle("SELECT u.id AS url_id, u.url, c.category, c.confidence, c.model_version, c.created_at, (ROW_NUMBER() OVER (PARTITION BY c.url_id ORDER BY c.created_at DESC, c.id DESC))::INT AS rank FROM urls u JOIN classifications c ON c.url_id = u.id", "urls", "classifications"))
def ds_url_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.url_classifications(view(spark, sf_dir, "urls"), view(spark, sf_dir, "classifications"))


@query(oracle("SELECT domain, COUNT(id) AS url_count FROM urls WHERE domain IS NOT NULL GROUP BY domain ORDER BY url_count DESC, domain LIMIT 50", "urls"))
def ds_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "urls").where("domain is not null").groupBy("domain").agg(F.count("id").alias("url_count")).orderBy(F.desc("url_count"), "domain").limit(50)


@query(oracle("SELECT id, pattern_type, pattern_value, frequency, confidence FROM patterns WHERE pattern_type = 'event' ORDER BY frequency DESC NULLS FIRST, id", "patterns"))
def ds_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.where_equal(view(spark, sf_dir, "patterns"), {"pattern_type": "event"}).select("id", "pattern_type", "pattern_value", "frequency", "confidence").orderBy(F.desc_nulls_first("frequency"), "id")


@query(oracle("SELECT id, session_id, total_urls, processed_urls, failed_urls, status FROM crawl_sessions WHERE status = 'completed'", "crawl_sessions"))
def ds_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.where_equal(view(spark, sf_dir, "crawl_sessions"), {"status": "completed"}).orderBy(F.desc_nulls_first("started_at"), "id").select("id", "session_id", "total_urls", "processed_urls", "failed_urls", "status")


@query(oracle("""SELECT ordinal, url, split_part(url, '/', 3) AS domain, NULLIF(regexp_extract(regexp_extract(url, '^[^?#]*'), '[.]([a-zA-Z0-9]+)$', 1), '') AS file_extension
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY ordinal) AS r FROM crawl) x WHERE r = 1""", "crawl"))
def ds_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ingested(view(spark, sf_dir, "crawl"))


FULL_URLS = "SELECT u.*, last_crawled - INTERVAL '1' DAY AS created_at, last_crawled + INTERVAL '1' HOUR AS updated_at FROM urls u"
FULL_METADATA = "SELECT m.*, {} AS keywords FROM page_metadata m WHERE id % 3 > 0"
RECORD = "id, url, domain, path, status_code, content_type, file_extension, last_crawled, created_at, updated_at, classifications, title, description, keywords, language, word_count, has_images, has_videos, has_forms, extracted_at"


@query(oracle(f"""SELECT {RECORD} FROM ({FULL_URLS}) u LEFT JOIN (SELECT url_id, COUNT(*) AS n FROM classifications GROUP BY 1) c ON c.url_id = u.id
  LEFT JOIN (SELECT * EXCLUDE (id) FROM ({FULL_METADATA.format("concat(title, ';', id)")}) m) m ON m.url_id = u.id""".replace(", classifications,", ", COALESCE(c.n, 0) AS classifications,"), "urls", "classifications", "page_metadata"))
def ds_url_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("urls", "page_metadata"):
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    found = datasets.url_records(spark.sql(FULL_URLS), view(spark, sf_dir, "classifications"), spark.sql(FULL_METADATA.format("array(title, cast(id as string))")))
    return found.withColumns({"keywords": F.array_join("keywords", ";"), **{c: F.col(c).cast("timestamp_ntz") for c in ("last_crawled", "created_at", "updated_at", "extracted_at")}}).select(*RECORD.split(", "))


@query(oracle("""SELECT * FROM (SELECT 'urls' AS "table", COUNT(*) AS rows, 8 AS columns, FALSE AS failed FROM urls UNION ALL SELECT 'classifications', COUNT(*), 6, FALSE FROM classifications UNION ALL SELECT 'page_metadata', COUNT(*), 10, FALSE FROM page_metadata
  UNION ALL SELECT 'patterns', COUNT(*), 6, FALSE FROM patterns UNION ALL SELECT 'lost', NULL, NULL, TRUE) x""", "urls", "classifications", "page_metadata", "patterns"))
def ds_table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each table; one that isn't there leaves the others theirs."""
    frames = {name: lambda name=name: view(spark, sf_dir, name) for name in ("urls", "classifications", "page_metadata", "patterns")}
    found = datasets.table_statistics(spark, frames | {"lost": lambda: spark.read.parquet(f"{sf_dir}/no such table.parquet")})
    return found.select("table", "rows", "columns", F.col("error").isNotNull().alias("failed"))


CLUSTERS = """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, COUNT(*) AS count, ROUND(AVG(depth), 6) AS avg_depth, COUNT(DISTINCT parent_url) AS parents FROM ticks GROUP BY 1 HAVING COUNT(*) >= {}"""


@query(oracle(CLUSTERS.format(2), "ticks"))
def mp_temporal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.temporal_clusters(view(spark, sf_dir, "ticks"), least=2), "avg_depth").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(oracle(CLUSTERS.replace("5 minutes", "6 hours").format(10) + " ORDER BY 2 DESC, 1 LIMIT 20", "ticks"))
def mp_significant_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.significant_clusters(view(spark, sf_dir, "ticks"), "6 hours"), "avg_depth")



@query(oracle("""SELECT COUNT(*) AS parents, ROUND(AVG(children), 6) AS avg_children, MAX(children) AS max_children FROM (SELECT parent_url, COUNT(DISTINCT url) AS children FROM ticks WHERE parent_url <> '' GROUP BY parent_url) k""", "ticks"))
def mp_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.parent_child(view(spark, sf_dir, "ticks")), "avg_children")


@query(oracle("""SELECT LEAST(CAST(FLOOR((epoch_us(ts) / 1e6 - low) / ((high - low) / 10)) AS INT), 10) AS slot, COUNT(*) AS count
  FROM ticks, (SELECT MIN(epoch_us(ts) / 1e6) AS low, MAX(epoch_us(ts) / 1e6) AS high FROM ticks) e GROUP BY 1""", "ticks"))
def st_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timeline(view(spark, sf_dir, "ticks"))


# Snapshots: a run a user, with metrics of the events of that user.
SNAPSHOTS = """SELECT concat('run_', lpad(CAST(user_id AS VARCHAR(20)), 6, '0')) AS snapshot_id, MIN(ts) AS ts,
  AVG(value) AS data_quality_score, CAST(COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) AS error_rate, CAST(COUNT(*) AS DOUBLE) AS total_urls, MAX(value) AS urls_per_second FROM events GROUP BY user_id"""
METRICS = ["data_quality_score", "error_rate", "total_urls", "urls_per_second"]
POINTS = " UNION ALL ".join(f"SELECT snapshot_id, ts, '{m}' AS metric, {m} AS value FROM snaps" for m in METRICS)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    pairs = [x for m in METRICS for x in (F.lit(m), F.col(m))]
    return spark.sql(SNAPSHOTS).select("snapshot_id", "ts", F.create_map(*pairs).alias("metrics"))


def over_points(sql: str) -> str:
    return f"WITH snaps AS ({SNAPSHOTS}), points AS ({POINTS})\n{sql}"


RISES, FALLS, TRACKED = (", ".join(f"'{m}'" for m in some) for some in (tracking.RISE, tracking.FALL, tracking.TRACKED))


@query(over_points(f"""SELECT metric, ROUND(a, 6) AS baseline, ROUND(b, 6) AS current, ROUND(b - a, 6) AS delta, ROUND(COALESCE((b - a) * 100 / NULLIF(a, 0), 0), 6) AS percent_change,
  CASE WHEN metric IN ({RISES}) THEN CASE WHEN b - a > 1 THEN 'improvement' WHEN b - a < -1 THEN 'regression' ELSE 'none' END
       WHEN metric IN ({FALLS}) THEN CASE WHEN b - a < -1 THEN 'improvement' WHEN b - a > 1 THEN 'regression' ELSE 'none' END ELSE 'none' END AS verdict
  FROM (SELECT metric, MAX(CASE WHEN snapshot_id = 'run_000001' THEN value END) AS a, MAX(CASE WHEN snapshot_id = 'run_000002' THEN value END) AS b FROM points GROUP BY metric) x"""))
def mt_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.compare(tracking.points(snapshots(spark, sf_dir)), "run_000001", "run_000002"), "baseline", "current", "delta", "percent_change")


VERDICT = f"""CASE WHEN metric IN ({RISES}) THEN CASE WHEN b - a > 1 THEN 'improvement' WHEN b - a < -1 THEN 'regression' ELSE 'none' END
  WHEN metric IN ({FALLS}) THEN CASE WHEN b - a < -1 THEN 'improvement' WHEN b - a > 1 THEN 'regression' ELSE 'none' END ELSE 'none' END"""
LATEST = "(SELECT snapshot_id, ROW_NUMBER() OVER (ORDER BY snapshot_id DESC) AS k FROM (SELECT DISTINCT snapshot_id FROM points) d)"


@query(over_points(f"""SELECT x.metric, ROUND(a, 6) AS baseline, ROUND(b, 6) AS current, ROUND(b - a, 6) AS delta, ROUND(COALESCE((b - a) * 100 / NULLIF(a, 0), 0), 6) AS percent_change, {VERDICT.replace("metric", "x.metric")} AS verdict, t.trend
  FROM (SELECT metric, MAX(CASE WHEN k = 2 THEN value END) AS a, MAX(CASE WHEN k = 1 THEN value END) AS b FROM points JOIN {LATEST} l USING (snapshot_id) WHERE k <= 2 GROUP BY metric) x
  LEFT JOIN (SELECT metric, CASE WHEN n < 2 THEN 'unknown' WHEN l > f * 1.05 THEN CASE WHEN good THEN 'improving' ELSE 'worsening' END WHEN l < f * 0.95 THEN CASE WHEN good THEN 'worsening' ELSE 'improving' END ELSE 'stable' END AS trend
    FROM (SELECT metric, n, f, l, CASE WHEN metric IN ({RISES}) THEN l - f > 1 WHEN metric IN ({FALLS}) THEN l - f < -1 ELSE FALSE END AS good FROM (SELECT metric, COUNT(*) AS n, arg_min(value, snapshot_id) AS f, arg_max(value, snapshot_id) AS l
      FROM points JOIN {LATEST} l USING (snapshot_id) WHERE k <= 5 AND metric IN ({TRACKED}) GROUP BY metric) y) z) t ON t.metric = x.metric"""))
def mt_last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.last_two(tracking.points(snapshots(spark, sf_dir))), "baseline", "current", "delta", "percent_change")


TAKEN = {"total_urls": "n", "avg_depth": "d", "max_depth_reached": "m", "avg_links_per_page": "l", "depth_efficiency": "100 - LEAST(m * 10, 100)"}


@query(oracle("SELECT metric, ROUND(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, ({TAKEN.get(k, '0')})::DOUBLE AS value FROM s" for k in tracking.KEY_METRICS) + """) x""", "crawl").replace(
    "\nSELECT metric", """,
s AS (SELECT COUNT(*) AS n, AVG(COALESCE(depth, 0)) AS d, MAX(COALESCE(depth, 0)) AS m, AVG(len(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS l FROM crawl)
SELECT metric"""))
def mt_key_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = view(spark, sf_dir, "crawl")
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    depth = F.coalesce("depth", F.lit(0))
    statistical = crawl.agg(F.count("*").alias("total_urls"), F.avg(depth).alias("depth_mean"), F.max(depth).alias("depth_max"), F.avg(links).alias("outbound_links_mean"))
    return rounded(tracking.key_metrics({"statistical": statistical, "pathway": crawl.agg(F.max(depth).alias("max_depth"))}), "value")


@query(over_points(f"""SELECT metric, points, ROUND(a, 6) AS first_value, ROUND(b, 6) AS last_value, CASE WHEN points < 2 THEN 'unknown'
  WHEN b > a * 1.05 THEN CASE WHEN good THEN 'improving' ELSE 'worsening' END WHEN b < a * 0.95 THEN CASE WHEN good THEN 'worsening' ELSE 'improving' END ELSE 'stable' END AS trend
  FROM (SELECT metric, points, a, b, CASE WHEN metric IN ({RISES}) THEN b - a > 1 WHEN metric IN ({FALLS}) THEN b - a < -1 ELSE FALSE END AS good
    FROM (SELECT metric, COUNT(*) AS points, arg_min(value, snapshot_id) AS a, arg_max(value, snapshot_id) AS b
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY snapshot_id DESC) AS r FROM points) y WHERE r <= 10 GROUP BY metric) z) x"""))
def mt_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.trends(tracking.points(snapshots(spark, sf_dir))), "first_value", "last_value")


@query(over_points("""SELECT metric, snapshot_id, ROUND(value, 6) AS value, ROUND(c, 6) AS change_pct, ABS(c) < 1 AS stable
  FROM (SELECT *, COALESCE((value - b) * 100 / NULLIF(ABS(b), 0), 0) AS c FROM (SELECT *, LAG(value) OVER (PARTITION BY metric ORDER BY ts, snapshot_id) AS b FROM points) y) x"""))
def mt_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.changes(tracking.points(snapshots(spark, sf_dir))), "value", "change_pct")


@query(over_points("SELECT metric, COUNT(*) AS snapshots, ROUND(SUM(value), 4) AS total, ROUND(MIN(value), 6) AS least, ROUND(MAX(value), 6) AS most FROM points GROUP BY metric"))
def sa_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.rollup(snapshots(spark, sf_dir)).withColumn("total", F.round("total", 4)), "least", "most")


@query(oracle("""SELECT rule, violations FROM (SELECT COUNT(CASE WHEN COALESCE(url, '') = '' THEN 1 END) AS url, COUNT(CASE WHEN NOT COALESCE(depth >= 0, FALSE) THEN 1 END) AS depth,
  COUNT(CASE WHEN response_time_ms < 0 THEN 1 END) AS response_time_ms, COUNT(CASE WHEN status_code IS NULL THEN 1 END) AS status_code, COUNT(CASE WHEN content_type IS NULL THEN 1 END) AS content_type FROM crawl) x
  UNPIVOT (violations FOR rule IN (url, depth, response_time_ms, status_code, content_type))""", "crawl"))
def dv_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_errors(view(spark, sf_dir, "crawl"))


BROKEN = {"url": "COALESCE(url, '') = ''", "depth": "NOT COALESCE(depth >= 0, FALSE)", "response_time_ms": "response_time_ms < 0", "status_code": "status_code IS NULL", "content_type": "content_type IS NULL"}


@query(oracle(" UNION ALL ".join(f"SELECT ordinal, '{rule}' AS rule FROM crawl WHERE {broken}" for rule, broken in BROKEN.items()), "crawl"))
def dv_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.record_errors(view(spark, sf_dir, "crawl"))


@query(oracle(f"SELECT ordinal, url, status_code, content_type FROM crawl WHERE NOT ({' OR '.join(f'COALESCE({b}, FALSE)' for b in BROKEN.values())})", "crawl"))
def dv_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.valid_records(view(spark, sf_dir, "crawl")).select("ordinal", "url", "status_code", "content_type")


@query(oracle("""SELECT records, status_codes, content_types, missing_titles, ROUND(avg_response_ms, 6) AS avg_response_ms, unique_urls, duplicates, ROUND(duplicates * 100.0 / records, 6)::DOUBLE AS duplicate_pct,
  duplicates * 100.0 / records <= 60 AS valid, avg_response_ms > 1000 AS slow FROM
  (SELECT COUNT(*) AS records, COUNT(DISTINCT COALESCE(CAST(status_code AS VARCHAR), 'null')) AS status_codes, COUNT(DISTINCT COALESCE(content_type, 'null')) AS content_types,
    COUNT(CASE WHEN COALESCE(title, '') = '' THEN 1 END) AS missing_titles, AVG(COALESCE(response_time_ms, 0)) AS avg_response_ms FROM crawl) a,
  (SELECT COUNT(*) AS unique_urls, COUNT(CASE WHEN n > 1 THEN 1 END) AS duplicates FROM (SELECT url, COUNT(*) AS n FROM crawl GROUP BY url) g) b""", "crawl"))
def dv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.summary(view(spark, sf_dir, "crawl")), "avg_response_ms", "duplicate_pct")


GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query(oracle(f"""SELECT total, with_title, with_links, errors, duplicates, ROUND(score, 6) AS score, {GRADE.format("score")} AS grade FROM (SELECT *, (with_title * 40.0 + with_links * 30.0 - errors * 20.0 - duplicates * 10.0)::DOUBLE / total AS score FROM
  (SELECT COUNT(*) AS total, COUNT(CASE WHEN title <> '' THEN 1 END) AS with_title, COUNT(CASE WHEN len(regexp_extract_all(html, 'href="([^"]*)"', 1)) > 0 THEN 1 END) AS with_links,
    COUNT(CASE WHEN status_code >= 400 THEN 1 END) AS errors, COUNT(*) - COUNT(DISTINCT url) AS duplicates FROM crawl) a) b""", "crawl"))
def sc_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = view(spark, sf_dir, "crawl").withColumn("links", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return rounded(quality.quick_grade(crawl), "score")
