"""Readers and writers: JSONL crawl records, result and snapshot JSON, tables over JDBC, reports."""

from __future__ import annotations

import time
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RECORD = (
    "url STRING, url_normalized STRING, depth DOUBLE, parent_url STRING, fragments ARRAY<STRING>, discovered_at DOUBLE, queued_at DOUBLE, crawled_at DOUBLE, "
    "response_time_ms DOUBLE, status_code INT, content_type STRING, content_length DOUBLE, title STRING, links ARRAY<STRING>"
)
URL_PREFIXES = ("postgresql", "postgresql+psycopg2", "sqlite")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) in input order; no rows if nothing is at path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], "ordinal long, line string")
    # within a block the id rises line by line; blocks are ordered by file and start, and sizes is a row a block
    block = ["file", "start"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"))
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = sizes.select(*block, (F.sum("n").over(W.orderBy(*block)) - F.col("n") - F.col("least")).alias("shift"))
    return rows.join(before, block).select((F.col("id") + F.col("shift")).alias("ordinal"), "line")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records of a JSONL dump: objects with a URL, and strings, which are URLs. Blank and malformed lines and other values are
    dropped, unknown fields ignored; a missing path has no records."""
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    parsed = F.when(kind.startswith("OBJECT"), F.from_json("line", RECORD)).when(kind == "STRING", F.from_json(F.concat(F.lit('{"url":'), F.col("line"), F.lit("}")), RECORD))
    return _lines(spark, path).where("line <> ''").select("ordinal", parsed.alias("r")).select("ordinal", "r.*").where("coalesce(url, '') <> ''")


def check_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row: all lines, lines with a URL, malformed lines; valid if there is any URL."""
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    url = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.url", "string")).when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    one = _lines(spark, path).agg(F.count("*").alias("total_lines"), F.count_if(F.coalesce(url, F.lit("")) != "").alias("valid_urls"), F.count_if((F.col("line") != "") & v.isNull()).alias("bad_lines"))
    return one.withColumn("valid", F.col("valid_urls") > 0)


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, message) of each malformed line; blank lines are none."""
    bad = _lines(spark, path).where("line <> ''").where(F.try_parse_json("line").isNull())
    return bad.select((F.col("ordinal") + 1).alias("line_number"), F.format_string("Line %d: Invalid JSON", F.col("ordinal") + 1).alias("message"))


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Records by schema; the first malformed line fails the job."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def normalize_file(spark: SparkSession, source: str, target: str, remove_fragments: bool = True) -> None:
    """JSONL in, one merged record a canonical URL out, with every known field: merged links and fragments, hash and number of records."""
    from spindrift.operators.normalize import merged, merged_records

    crawl = read_jsonl(spark, source)
    first = merged(crawl, remove_fragments).select("url_hash", "first_ordinal", "records")
    merged_records(crawl, remove_fragments).drop("ordinal").join(first, "url_hash").orderBy("first_ordinal").write.json(target)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, ts, metadata, metrics) of JSON files, a snapshot a file; unreadable ones are skipped. Order by snapshot_id, the files' names."""
    schema = "snapshot_id STRING, timestamp STRING, metadata MAP<STRING,STRING>, metrics MAP<STRING,DOUBLE>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumnRenamed("timestamp", "ts")


def write_snapshot(spark: SparkSession, path: str, snapshot_id: str, ts: str, metrics: dict[str, float], metadata: dict[str, str] | None = None) -> None:
    df = spark.createDataFrame([(snapshot_id, ts, metadata or {}, metrics)], "snapshot_id STRING, timestamp STRING, metadata MAP<STRING,STRING>, metrics MAP<STRING,DOUBLE>")
    df.coalesce(1).write.mode("append").json(path)


def jdbc_options(url: str) -> dict[str, str]:
    """A database URL as JDBC's url, user and password: the driver after + goes, and so do the slashes before a file of sqlite."""
    kind, _, rest = url.removeprefix("jdbc:").partition(":")
    if kind not in URL_PREFIXES:
        raise ValueError(f"URL must start with one of {', '.join(URL_PREFIXES)}")
    if kind == "sqlite":
        return {"url": f"jdbc:sqlite:{rest.removeprefix('///')}"}
    parts = urlsplit(rest)
    where = parts._replace(netloc=parts.netloc.rpartition("@")[2]).geturl()
    login = {"user": parts.username, "password": parts.password}
    return {"url": f"jdbc:postgresql:{where}", **{k: unquote(v) for k, v in login.items() if v}}


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table over JDBC; give partitionColumn, lowerBound, upperBound and numPartitions for parallel reads."""
    return spark.read.format("jdbc").options(**jdbc_options(url), dbtable=table, **options).load()


def probe(spark: SparkSession, options: dict[str, str], query: str = "SELECT 1 AS one", retries: int = 3, pause: float = 0.5) -> bool:
    """Whether a database answers a query over JDBC, asked at most so many times."""
    for attempt in range(max(1, retries)):
        try:
            spark.read.format("jdbc").options(**options).option("query", query).load().first()
            return True
        except Exception:  # noqa: BLE001 - whatever the driver raises is no answer
            if attempt + 1 < retries:
                time.sleep(pause)
    return False


def read_table_evenly(spark: SparkSession, options: dict[str, str], table: str, column: str, partitions: int = 8, sample: float | None = None) -> DataFrame:
    """A relational table over JDBC in even ranges of a column: bounds between them are quantiles of the column, which one narrow scan of it gives
    (of a sampled share of it, where sample is given), and each range is a predicate that the database evaluates. Nulls go with the first
    range. A column of few values gives fewer ranges, and a table without rows one."""
    narrow = spark.read.format("jdbc").options(**options).option("query", f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL").load()
    narrow = narrow.sample(sample, seed=1) if sample else narrow
    name = narrow.columns[0]
    steps = [k / partitions for k in range(1, partitions)]
    cuts = narrow.agg(F.percentile_approx(name, F.array(*map(F.lit, steps))).alias("cuts")).first()["cuts"] if steps else []
    shown = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    bounds = [shown(v) for v in dict.fromkeys(cuts or [])]
    if not bounds:
        return spark.read.format("jdbc").options(**options, dbtable=table).load()
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    predicates = [f"{column} < {bounds[0]} OR {column} IS NULL", *between, f"{column} >= {bounds[-1]}"]
    own = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates, properties=own)


def create_tables(spark: SparkSession) -> None:
    """The relational tables, if they aren't there, as Parquet tables of the catalog."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


TABLES = {
    "urls": "id INT, url STRING, domain STRING, path STRING, last_crawled TIMESTAMP_NTZ, status_code INT, content_type STRING, file_extension STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "classifications": "id INT, url_id INT, category STRING, confidence DOUBLE, model_version STRING, created_at TIMESTAMP_NTZ",
    "page_metadata": "id INT, url_id INT, title STRING, description STRING, keywords ARRAY<STRING>, language STRING, word_count INT, has_images BOOLEAN, has_videos BOOLEAN, has_forms BOOLEAN, extracted_at TIMESTAMP_NTZ",
    "patterns": "id INT, pattern_type STRING, pattern_value STRING, frequency INT, confidence DOUBLE, discovered_at TIMESTAMP_NTZ",
    "crawl_sessions": "id INT, session_id STRING, total_urls INT, processed_urls INT, failed_urls INT, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, status STRING",
    "url_analyses": "id INT, url STRING, domain STRING, path STRING, classifications STRING, sitemap_url STRING, priority DOUBLE, change_freq STRING, last_modified TIMESTAMP_NTZ, analyzed_at TIMESTAMP_NTZ, analysis_version STRING, status STRING, error_message STRING",
    "sitemap_sources": "id INT, sitemap_url STRING, domain STRING, total_urls INT, analyzed_urls INT, failed_urls INT, first_crawled_at TIMESTAMP_NTZ, last_crawled_at TIMESTAMP_NTZ, status STRING, crawl_frequency STRING",
    "categories": "id INT, category_type STRING, label STRING, description STRING, is_active BOOLEAN, sort_order INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, created_by STRING",
}


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One JSON folder a result."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
