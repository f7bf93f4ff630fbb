"""Named datasets over the relational tables: definitions, guards, filters, paging and counts."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Limits of paging and the form of identifiers.
DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def percent(condition: Column) -> Column:
    """Share of rows, in percent, at which the condition is true; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def urls_by_domain(urls: DataFrame) -> DataFrame:
    return urls.where("domain is not null").groupBy("domain").agg(F.count("*").alias("url_count"), F.countDistinct("file_extension").alias("unique_extensions"), F.max("last_crawled").alias("last_crawled"), percent(F.col("status_code") == 200).alias("success_rate"))


def domain_statistics(urls: DataFrame) -> DataFrame:
    code = F.col("status_code")
    return (
        urls.where("domain is not null").groupBy("domain")
        .agg(F.count("*").alias("total_urls"), F.count_if(code == 200).alias("successful"), F.count_if(code >= 400).alias("errors"), F.count_if(code.between(300, 399)).alias("redirects"), F.countDistinct("content_type").alias("content_types"),
             F.min("last_crawled").alias("first_seen"), F.max("last_crawled").alias("last_seen"), percent(F.col("content_type").like("text/html%")).alias("html_percentage"))
        .where("total_urls > 0")
    )


def with_urls(children: DataFrame, urls: DataFrame, *columns: str) -> DataFrame:
    """Children of a URL row (inner join on url_id), with the URL's columns."""
    u = urls.select(F.col("id").alias("url_id"), *columns)
    return children.join(u, "url_id")


def distribution(urls: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each non-null value; the total is a window over the few groups."""
    return urls.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(W.partitionBy()))


def valid_identifier(name: object) -> bool:
    return isinstance(name, str) and bool(IDENTIFIER.match(name))


def valid_limit(limit: object) -> int:
    """A limit in range: 100 for what isn't a positive integer, 10000 at most."""
    return DEFAULT_LIMIT if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1 else min(limit, MAX_LIMIT)


def valid_offset(offset: object) -> int:
    return max(0, offset) if isinstance(offset, int) and not isinstance(offset, bool) else 0


def where_equal(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows at which all named columns equal the given values; names that are no identifiers or columns are skipped."""
    tests = [F.col(k) == F.lit(v) for k, v in (filters or {}).items() if valid_identifier(k) and k in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


class Datasets:
    """Predefined datasets and, for each table of the catalog, SELECT * as one of its own; predefined names win."""

    def __init__(self, spark: SparkSession, predefined: dict[str, Callable[[], DataFrame]]) -> None:
        self.spark, self.predefined, self._tables = spark, predefined, None

    def tables(self, refresh: bool = False) -> dict[str, str]:
        if self._tables is None or refresh:
            self._tables = {t.name.lower(): t.name for t in self.spark.catalog.listTables() if valid_identifier(t.name)}
        return self._tables

    def columns(self, table: str) -> list[str]:
        if not valid_identifier(table) or not self.spark.catalog.tableExists(table):
            return []
        return [c.name for c in self.spark.catalog.listColumns(table)]

    def names(self, refresh: bool = False) -> list[dict]:
        tables = {k: {"key": k, "name": k.replace("_", " ").title(), "is_custom": False} for k in self.tables(refresh)}
        own = {k: {"key": k, "name": k.replace("_", " ").title(), "is_custom": True} for k in self.predefined}
        return list({**tables, **own}.values())

    def frame(self, name: str) -> DataFrame:
        if name in self.predefined:
            return self.predefined[name]()
        if name in self.tables():
            return self.spark.table(self.tables()[name])
        raise ValueError(f"no dataset {name!r}")

    def page(self, name: str, limit: object = DEFAULT_LIMIT, offset: object = 0, filters: dict | None = None, order: list | None = None) -> DataFrame:
        """A page of rows; filters hold for table datasets only. Give a total order for stable pages."""
        df = self.frame(name)
        df = df if name in self.predefined else where_equal(df, filters)
        return (df.orderBy(*order) if order else df).offset(valid_offset(offset)).limit(valid_limit(limit))

    def count(self, name: str, filters: dict | None = None) -> int:
        df = self.frame(name)
        return (df if name in self.predefined else where_equal(df, filters)).count()

    def query(self, name: str, limit: int = DEFAULT_LIMIT, offset: int = 0, filters: dict | None = None) -> dict:
        total = self.count(name, filters)
        return {"data": self.page(name, limit, offset, filters), "total": total, "has_more": valid_offset(offset) + valid_limit(limit) < total}


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def url_details(urls: DataFrame, classifications: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each URL with how many classifications it has, its best one, and its page metadata."""
    best = classifications.groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("classifications"), F.max_by("category", F.struct("confidence", "id")).alias("best_category"), F.max("confidence").alias("best_confidence"))
    return urls.join(best, "id", "left").join(metadata.select(F.col("url_id").alias("id"), "title", "word_count"), "id", "left").withColumn("classifications", F.coalesce("classifications", F.lit(0)))


def url_records(urls: DataFrame, classifications: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each URL with all its columns, the number of its classifications and all columns of its page metadata, null where it has none. The
    classifications themselves, any number of them, are rows: see url_classifications."""
    own = [c for c in ("id", "url", "domain", "path", "status_code", "content_type", "file_extension", "last_crawled", "created_at", "updated_at") if c in urls.columns]
    page = [c for c in ("title", "description", "keywords", "language", "word_count", "has_images", "has_videos", "has_forms", "extracted_at") if c in metadata.columns]
    counts = classifications.groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("classifications"))
    joined = urls.select(*own).join(counts, "id", "left").join(metadata.select(F.col("url_id").alias("id"), *page), "id", "left")
    return joined.withColumn("classifications", F.coalesce("classifications", F.lit(0)))


def urls_where(urls: DataFrame, domain: str | None = None, status_code: int | None = None) -> DataFrame:
    """The newest URLs first, of a domain and a status where these are given."""
    found = urls
    for column, value in (("domain", domain), ("status_code", status_code)):
        found = found if value is None else found.where(F.col(column) == value)
    return found.orderBy(F.desc("last_crawled"), "id")


def url_classifications(urls: DataFrame, classifications: DataFrame) -> DataFrame:
    """Every classification of each URL, the newest first."""
    order = W.partitionBy("url_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = classifications.select("url_id", "category", "confidence", "model_version", "created_at", F.row_number().over(order).alias("rank"))
    return urls.select(F.col("id").alias("url_id"), "url").join(ranked, "url_id")


def table_statistics(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(table, rows, columns, error) of each table; one that can't be read has its error, and the others their counts."""
    rows = []
    for name, frame in tables.items():
        try:
            df = frame()
            rows.append((name, df.count(), len(df.columns), None))
        except Exception as e:  # noqa: BLE001 - whatever a table raises is its row
            rows.append((name, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "table string, rows long, columns int, error string")


def database_statistics(urls: DataFrame, classifications: DataFrame, metadata: DataFrame, sessions: DataFrame) -> DataFrame:
    one = urls.agg(F.count("id").alias("total_urls"), F.countDistinct("domain").alias("unique_domains"))
    for df, name in ((classifications, "total_classifications"), (metadata, "total_metadata"), (sessions, "total_sessions")):
        one = one.crossJoin(F.broadcast(df.agg(F.count("id").alias(name))))  # one row each
    return one


def ingested(records: DataFrame) -> DataFrame:
    """URL rows of crawl records, the first of each URL: domain is the part after //, and the path's extension as written."""
    first = records.withColumn("_rank", F.row_number().over(W.partitionBy("url").orderBy("ordinal"))).where("_rank = 1")
    bare = F.regexp_extract("url", r"^[^?#]*", 0)
    return first.select("ordinal", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("domain"), F.nullif(F.regexp_extract(bare, r"\.([a-zA-Z0-9]+)$", 1), F.lit("")).alias("file_extension"))
