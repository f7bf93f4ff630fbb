"""Incremental ingest of crawl records into a table of URLs that lies in key buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "url STRING, domain STRING, path STRING, status_code INT, content_type STRING, file_extension STRING, last_crawled TIMESTAMP"


def url_row(url: Column) -> dict[str, Column]:
    """The parts of a URL that its row has: what lies between slashes, and the last dot-piece of the last of them, as written."""
    parts = F.split(url, "/")
    whole = url.contains("//")
    path = F.when(whole, F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/"))
    last = F.element_at(F.split(path, "/"), -1)
    return {"domain": F.when(whole, F.get(parts, F.lit(2))), "path": path, "file_extension": F.when(last.contains("."), F.element_at(F.split(last, r"\."), -1))}


class UrlStore:
    """Rows by URL, appended batch by batch under path/batch=.../bucket=.... Of records of one URL that of the least (source, ordinal) counts,
    whichever came first: a batch appends the records that aren't stored and those that precede what is stored, so that repeating it appends
    nothing, and the order of batches, or two at once, doesn't change what is read. A batch is seen whole or not at all: it is
    written beside the table and renamed into it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _hadoop(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stored(self) -> DataFrame:
        """Every appended row, with its bucket and rank."""
        schema = f"{COLUMNS}, rank STRUCT<source: STRING, ordinal: BIGINT>, batch STRING, bucket INT"
        root, fs = self._hadoop(f"{self.path}/batch=*")
        if not fs.globStatus(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        """The table: a row a URL."""
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        best = self.stored().groupBy("bucket", "url").agg(F.min_by(F.struct(*names[1:]), "rank").alias("best"))
        return best.select("url", "best.*")

    def insert(self, records: DataFrame, source: str) -> None:
        """Append records(ordinal, url, and any of status_code, content_type, crawled_at in seconds) of a source; those without a URL are left out."""
        own = lambda name, kind: (F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name)
        rows = records.where("coalesce(url, '') <> ''").select("url", own("status_code", "int"), own("content_type", "string"), F.timestamp_seconds(own("crawled_at", "double")).alias("last_crawled"), F.struct(F.lit(source).alias("source"), F.col("ordinal").cast("long").alias("ordinal")).alias("rank"))
        first = rows.groupBy("url").agg(F.min_by(F.struct("status_code", "content_type", "last_crawled", "rank"), "rank").alias("r")).select("url", "r.*")
        parts = url_row(F.col("url"))
        new = first.select("url", parts["domain"].alias("domain"), parts["path"].alias("path"), "status_code", "content_type", parts["file_extension"].alias("file_extension"), "last_crawled", "rank", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int").alias("bucket"))
        there = self.stored().select(F.col("bucket").alias("b"), F.col("url").alias("u"), F.col("rank").alias("r"))
        fresh = new.join(there, (F.col("bucket") == F.col("b")) & (F.col("url") == F.col("u")) & (F.col("r") <= F.col("rank")), "left_anti")
        name = uuid.uuid4().hex
        beside, target = f"{self.path}/_staging/{name}", f"{self.path}/batch={name}"
        fresh.repartition("bucket").write.partitionBy("bucket").parquet(beside)
        self._commit(beside, target)

    def _commit(self, beside: str, target: str) -> None:
        source, fs = self._hadoop(beside)
        goal, _ = self._hadoop(target)
        if fs.globStatus(self._hadoop(f"{beside}/bucket=*")[0]):
            fs.delete(self._hadoop(f"{beside}/_SUCCESS")[0], False)
            if not fs.rename(source, goal):
                raise OSError(f"{beside} couldn't be renamed")
        else:
            fs.delete(source, True)  # nothing new
