"""The time-window clusters over a stream: an extension of the batch query with a watermark for late records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators.stats import temporal_clusters


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_clusters(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Clusters of a stream of (ts, depth, parent_url); a window is out when the watermark passes it (append mode)."""
    return temporal_clusters(ticks.withWatermark("ts", late))
