"""One report of all results: a JSON document whose rows executors write, section after section, and which one rename makes visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_lines(results: dict[str, DataFrame]) -> DataFrame:
    """(section, line) of the rows of all results, in any order within a section: each line is {"section": name, "row": {...}}."""
    out = None
    for k, (name, df) in enumerate(results.items()):
        row = F.to_json(F.struct(F.lit(name).alias("section"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), {"ignoreNullFields": "false"})
        part = df.select(F.lit(k).alias("section"), row.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(results: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """Write {"metadata": ..., "sections": [names], "results": [rows]} to the file path, replacing what is there, sections in the order of results and
    rows in the order of their text. Executors write sorted ranges of rows as text files beside path; the driver copies the files' bytes one
    after the other into one, and renames that. It holds no rows. results isn't empty."""
    spark = next(iter(results.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    beside = f"{path}.parts-{uuid.uuid4().hex}"
    lines = report_lines(results)
    order = [F.col("section"), F.col("line")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat(F.lit(","), "line")).write.text(beside)
    Path = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fs = Path(path).getFileSystem(conf)
    head = {"metadata": metadata or {}, "sections": list(results)}
    whole = Path(f"{beside}/_whole")
    out = fs.create(whole, True)
    try:
        out.write(bytearray((json.dumps(head)[:-1] + ', "results": [null\n').encode()))
        for status in sorted(fs.globStatus(Path(f"{beside}/part-*")), key=lambda s: s.getPath().getName()):
            part = fs.open(status.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.write(bytearray(b"]}\n"))
    finally:
        out.close()
    fs.delete(Path(path), True)
    fs.rename(whole, Path(path))
    fs.delete(Path(beside), True)


def read_report(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Each result of a report, by its schema. A row is a line, so that a report is read in splits."""
    lines = spark.read.text(path).where(F.col("value").startswith(',{"section":')).select(F.substring("value", 2, 2147483647).alias("line"))
    section = F.get_json_object("line", "$.section")
    return {name: lines.where(section == name).select(F.from_json("line", f"section STRING, row STRUCT<{schema}>").alias("r")).select("r.row.*") for name, schema in schemas.items()}
