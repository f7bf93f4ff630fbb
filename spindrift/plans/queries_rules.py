"""Queries with rules that are data (public suffixes, schemas of records), of batches, and of the files of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import schema, snapshots, suffixes
from spindrift.operators.graph import fresh_path
from spindrift.plans.registry import query
from spindrift.plans.views import oracle, view
from spindrift.sources import ingest

# --- public suffixes -------------------------------------------------------------------------------------------------
#: The rules as DuckDB matches them: by the end of the text, a wildcard by a pattern, and of all that match the exception or else the longest.
MATCHED = r"""
hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^https://([^/:?#]*)', 1)) AS host FROM hosted),
rules AS (SELECT DISTINCT trim(rule, '!') AS pattern, rule LIKE '!%' AS exception, len(string_split(rule, '.')) AS n FROM suffix_rules WHERE rule <> '' AND rule NOT LIKE '//%'),
found AS (SELECT h.host, arg_max(r.n - r.exception::INT, r.exception::INT * 1000 + r.n) AS taken, arg_max(CASE WHEN exception THEN '!' ELSE '' END || pattern, r.exception::INT * 1000 + r.n) AS rule FROM hosts h JOIN rules r ON
  CASE WHEN pattern LIKE '*.%' THEN regexp_full_match(h.host, '(.*[.])?[^.]+' || replace(substr(pattern, 2), '.', '[.]')) ELSE h.host = pattern OR h.host LIKE '%.' || pattern END
  WHERE NOT regexp_full_match(h.host, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') GROUP BY h.host),
split AS (SELECT host, rule, CASE WHEN address THEN '' ELSE array_to_string(l[1:len(l) - taken - 1], '.') END AS subdomain, CASE WHEN address THEN host ELSE COALESCE(l[len(l) - taken], '') END AS domain,
  CASE WHEN taken = 0 THEN '' ELSE array_to_string(l[len(l) - taken + 1:], '.') END AS suffix
  FROM (SELECT h.host, string_split(h.host, '.') AS l, COALESCE(f.taken, 0) AS taken, f.rule, regexp_full_match(h.host, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS address FROM hosts h LEFT JOIN found f ON f.host = h.host) x),
names AS (SELECT *, CASE WHEN domain <> '' AND suffix <> '' THEN domain || '.' || suffix ELSE '' END AS registered_domain,
  CASE WHEN domain <> '' AND suffix <> '' THEN concat_ws('.', NULLIF(subdomain, ''), domain, suffix) ELSE '' END AS fqdn FROM split)"""


def over_names(sql: str) -> str:
    return f"{oracle('', 'hosted', 'suffix_rules').rstrip()},{MATCHED}\n{sql}"


@query(over_names("""SELECT h.ordinal, n.host, n.subdomain, n.domain, n.suffix, n.registered_domain, n.fqdn, regexp_extract(path, '([^/]*)$', 1) AS filename, NULLIF(regexp_extract(path, '[.]([^./]*)$', 1), '') AS file_extension,
  len(string_split(path, '/')) - 1 AS path_depth, CASE WHEN url LIKE '%?%' THEN 2 ELSE 0 END AS query_param_count
  FROM (SELECT *, regexp_extract(url, '^https://[^/]*([^?]*)', 1) AS path, lower(regexp_extract(url, '^https://([^/:?#]*)', 1)) AS host FROM hosted) h JOIN names n ON n.host = h.host"""))
def url_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.components(view(spark, sf_dir, "hosted"), view(spark, sf_dir, "suffix_rules"))
    return found.select("ordinal", "host", "subdomain", "domain", "suffix", "registered_domain", "fqdn", "filename", "file_extension", "path_depth", "query_param_count")


@query(over_names("""SELECT registered_domain, suffix, MAX(rule) AS rule, SUM(urls)::BIGINT AS urls, COUNT(DISTINCT subdomain) AS subdomains FROM names JOIN
  (SELECT lower(regexp_extract(url, '^https://([^/:?#]*)', 1)) AS host, COUNT(DISTINCT url) AS urls FROM hosted GROUP BY 1) u ON u.host = names.host WHERE registered_domain <> '' GROUP BY 1, 2 ORDER BY 4 DESC, 1 LIMIT 20"""))
def sd_registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.registered_domains(view(spark, sf_dir, "hosted"), view(spark, sf_dir, "suffix_rules"))


# --- schemas of records ----------------------------------------------------------------------------------------------
def checks() -> str:
    """The record schema as DuckDB's JSON functions test it."""
    kinds = {"string": "'VARCHAR'", "number": "'BIGINT', 'UBIGINT', 'DOUBLE'", "null": "'NULL'", "array": "'ARRAY'", "object": "'OBJECT'"}
    shown = "CASE WHEN json_type(v) = 'VARCHAR' THEN '''' || (v ->> '$') || '''' ELSE v::VARCHAR END"
    field = "FROM (SELECT ordinal, j -> '{0}' AS v FROM parsed WHERE json_type(j) = 'OBJECT') x WHERE v IS NOT NULL AND "
    rows = ["SELECT ordinal + 1 AS line_number, '<line>' AS path, concat('Line ', ordinal + 1, ': Invalid JSON') AS message FROM record_lines WHERE NOT json_valid(line)"]
    rows.append(f"SELECT ordinal + 1, '<root>', {shown} || ' is not of type ''object''' FROM (SELECT ordinal, j AS v FROM parsed) x WHERE json_type(v) <> 'OBJECT'")
    rows += [f"SELECT ordinal + 1, '<root>', '''{name}'' is a required property' FROM parsed WHERE json_type(j) = 'OBJECT' AND (j -> '{name}') IS NULL" for name in schema.CRAWL_RECORD["required"]]
    for name, inner in schema.CRAWL_RECORD["properties"].items():
        types = inner["type"] if isinstance(inner["type"], list) else [inner["type"]]
        said = " is not of type " + ", ".join(f"''{t}''" for t in types)
        rows.append(f"SELECT ordinal + 1, '{name}', {shown} || '{said}' {field.format(name)} json_type(v) NOT IN ({', '.join(kinds[t] for t in types)})")
        if "minLength" in inner:
            rows.append(f"SELECT ordinal + 1, '{name}', {shown} || ' should be non-empty' {field.format(name)} json_type(v) = 'VARCHAR' AND (v ->> '$') = ''")
    return f"{oracle('', 'record_lines').rstrip()},\nparsed AS (SELECT ordinal, line::JSON AS j FROM record_lines WHERE json_valid(line))\n" + "\nUNION ALL ".join(rows)


@query(checks())
def dv_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.error_rows(view(spark, sf_dir, "record_lines"))


@query(f"SELECT path, message_kind, COUNT(*) AS errors, COUNT(DISTINCT line_number) AS lines FROM (SELECT *, regexp_replace(message, '^(.*) (is|should|does) ', '') AS message_kind FROM ({checks()}) e WHERE path <> '<line>') k GROUP BY 1, 2")
def dv_schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema.error_rows(view(spark, sf_dir, "record_lines")).where("path <> '<line>'")
    kind = F.regexp_replace("message", "^(.*) (is|should|does) ", "")
    return found.groupBy("path", kind.alias("message_kind")).agg(F.count("*").alias("errors"), F.countDistinct("line_number").alias("lines"))


# --- batches of records ----------------------------------------------------------------------------------------------
@query(oracle("""SELECT url, split_part(url, '/', 3) AS domain, path, status_code, content_type, CASE WHEN contains(regexp_extract(path, '([^/]*)$', 1), '.') THEN regexp_extract(path, '[.]([^.]*)$', 1) END AS file_extension,
  CAST(make_timestamp(CAST(discovered_at * 1000000 AS BIGINT)) AS TIMESTAMP) AS last_crawled
  FROM (SELECT *, regexp_extract(url, '^[^/]*/[^/]*/[^/]*/?(.*)$', 1) AS path, ROW_NUMBER() OVER (PARTITION BY url ORDER BY ordinal % 3, ordinal) AS r FROM crawl) x WHERE r = 1""", "crawl"))
def ds_ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl in three batches, the last first and one of them twice."""
    store = ingest.UrlStore(spark, fresh_path(spark, "urls"), 8)
    records = view(spark, sf_dir, "crawl").withColumn("crawled_at", F.col("discovered_at"))
    for part in (2, 0, 0, 1):
        store.insert(records.where(F.col("ordinal") % 3 == part), f"batch {part}")
    return store.read().withColumn("last_crawled", F.col("last_crawled").cast("timestamp_ntz"))


# --- snapshots of runs -----------------------------------------------------------------------------------------------
FOUND = """
found AS (SELECT pipeline, text::JSON AS j FROM result_files WHERE json_valid(text) AND file = CASE pipeline WHEN 'basic' THEN 'analysis_results.json' WHEN 'enhanced' THEN 'enhanced_analysis_results.json' WHEN 'mlx' THEN 'enhanced_results.json' END),
lists AS (SELECT pipeline, CASE pipeline WHEN 'basic' THEN 0 WHEN 'enhanced' THEN 1 ELSE 2 END AS position, COALESCE(j ->> '$.metadata.total_urls', j ->> '$.metadata.raw_urls', '0')::BIGINT AS total_urls,
  CASE json_type(j -> '$.insights.key_findings') WHEN 'ARRAY' THEN (j -> '$.insights.key_findings')::VARCHAR[] WHEN 'VARCHAR' THEN [j ->> '$.insights.key_findings'] ELSE [] END AS findings,
  CASE json_type(j -> '$.insights.alerts') WHEN 'ARRAY' THEN (j -> '$.insights.alerts')::VARCHAR[] WHEN 'VARCHAR' THEN [j ->> '$.insights.alerts'] ELSE [] END AS alerts, (j ->> '$.insights.scores.overall')::DOUBLE AS overall FROM found)"""


def over_found(sql: str) -> str:
    return f"{oracle('', 'result_files').rstrip()},{FOUND}\n{sql}"


@query(over_found("SELECT pipeline, total_urls, array_to_string(findings, '|') AS findings, len(alerts)::INT AS alerts, ROUND(overall, 6) AS overall FROM lists"))
def sa_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshots.extract(view(spark, sf_dir, "result_files"))
    return found.select("pipeline", "total_urls", F.array_join("key_findings", "|").alias("findings"), F.size("alerts").alias("alerts"), F.round(F.try_element_at("scores", F.lit("overall")), 6).alias("overall"))


@query(over_found("""SELECT (SELECT SUM(total_urls) FROM lists)::BIGINT AS urls, (SELECT SUM(len(alerts)) FROM lists)::BIGINT AS alerts, (SELECT string_agg(pipeline, ', ' ORDER BY position) FROM lists) AS pipelines,
  (SELECT array_to_string((list(f ORDER BY position, i))[1:6], '|') FROM (SELECT position, unnest(findings[1:2]) AS f, generate_subscripts(findings[1:2], 1) AS i FROM lists) x) AS highlights"""))
def sa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = snapshots.summary(snapshots.extract(view(spark, sf_dir, "result_files")))
    return one.select("urls", "alerts", F.array_join("pipelines", ", ").alias("pipelines"), F.array_join("highlights", "|").alias("highlights"))
