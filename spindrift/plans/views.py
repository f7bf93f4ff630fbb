"""The crawl model over the driver's tables, as SQL text that Spark and DuckDB both run.

crawl: the pages with variants that carry credentials, ports, parameters, fragments and duplicates.
site, site_links: a link graph of shop pages. ticks: event times. The rest are the relational tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators.graph import numbered
from spindrift.operators.semantic import STOP_WORDS

SPLIT = "^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"

CRAWL = f"""
SELECT ordinal, page_id, url, CAST(page_id % 4 AS INT) AS depth, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('https://www.example.com/blog/', page_id % 9) END AS parent_url,
  CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 301 WHEN page_id % 10 = 2 THEN 500 WHEN page_id % 10 = 3 THEN NULL ELSE 200 END AS status_code,
  CASE WHEN page_id % 7 = 0 THEN 'application/pdf' WHEN page_id % 7 = 1 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
  CAST(1704067200 + page_id * 60 AS DOUBLE) AS discovered_at, CAST((page_id * 37) % 900 AS DOUBLE) AS response_time_ms, html
FROM (
  SELECT page_id * 4 AS ordinal, page_id, url, html FROM pages
  UNION ALL SELECT page_id * 4 + 1, page_id, concat('HTTPS://user', page_id % 5, ':pw@WWW.', regexp_extract(url, '{SPLIT}', 2), ':8443/Blog/2024/0', 1 + page_id % 9, '/new-product_', 100000 + page_id, '.HTML?q=a%20b&utm_source=x&id=', page_id % 7, '&b=#Sec-', page_id % 4), html FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 4 + 2, page_id, concat(regexp_extract(url, '^([^#]*)', 1), '#/route/', page_id % 3), html FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id * 4 + 3, page_id, url, html FROM pages WHERE page_id % 5 = 0
) v"""

PAGE = f"""
SELECT page_id AS ordinal, url,
  CAST(NULLIF(regexp_extract(url, '{SPLIT}', 2), '') AS VARCHAR(255)) AS domain,
  regexp_extract(url, '{SPLIT}', 3) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 301 WHEN page_id % 10 = 2 THEN 500 WHEN page_id % 10 = 3 THEN NULL ELSE 200 END AS status_code,
  CASE WHEN page_id % 7 = 0 THEN 'application/pdf' WHEN page_id % 7 = 1 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type
FROM pages"""

URLS = """
SELECT ordinal AS id, url, domain, path, TIMESTAMP '2024-01-01 00:00:00' + ordinal * INTERVAL '1' MINUTE AS last_crawled, status_code, content_type,
  NULLIF(regexp_extract(path, '[.]([a-zA-Z0-9]+)$', 1), '') AS file_extension
FROM page"""

# A tenth of the parts, and their links, are left out: links to them model pages that were not crawled.
NODES = """
  SELECT concat('https://shop.example.com/nation/', n_nationkey) AS url, CAST(NULL AS VARCHAR(99)) AS parent_url, 0 AS depth FROM nation
  UNION ALL SELECT concat('https://shop.example.com/customer/', c_custkey), concat('https://shop.example.com/nation/', c_nationkey), 1 FROM customer
  UNION ALL SELECT concat('https://shop.example.com/supplier/', s_suppkey), concat('https://shop.example.com/nation/', s_nationkey), 1 FROM supplier
  UNION ALL SELECT concat('https://shop.example.com/order/', o_orderkey), concat('https://shop.example.com/customer/', o_custkey), 2 FROM orders
  UNION ALL SELECT concat('https://shop.example.com/part/', p_partkey), NULL, 3 FROM part WHERE p_partkey % 10 <> 0"""

SITE = f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY url) - 1 AS BIGINT) AS ordinal, url, parent_url, depth FROM ({NODES}
) n"""

SITE_LINKS = """
SELECT concat('https://shop.example.com/order/', l_orderkey) AS src, concat('/part/', l_partkey) AS link FROM lineitem
UNION ALL SELECT DISTINCT concat('https://shop.example.com/part/', l_partkey), concat('/supplier/', l_suppkey) FROM lineitem WHERE l_partkey % 10 <> 0
UNION ALL SELECT concat('https://shop.example.com/order/', o_orderkey), concat('https://shop.example.com/customer/', o_custkey) FROM orders
UNION ALL SELECT concat('https://shop.example.com/customer/', o_custkey), concat('/order/', o_orderkey) FROM orders
UNION ALL SELECT concat('https://shop.example.com/supplier/', s_suppkey), concat('//shop.example.com/nation/', s_nationkey) FROM supplier
UNION ALL SELECT concat('https://shop.example.com/customer/', c_custkey), concat('https://cdn.example.net/', lower(c_mktsegment)) FROM customer
UNION ALL SELECT concat('https://shop.example.com/order/', o_orderkey), '#top' FROM orders WHERE o_orderstatus = 'F'"""

TICKS = """
SELECT event_id AS ordinal, ts, user_id, CAST(event_id % 4 AS INT) AS depth, concat('https://app.example.com/', event_type, '/', user_id) AS url,
  concat('https://app.example.com/', event_type) AS parent_url FROM events"""

CLASSIFICATIONS = """
SELECT doc_id AS id, CAST(doc_id % 60 AS BIGINT) AS url_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category,
  CAST((doc_id % 100) / 100.0 AS DOUBLE) AS confidence, 'v1' AS model_version, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at FROM labels"""

PAGE_METADATA = """
SELECT ordinal AS id, ordinal AS url_id, title, CAST(NULL AS VARCHAR(99)) AS description, 'en' AS language, CAST(length(title) AS INT) AS word_count,
  ordinal % 2 = 0 AS has_images, ordinal % 3 = 0 AS has_videos, ordinal % 5 = 0 AS has_forms, TIMESTAMP '2024-01-01 00:00:00' + ordinal * INTERVAL '1' MINUTE AS extracted_at FROM page"""

PATTERNS = """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY event_type) AS BIGINT) AS id, 'event' AS pattern_type, event_type AS pattern_value, COUNT(*) AS frequency, CAST(0.9 AS DOUBLE) AS confidence, MIN(ts) AS discovered_at
FROM events GROUP BY event_type"""

CRAWL_SESSIONS = """
SELECT user_id AS id, concat('s', user_id) AS session_id, COUNT(*) AS total_urls, COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS processed_urls,
  COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS failed_urls, MIN(ts) AS started_at, MAX(ts) AS completed_at, CASE WHEN user_id % 3 = 0 THEN 'processing' ELSE 'completed' END AS status
FROM events GROUP BY user_id"""

# Hosts under the rules below: plain ones, under a wildcard, under its exception, without a rule, and addresses.
HOSTED = """
SELECT c_custkey AS ordinal, concat('https://', CASE c_custkey % 6 WHEN 0 THEN concat('shop', c_custkey % 9, '.n', c_nationkey) WHEN 1 THEN concat('www.Shop', c_custkey % 9, '.co.n', c_nationkey)
    WHEN 2 THEN concat('a.b', c_custkey % 5, '.city', c_custkey % 4, '.gov.n', c_nationkey) WHEN 3 THEN concat('x', c_custkey % 3, '.www.gov.n', c_nationkey) WHEN 4 THEN concat('deep', c_custkey % 7, '.unknown', c_nationkey)
    ELSE concat('10.0.', c_nationkey, '.', c_custkey % 200) END,
  CASE WHEN c_custkey % 5 = 0 THEN ':8080' ELSE '' END, '/p/', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '.tar.Gz' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN '?x=1&y=&x=2&z=3' ELSE '' END) AS url FROM customer"""

SUFFIX_RULES = """
SELECT concat('n', n_nationkey) AS rule FROM nation UNION ALL SELECT concat('co.n', n_nationkey) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('*.gov.n', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT concat('!www.gov.n', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT concat('// ', n_name) FROM nation UNION ALL SELECT '' FROM nation"""

# Lines of a crawl's file, most of them with a fault.
RECORD_LINES = """
SELECT page_id AS ordinal, CASE page_id % 10
  WHEN 1 THEN concat('{"url":"","depth":', page_id % 4, ',"status_code":200,"content_type":"text/html","links":[]}')
  WHEN 2 THEN concat('{"url":"', url, '","status_code":"ok","content_type":null,"links":["/a"]}')
  WHEN 3 THEN concat('{"url":"', url, '","depth":"two","status_code":null,"content_type":7,"links":null}')
  WHEN 4 THEN concat('{"url":', page_id, ',"depth":1.5,"status_code":true,"content_type":"text/html","links":{},"title":["a"],"fragments":"f"}')
  WHEN 5 THEN concat('{"url":"', url, '", broken')
  WHEN 6 THEN concat('"', url, '"')
  WHEN 7 THEN '{}'
  ELSE concat('{"url":"', url, '","depth":', page_id % 4, ',"status_code":200,"content_type":"text/html","links":["/a","/b"],"discovered_at":"now","extra":1}') END AS line FROM pages"""

# Result files of runs, each of another shape: lists, a single text, a missing part, a file of another name, and one that isn't JSON.
RESULT_FILES = """
SELECT 'basic' AS pipeline, 'analysis_results.json' AS file, concat('{"metadata":{"total_urls":', COUNT(*), '},"insights":{"key_findings":["', MIN(url), '","', MAX(url), '","third"],"alerts":["one","two"],"scores":{"overall":', COUNT(*) % 97, '.5,"name":"x"}}}') AS text FROM pages
UNION ALL SELECT 'enhanced', 'enhanced_analysis_results.json', concat('{"metadata":{"raw_urls":', COUNT(*), '},"insights":{"key_findings":"', MIN(c_name), '","scores":[1,2]},"network":{"nodes":', COUNT(*), '}}') FROM customer
UNION ALL SELECT 'mlx', 'enhanced_results.json', concat('{"metadata":{},"insights":{"alerts":["', MIN(n_name), '"],"key_findings":["', MIN(n_name), '","', MAX(n_name), '"]}}') FROM nation
UNION ALL SELECT 'mlx', 'results.json', '{"metadata":{"total_urls":1000000}}' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'basic', 'broken.json', '{' FROM region WHERE r_regionkey = 0"""

VIEWS = {
    "result_files": (RESULT_FILES, ["pages", "customer", "nation", "region"], []),
    "hosted": (HOSTED, ["customer"], []), "suffix_rules": (SUFFIX_RULES, ["nation"], []), "record_lines": (RECORD_LINES, ["pages"], []),
    "crawl": (CRAWL, ["pages"], []), "page": (PAGE, ["pages"], []), "urls": (URLS, [], ["page"]), "site": (SITE, ["nation", "customer", "supplier", "orders", "part"], []), "nodes": (NODES, ["nation", "customer", "supplier", "orders", "part"], []),
    "site_links": (SITE_LINKS, ["lineitem", "orders", "supplier", "customer"], []), "ticks": (TICKS, ["events"], []), "classifications": (CLASSIFICATIONS, ["labels"], []),
    "page_metadata": (PAGE_METADATA, [], ["page"]), "patterns": (PATTERNS, ["events"], []), "crawl_sessions": (CRAWL_SESSIONS, ["events"], []),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model over the tables in sf_dir."""
    text, tables, others = VIEWS[name]
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in others:
        view(spark, sf_dir, v).createOrReplaceTempView(v)
    if name == "site":  # the same ordinals, without one task for all rows
        return numbered(spark.sql(NODES), "url")
    return spark.sql(text)


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, at, src, link) of the crawl's pages."""
    from pyspark.sql import functions as F

    return view(spark, sf_dir, "crawl").select("ordinal", F.col("url").alias("src"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "link"))


# --- the same for DuckDB, and what its queries share ---------------------------------------------------------------

PARTS = f"""
SELECT c.*, lower(regexp_extract(url, '{SPLIT}', 1)) AS scheme, regexp_extract(url, '{SPLIT}', 2) AS netloc, regexp_replace(regexp_extract(url, '{SPLIT}', 3), ';[^/]*$', '') AS path,
  regexp_extract(url, '{SPLIT}', 4) AS query, regexp_extract(url, '{SPLIT}', 5) AS fragment FROM crawl c"""

LINKS = """SELECT ordinal, url AS src, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM crawl"""

EDGES = """
SELECT DISTINCT src, dst FROM (SELECT src, CASE WHEN link LIKE '#%' THEN NULL WHEN link LIKE '//%' THEN concat('https:', link) WHEN link LIKE '/%' THEN concat('https://shop.example.com', link) ELSE link END AS dst FROM site_links) l
WHERE dst LIKE 'https://shop.example.com/%'"""

DEGREES = """
SELECT s.ordinal, s.url, s.depth, s.parent_url, COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) AS in_degree FROM site s
LEFT JOIN (SELECT src, COUNT(*) AS n FROM edges GROUP BY src) o ON o.src = s.url LEFT JOIN (SELECT dst, COUNT(*) AS n FROM edges GROUP BY dst) i ON i.dst = s.url"""

CHILDREN = """SELECT parent_url AS url, COUNT(*) AS n FROM site WHERE parent_url IS NOT NULL AND parent_url <> '' AND parent_url <> url GROUP BY parent_url"""

TOKENS = """
SELECT ordinal, url, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM (
  SELECT ordinal, url, list_filter(flatten(list_transform(list_filter(regexp_split_to_array(lower(path), '[-/_.]'), lambda t: t <> '' AND length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains(stop, t)),
    lambda t: CASE WHEN regexp_matches(t, '[a-z]') THEN regexp_extract_all(t, '([a-z]+)', 1) ELSE [t] END)), lambda t: NOT list_contains(stop, t)) AS tokens
  FROM parts, (SELECT [{stop}] AS stop) s) t""".replace("{stop}", ",".join(f"'{t}'" for t in STOP_WORDS))

NEEDS = {"parts": (PARTS, ["crawl"]), "links": (LINKS, ["crawl"]), "edges": (EDGES, ["site_links"]), "degrees": (DEGREES, ["site", "edges"]), "children": (CHILDREN, ["site"]), "tokens": (TOKENS, ["parts"])}


def oracle(sql: str, *names: str) -> str:
    """sql with the named views before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name][1] if name in NEEDS else VIEWS[name][2]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    text = ",\n".join(f"{n} AS ({(NEEDS[n] if n in NEEDS else VIEWS[n])[0]})" for n in order)
    return f"WITH {text}\n{sql}"
