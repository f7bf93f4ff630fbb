"""Queries over crawled URLs: components, statistics, vocabulary, domains, patterns, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import urls as U
from spindrift.operators import components, domains, normalize, patterns, semantic, stats
from spindrift.plans.registry import long, query, rounded
from spindrift.plans.views import SPLIT, oracle, raw_links, view


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "crawl").withColumn("links", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).drop("html")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.features(crawl(spark, sf_dir), F.size("links"))


# --- SQL that the oracles share ------------------------------------------------------------------------------------
SEGMENTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
DEPTH = f"len({SEGMENTS})"
EXT = "CASE WHEN path LIKE '%.%' AND regexp_full_match(lower(string_split(path, '.')[-1]), '[a-z0-9]{1,10}') THEN lower(string_split(path, '.')[-1]) END"
FILE_EXT = EXT.replace("path", "string_split(path, '/')[-1]")
FEATURES = f"""feats AS (SELECT ordinal, url, COALESCE(depth, 0) AS depth, length(path) AS path_length, CASE WHEN query <> '' THEN len(string_split(query, '&')) ELSE 0 END AS query_count,
  fragment <> '' AS has_fragment, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link_count FROM parts)"""
LONG = "vals AS (SELECT ordinal, 'depth' AS feature, depth::DOUBLE AS value FROM feats UNION ALL SELECT ordinal, 'path_length', path_length FROM feats UNION ALL SELECT ordinal, 'query_count', query_count FROM feats UNION ALL SELECT ordinal, 'link_count', link_count FROM feats)"
HOST = "lower(regexp_extract(regexp_extract(netloc, '([^@]*)$', 1), '^([^:]*)', 1))"
PORT = "NULLIF(TRY_CAST(regexp_extract(netloc, ':([0-9]+)$', 1) AS INT), 0)"
USER = "NULLIF(split_part(regexp_extract(netloc, '^([^@]*)@', 1), ':', 1), '')"
LABELS = """named AS (SELECT p.*, CASE WHEN n >= 2 THEN concat(l[n - 1], '.', l[n]) ELSE netloc END AS domain, CASE WHEN n > 2 THEN array_to_string(l[1:n - 2], '.') ELSE 'root' END AS subdomain,
  CASE WHEN n >= 2 THEN l[n] ELSE '' END AS suffix FROM (SELECT *, string_split(netloc, '.') AS l, len(string_split(netloc, '.')) AS n FROM parts) p)"""


def w(sql: str, *more: str, needs: tuple[str, ...] = ("parts",)) -> str:
    """sql after the named views and further table expressions."""
    text = oracle("", *needs).rstrip()
    return f"{text}{''.join(',' + chr(10) + m for m in more)}\n{sql}"


GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


# --- URL functions -------------------------------------------------------------------------------------------------
@query(w(f"""SELECT ordinal, scheme, netloc, {HOST} AS host, {PORT} AS port, {USER} AS username, path, query, fragment, {DEPTH}::INT AS depth, {FILE_EXT} AS extension,
  (CASE WHEN query <> '' THEN len(string_split(query, '&')) ELSE 0 END)::INT AS param_count, length(url)::INT AS url_length, path IN ('', '/') AS is_root, query <> '' AS has_query, fragment <> '' AS has_fragment FROM parts"""))
def url_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = U.components(F.col("url"))
    names = ["scheme", "netloc", "host", "port", "username", "path", "query", "fragment", "depth", "extension", "param_count", "url_length", "is_root", "has_query", "has_fragment"]
    return crawl(spark, sf_dir).select("ordinal", *[c[n].alias(n) for n in names])


NORMAL_PATH = "CASE WHEN path = '' THEN '/' WHEN path <> '/' THEN regexp_replace(path, '/+$', '') ELSE path END"
PAIRS = """list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: struct_pack(k := url_decode(replace(split_part(x, '=', 1), '+', ' ')), v := url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' '))))"""
SORTED = f"""SELECT *, list_transform(list_filter(list_sort(list_transform(pairs, lambda p, i: struct_pack(k := p.k, i := i, v := p.v))), lambda p: NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','_ga','_gl','mc_cid','mc_eid','ref','source','campaign','ad_id','ad_name'], lower(p.k))), lambda p: concat(p.k, '=', p.v)) AS kept FROM (SELECT *, {PAIRS} AS pairs FROM parts) q"""


@query(w(f"SELECT ordinal, concat(scheme, '://', netloc, {NORMAL_PATH}, CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) AS normalized FROM sorted", f"sorted AS ({SORTED})"))
def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl(spark, sf_dir).select("ordinal", U.normalized_url(F.col("url")).alias("normalized"))


CLASS = "CASE WHEN regexp_full_match(fragment, '[a-zA-Z][a-zA-Z0-9_-]*') THEN 'anchor' WHEN fragment LIKE '/%' OR fragment LIKE '!%' THEN 'route' ELSE 'other' END"


@query(w(f"SELECT fragment, COUNT(*) AS count, {CLASS} AS kind FROM parts WHERE fragment <> '' GROUP BY fragment"))
def url_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.fragments(crawl(spark, sf_dir))


@query(w(f"SELECT {DEPTH}::INT AS path_depth, COUNT(*) AS count, CASE WHEN {DEPTH} <= 1 THEN 'shallow' WHEN {DEPTH} <= 4 THEN 'medium' WHEN {DEPTH} <= 7 THEN 'deep' ELSE 'very_deep' END AS level FROM parts GROUP BY ALL"))
def url_depth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.depth_distribution(crawl(spark, sf_dir))


@query(w(f"SELECT ROUND(AVG(d), 6) AS avg_depth, list_sort(list(d))[COUNT(*) // 2 + 1]::INT AS median_depth, MIN(d)::INT AS min_depth, MAX(d)::INT AS max_depth FROM (SELECT {DEPTH} AS d FROM parts) x"))
def url_depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.upper_median(crawl(spark, sf_dir), U.path_depth(F.col("url"))), "avg_depth")


# --- statistics ----------------------------------------------------------------------------------------------------
@query(w("""SELECT feature, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(MEDIAN(value), 6) AS median, ROUND(STDDEV_POP(value), 6) AS std, MIN(value) AS min, MAX(value) AS max,
  ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75 FROM vals GROUP BY feature""", FEATURES, LONG))
def st_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(feature_rows(spark, sf_dir)), "mean", "median", "std", "min", "max", "q25", "q75")


@query(w("SELECT depth, COUNT(*) AS count FROM feats GROUP BY depth", FEATURES))
def st_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(feature_rows(spark, sf_dir), "depth")


@query(w("""SELECT bin::INT AS bin, ROUND(low + (high - low) * bin / 20, 6) AS low, ROUND(low + (high - low) * (bin + 1) / 20, 6) AS high, COUNT(x) AS count
  FROM (SELECT MIN(path_length)::DOUBLE AS low, MAX(path_length)::DOUBLE AS high FROM feats) e CROSS JOIN range(20) r(bin) LEFT JOIN (SELECT path_length::DOUBLE AS x FROM feats) f
  ON LEAST(FLOOR((x - low) * 20 / (high - low)), 19) = bin GROUP BY bin, low, high""", FEATURES))
def st_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(feature_rows(spark, sf_dir), "path_length", 20), "low", "high")


PAIR_SQL = "SELECT '{0}_{1}' AS pair, COUNT(*) AS n, CASE WHEN STDDEV_POP({0}) > 0 AND STDDEV_POP({1}) > 0 THEN CORR({0}, {1}) END AS r FROM feats"
PAIRS_TESTED = [("depth", "path_length"), ("path_length", "query_count"), ("depth", "link_count")]
STRENGTH = "concat(CASE WHEN ABS(r) < 0.1 THEN 'negligible' WHEN ABS(r) < 0.3 THEN 'weak' WHEN ABS(r) < 0.5 THEN 'moderate' WHEN ABS(r) < 0.7 THEN 'strong' ELSE 'very strong' END, ' ', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, ' correlation')"


@query(w(f"SELECT pair, n, ROUND(r, 6) AS r, {STRENGTH} AS interpretation FROM ({' UNION ALL '.join(PAIR_SQL.format(*p) for p in PAIRS_TESTED)}) x", FEATURES))
def st_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlations(feature_rows(spark, sf_dir), PAIRS_TESTED), "r")


@query()
def st_correlation_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.correlations(feature_rows(spark, sf_dir), PAIRS_TESTED)
    return rounded(c.select("pair", "n", "r", stats.p_value("r", F.col("n").cast("double")).alias("p")), "r", "p")


@query()
def st_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.normality(feature_rows(spark, sf_dir), "depth"), "w", "p")


@query(w("""SELECT v.feature, COUNT(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS iqr_outliers, COUNT(CASE WHEN std > 0 AND ABS(value - mean) / std > 3 THEN 1 END) AS z_outliers, ROUND(MIN(q1 - 1.5 * (q3 - q1)), 6) AS low_fence, ROUND(MAX(q3 + 1.5 * (q3 - q1)), 6) AS high_fence
  FROM vals v JOIN (SELECT feature, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3, AVG(value) AS mean, STDDEV_POP(value) AS std FROM vals GROUP BY feature) e ON v.feature = e.feature GROUP BY v.feature""", FEATURES, LONG))
def st_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.outliers(feature_rows(spark, sf_dir)), "low_fence", "high_fence")


ENDS = "(SELECT feature, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3, AVG(value) AS mean, STDDEV_POP(value) AS std FROM vals GROUP BY feature)"


@query(w(f"""SELECT feature, ordinal, url, value, ROUND(z, 6) AS z_score FROM (
  SELECT v.feature, v.ordinal, f.url, value, CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END AS z, ROW_NUMBER() OVER (PARTITION BY v.feature ORDER BY v.ordinal) AS r
  FROM vals v JOIN {ENDS} e ON v.feature = e.feature JOIN feats f ON f.ordinal = v.ordinal WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) x WHERE r <= 10""", FEATURES, LONG))
def st_outlier_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.outlier_examples(feature_rows(spark, sf_dir)), "z_score")


@query(w("SELECT ordinal, url, link_count FROM feats WHERE link_count >= (SELECT QUANTILE_CONT(link_count, 0.95) FROM feats) ORDER BY ordinal LIMIT 10", FEATURES))
def st_hub_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hub_examples(feature_rows(spark, sf_dir))


@query(w("SELECT status_code, COUNT(*) AS count FROM crawl WHERE status_code > 0 GROUP BY status_code", needs=("crawl",)))
def st_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.status_codes(crawl(spark, sf_dir))


@query(oracle("SELECT first, last, n, last - first AS span, ROUND(n / (last - first), 6) AS rate FROM (SELECT epoch_us(MIN(ts)) / 1e6 AS first, epoch_us(MAX(ts)) / 1e6 AS last, COUNT(*) AS n FROM ticks) t", "ticks"))
def st_timeline_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.timeline_span(view(spark, sf_dir, "ticks")), "rate")


@query(w("""SELECT depth, COUNT(*) AS count, ROUND(AVG(path_length), 6) AS avg_path_length, ROUND(AVG(link_count), 6) AS avg_links, SUM(has_fragment::INT)::BIGINT AS has_fragment, SUM((query_count > 0)::INT)::BIGINT AS has_query,
  ROUND(AVG(has_fragment::INT) * 100, 6) AS fragment_pct, ROUND(AVG((query_count > 0)::INT) * 100, 6) AS query_pct FROM feats GROUP BY depth""", FEATURES))
def st_depth_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.depth_patterns(feature_rows(spark, sf_dir)), "avg_path_length", "avg_links", "fragment_pct", "query_pct")


@query(w("""SELECT d AS depth, place::INT AS place, url FROM (SELECT d, url, ROW_NUMBER() OVER (PARTITION BY d ORDER BY ordinal) AS place FROM
  (SELECT ordinal, url, CASE WHEN ordinal % 3 = 0 THEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) ELSE depth END::BIGINT AS d FROM parts) x) y WHERE place <= 5"""))
def gm_depth_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the records, without their crawl depth, fall back on the path's."""
    return stats.depth_samples(crawl(spark, sf_dir).withColumn("depth", F.when(F.col("ordinal") % 3 > 0, F.col("depth"))))



@query(w("SELECT COUNT(CASE WHEN link_count = 0 THEN 1 END) AS dead_ends, COUNT(CASE WHEN link_count >= p95 THEN 1 END) AS hubs, ROUND(MAX(p95), 6) AS p95 FROM feats, (SELECT QUANTILE_CONT(link_count, 0.95) AS p95 FROM feats) e", FEATURES))
def st_link_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.link_hubs(feature_rows(spark, sf_dir)), "p95")


HEALTH = f"""SELECT *, l * 0.3 + d * 0.4 + f * 0.3 AS o FROM (SELECT AVG(CASE WHEN length(url) BETWEEN 50 AND 100 THEN 100.0 ELSE 0 END) AS l, AVG(CASE WHEN {DEPTH} BETWEEN 2 AND 4 THEN 100.0 ELSE 0 END) AS d, 100 - AVG(CASE WHEN fragment <> '' THEN 100.0 ELSE 0 END) AS f FROM parts) x"""


@query(w(f"SELECT ROUND(l, 6) AS url_length_score, ROUND(d, 6) AS depth_score, ROUND(f, 6) AS fragment_score, ROUND(o, 6) AS overall_health, {GRADE.format('o')} AS health_grade FROM ({HEALTH}) y"))
def st_url_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.url_health(crawl(spark, sf_dir)), "url_length_score", "depth_score", "fragment_score", "overall_health")


@query(w("SELECT trim(split_part(content_type, ';', 1)) AS mime, COUNT(*) AS count FROM crawl WHERE content_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", needs=("crawl",)))
def st_mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mime_types(crawl(spark, sf_dir))


@query(w("SELECT COUNT(CASE WHEN status_code > 0 THEN 1 END) AS with_status, COUNT(CASE WHEN status_code = 200 THEN 1 END) AS ok, ROUND(COUNT(CASE WHEN status_code = 200 THEN 1 END) * 100.0 / COUNT(CASE WHEN status_code > 0 THEN 1 END), 6)::DOUBLE AS success_rate FROM crawl", needs=("crawl",)))
def st_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.success(crawl(spark, sf_dir)), "success_rate")


@query(w(f"SELECT COUNT(CASE WHEN {DEPTH} BETWEEN 2 AND 4 THEN 1 END) AS optimal, COUNT(*) AS total, ROUND(AVG(CASE WHEN {DEPTH} BETWEEN 2 AND 4 THEN 100.0 ELSE 0 END), 6) AS depth_score FROM parts"))
def gm_depth_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.depth_health(crawl(spark, sf_dir)), "depth_score")


@query(w("SELECT GREATEST(0, MAX(depth)) AS max_depth FROM crawl", needs=("crawl",)))
def gm_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.max_depth(crawl(spark, sf_dir))


# --- vocabulary ----------------------------------------------------------------------------------------------------
@query(w("""SELECT u AS unique_tokens, t AS total_tokens, ROUND(u::DOUBLE / t, 6) AS type_token_ratio, CASE WHEN u::DOUBLE / t > 0.5 THEN 'high' WHEN u::DOUBLE / t > 0.3 THEN 'medium' ELSE 'low' END AS richness
  FROM (SELECT COUNT(DISTINCT token) AS u, COUNT(*) AS t FROM tokens) x""", needs=("tokens",)))
def sp_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.vocabulary(semantic.tokenized(crawl(spark, sf_dir))), "type_token_ratio")


@query(w("SELECT token, COUNT(*) AS count FROM tokens GROUP BY token ORDER BY COUNT(*) DESC, MIN((ordinal, pos)) LIMIT 50", needs=("tokens",)))
def sp_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.top_tokens(semantic.tokenized(crawl(spark, sf_dir)))


def hits_sql(groups: dict[str, list[str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS hits FROM tokens WHERE regexp_matches(token, '{'|'.join(k)}')" for n, k in groups.items())
    return w(f"SELECT name, hits, ROUND(hits * 100.0 / SUM(hits) OVER (), 6)::DOUBLE AS percentage FROM ({parts}) x WHERE hits > 0", needs=("tokens",))


@query(hits_sql(semantic.CATEGORIES))
def sp_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.with_share(semantic.keyword_hits(semantic.tokenized(crawl(spark, sf_dir)), semantic.CATEGORIES), "hits"), "percentage")


@query(hits_sql(semantic.ACTIONS))
def sp_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.with_share(semantic.keyword_hits(semantic.tokenized(crawl(spark, sf_dir)), semantic.ACTIONS), "hits"), "percentage")


@query(f"SELECT n.name, COALESCE(h.hits, 0) AS hits FROM (VALUES ('create'), ('read'), ('update'), ('delete')) n(name) LEFT JOIN ({hits_sql(semantic.ACTIONS)}) h ON h.name = n.name")
def sp_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.crud(semantic.keyword_hits(semantic.tokenized(crawl(spark, sf_dir)), semantic.ACTIONS))


def gram_sql(n: int, top: int) -> str:
    more = "".join(f" JOIN tokens t{i} ON t{i}.ordinal = t0.ordinal AND t{i}.pos = t0.pos + {i}" for i in range(1, n))
    return w(f"SELECT concat_ws(' ', {', '.join(f't{i}.token' for i in range(n))}) AS gram, COUNT(*) AS count FROM tokens t0{more} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {top}", needs=("tokens",))


@query(gram_sql(2, 20))
def sp_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.ngrams(semantic.tokenized(crawl(spark, sf_dir)), 2, 20)


@query(gram_sql(3, 15))
def sp_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.ngrams(semantic.tokenized(crawl(spark, sf_dir)), 3, 15)


TEMPLATE = "regexp_replace(regexp_replace(regexp_replace(path, '[0-9]+', '{num}', 'g'), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{uuid}', 'gi'), '[a-z0-9]{20,}', '{id}', 'gi')"


@query(w(f"SELECT {TEMPLATE} AS template, COUNT(*) AS count FROM parts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"))
def sp_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.templates(crawl(spark, sf_dir))


PARAMS = f"params AS (SELECT ordinal, i AS pos, p.k AS key, p.v AS value FROM (SELECT ordinal, unnest(pairs) AS p, generate_subscripts(pairs, 1) AS i FROM (SELECT ordinal, {PAIRS} AS pairs FROM parts) q) r)"


@query(w("""SELECT key, value, count, rank::INT AS rank FROM (SELECT key, substr(value, 1, 100) AS value, COUNT(*) AS count, ROW_NUMBER() OVER (PARTITION BY key ORDER BY COUNT(*) DESC, substr(value, 1, 100)) AS rank FROM params
  WHERE value <> '' AND key IN (SELECT key FROM params WHERE value <> '' GROUP BY key ORDER BY MIN((ordinal, pos)) LIMIT 10) GROUP BY 1, 2) x WHERE rank <= 10""", PARAMS))
def sp_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.parameter_values(crawl(spark, sf_dir))


@query(w("""SELECT name, records, (SELECT COUNT(DISTINCT ordinal) FROM parts WHERE query <> '') AS with_query FROM (SELECT key AS name, COUNT(DISTINCT ordinal) AS records FROM params WHERE value <> '' GROUP BY key ORDER BY 2 DESC, 1 LIMIT 20) x""", PARAMS))
def sp_top_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.top_parameters(crawl(spark, sf_dir))



@query(w(f"""SELECT *, {GRADE.format("quality_score")} AS quality_grade FROM (SELECT *, ROUND(optimal_length * 30.0 / total + optimal_depth * 30.0 / total + keyword_rich * 40.0 / total, 6)::DOUBLE AS quality_score FROM (
  SELECT COUNT(*) AS total, COUNT(CASE WHEN length(url) > 100 THEN 1 END) AS too_long, COUNT(CASE WHEN length(url) < 20 THEN 1 END) AS too_short, COUNT(CASE WHEN length(url) BETWEEN 20 AND 100 THEN 1 END) AS optimal_length,
    COUNT(CASE WHEN regexp_matches(path, '[0-9]') THEN 1 END) AS has_numbers, COUNT(CASE WHEN path LIKE '%\\_%' ESCAPE '\\' THEN 1 END) AS has_underscores, COUNT(CASE WHEN regexp_matches(path, '[A-Z]') THEN 1 END) AS has_uppercase,
    COUNT(CASE WHEN {DEPTH} > 5 THEN 1 END) AS too_deep, COUNT(CASE WHEN {DEPTH} BETWEEN 2 AND 4 THEN 1 END) AS optimal_depth, (SELECT COUNT(*) FROM (SELECT ordinal FROM tokens GROUP BY ordinal HAVING COUNT(*) >= 2) k) AS keyword_rich FROM parts) a) b""", needs=("tokens",)))
def sp_url_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.url_quality(crawl(spark, sf_dir)), "quality_score")


CONTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{'|'.join(v)}') THEN '{k}'" for k, v in semantic.CONTENT_TYPES.items()) + " ELSE 'General Content' END"


@query(w(f"SELECT {CONTENT} AS content_type, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6)::DOUBLE AS percentage FROM crawl GROUP BY 1", needs=("crawl",)))
def sp_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.predicted_content(crawl(spark, sf_dir)), "percentage")


@query(w(f"""SELECT insight, found FROM (SELECT l > 100 AS too_long, c > n * 0.5 AS keyword_stuffing, t::DOUBLE / n < 0.1 AS low_diversity, t::DOUBLE / n >= 0.1 AS good_diversity FROM
  (SELECT COUNT(*) AS n, AVG(length(url)) AS l, COUNT(DISTINCT {TEMPLATE}) AS t FROM parts) a, (SELECT MAX(k) AS c FROM (SELECT COUNT(*) AS k FROM tokens GROUP BY token) z) b) x
  UNPIVOT (found FOR insight IN (too_long, keyword_stuffing, low_diversity, good_diversity))""", needs=("tokens",)))
def sp_seo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.seo_insights(crawl(spark, sf_dir))


SAID = {
    ("strengths", 0): ("token IS NOT NULL", "format('Top keyword: ''{}'' appears {} times', token, k)"), ("strengths", 1): ("t::DOUBLE / n >= 0.1", "'Good URL diversity'"),
    ("issues", 0): ("l > 100", "'URLs are too long on average. Recommend shortening.'"), ("issues", 1): ("k > n * 0.5", "'Possible keyword stuffing detected'"),
    ("issues", 2): ("t::DOUBLE / n < 0.1", "'Low URL diversity - too many similar URLs'"), ("recommendations", 0): ("l > 100", "'Keep URLs under 100 characters for better SEO'"),
}


@query(w(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {at} AS position, {message} AS message FROM measured WHERE {test}" for (kind, at), (test, message) in SAID.items()), f"""measured AS (SELECT * FROM (SELECT COUNT(*) AS n, AVG(length(url)) AS l, COUNT(DISTINCT {TEMPLATE}) AS t FROM parts) a
  LEFT JOIN (SELECT token, COUNT(*) AS k FROM tokens GROUP BY token ORDER BY 2 DESC, MIN((ordinal, pos)) LIMIT 1) b ON TRUE)""", needs=("tokens",)))
def sp_seo_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.seo_messages(crawl(spark, sf_dir))


# --- components ----------------------------------------------------------------------------------------------------
@query(w("SELECT scheme, COUNT(*) AS count, scheme = 'https' AS secure FROM parts GROUP BY scheme"))
def uc_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.schemes(crawl(spark, sf_dir))


@query(w(f"SELECT {USER} AS username, COUNT(*) AS count FROM parts WHERE {USER} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def uc_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.credentials(crawl(spark, sf_dir))


@query(w(f"""SELECT host, COUNT(*) AS count, CASE WHEN regexp_full_match(host, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') THEN 'ip' WHEN host IN ('localhost', '::1') THEN 'localhost' ELSE 'name' END AS kind
  FROM (SELECT {HOST} AS host FROM parts) x WHERE host <> '' GROUP BY host"""))
def uc_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.hosts(crawl(spark, sf_dir))


@query(w(f"SELECT port, COUNT(*) AS count, CASE port WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 8080 THEN 'HTTP Alternate' WHEN 8443 THEN 'HTTPS Alternate' WHEN 3000 THEN 'Development Server' WHEN 5000 THEN 'Development Server' WHEN 8000 THEN 'Development Server' ELSE 'Custom/Unknown' END AS purpose, port IN (80, 443) AS standard FROM (SELECT {PORT} AS port FROM parts) x WHERE port IS NOT NULL GROUP BY port"))
def uc_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.ports(crawl(spark, sf_dir))


@query(w(f"SELECT COUNT(*) AS paths, COUNT(DISTINCT path) AS unique_paths, ROUND(AVG({DEPTH}), 6) AS avg_depth, MAX({DEPTH})::INT AS max_depth, COUNT(CASE WHEN path LIKE '%/' THEN 1 END) AS trailing_slash, COUNT({EXT}) AS with_extension FROM parts WHERE path <> ''"))
def uc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components.paths(crawl(spark, sf_dir)), "avg_depth")


@query(w(f"SELECT segment, COUNT(*) AS count FROM (SELECT unnest({SEGMENTS}) AS segment FROM parts) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"))
def uc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.segments(crawl(spark, sf_dir))


EXT_CLASS = "CASE " + " ".join(f"WHEN extension IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in components.EXTENSIONS.items()) + " ELSE 'other' END"


@query(w(f"SELECT extension, COUNT(*) AS count, {EXT_CLASS} AS category FROM (SELECT {EXT} AS extension FROM parts) x WHERE extension IS NOT NULL GROUP BY extension"))
def uc_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.extensions(crawl(spark, sf_dir))


PARAM_COUNTS = "(SELECT key, value, COUNT(*) AS n, MIN(ordinal * 100000 + pos) AS place FROM params GROUP BY key, value) c"


@query(w(f"SELECT key, SUM(n)::BIGINT AS count, COUNT(*) AS unique_values, arg_max(value, (n, -place)) AS most_common_value, MAX(n) AS most_common_count FROM {PARAM_COUNTS} GROUP BY key ORDER BY 2 DESC, 1 LIMIT 30", PARAMS))
def uc_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.parameters(crawl(spark, sf_dir))


@query(w(f"SELECT key, value, rank::INT AS rank FROM (SELECT key, value, ROW_NUMBER() OVER (PARTITION BY key ORDER BY place) AS rank FROM {PARAM_COUNTS}) x WHERE rank <= 10", PARAMS))
def uc_parameter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.parameter_samples(crawl(spark, sf_dir))


@query(w("""SELECT encoding, count FROM (SELECT SUM(len(regexp_extract_all(url, '%[0-9A-Fa-f]{2}')))::BIGINT AS percent, SUM(len(regexp_extract_all(url, '[A-Za-z0-9+/]{20,}={0,2}')))::BIGINT AS base64_candidate, SUM((lower(url) LIKE '%xn--%')::INT)::BIGINT AS punycode FROM crawl) x
  UNPIVOT (count FOR encoding IN (percent, base64_candidate, punycode))""", needs=("crawl",)))
def uc_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.encodings(crawl(spark, sf_dir))


@query(w("""SELECT char, COUNT(*) AS count FROM (SELECT unnest(string_split(url, '')) AS char FROM crawl) x WHERE char <> '' AND strpos('!@#$%^&*()[]{}|\\:;"''<>?~`', char) > 0 GROUP BY char""", needs=("crawl",)))
def uc_special_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.special_characters(crawl(spark, sf_dir))


@query(w(f"""SELECT concat(scheme, '://', concat_ws('/', CASE WHEN {USER} IS NOT NULL THEN 'AUTH' END, 'HOST', CASE WHEN {PORT} IS NOT NULL THEN 'PORT' END, concat('PATH[', {DEPTH}, ']'), CASE WHEN query <> '' THEN 'QUERY' END, CASE WHEN fragment <> '' THEN 'FRAGMENT' END)) AS signature, COUNT(*) AS count
  FROM parts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def uc_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.structures(crawl(spark, sf_dir))


FINDS = {"uuid": ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", ", 0, 'i'"), "date": ("[0-9]{4}-[0-9]{2}-[0-9]{2}", ""), "date_path": ("[0-9]{4}/[0-9]{2}/[0-9]{2}", ""), "date_reversed": ("[0-9]{2}-[0-9]{2}-[0-9]{4}", ""), "id": ("\\b[0-9]{6,}\\b", "")}


@query(w("SELECT kind, COUNT(*) AS count, COUNT(DISTINCT value) AS unique_values FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(path, '{rx}'{more})) AS value FROM parts" for k, (rx, more) in FINDS.items()) + ") x GROUP BY kind"))
def uc_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.embedded(crawl(spark, sf_dir))


# --- domains -------------------------------------------------------------------------------------------------------
@query(w("SELECT domain, COUNT(*) AS urls, COUNT(DISTINCT subdomain) AS subdomains, ROUND(AVG(depth), 6) AS avg_depth, COUNT(DISTINCT scheme) AS schemes FROM named GROUP BY domain ORDER BY 2 DESC, 1 LIMIT 20", LABELS))
def sd_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domains.overview(crawl(spark, sf_dir)), "avg_depth")


FIRST = "split_part(regexp_replace(path, '^/+|/+$', '', 'g'), '/', 1)"


@query(w(f"SELECT domain, segment, count, rank::INT AS rank FROM (SELECT domain, {FIRST} AS segment, COUNT(*) AS count, ROW_NUMBER() OVER (PARTITION BY domain ORDER BY COUNT(*) DESC, {FIRST}) AS rank FROM named WHERE {FIRST} <> '' GROUP BY 1, 2) x WHERE rank <= 10", LABELS))
def sd_top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.top_segments(crawl(spark, sf_dir))


def ladder(text: str, groups: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{'|'.join(w_.replace('.', '[.]') for w_ in v)}') THEN '{k}'" for k, v in groups.items()) + f" ELSE {otherwise} END"


FULL = "concat(subdomain, '.', domain)"


@query(w(f"""SELECT f AS "full", urls, {ladder("l", domains.PURPOSES, "CASE WHEN l <> 'root' THEN 'other' END")} AS purpose, len(string_split(f, '.')) > 2 AS multi_level
  FROM (SELECT {FULL} AS f, COUNT(DISTINCT url) AS urls, lower(split_part({FULL}, '.', 1)) AS l FROM named GROUP BY 1) x""", LABELS))
def sd_subdomains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.subdomains(crawl(spark, sf_dir))


@query(w("SELECT suffix, COUNT(*) AS urls, CASE WHEN suffix IN ('com', 'net', 'org') THEN 'generic' WHEN length(suffix) = 2 THEN 'country_code' WHEN suffix IN ('edu', 'gov', 'mil') THEN 'sponsored' ELSE 'new_gtld' END AS kind FROM (SELECT DISTINCT url, suffix FROM named) x WHERE suffix <> '' GROUP BY suffix ORDER BY 2 DESC, 1 LIMIT 20", LABELS))
def sd_tlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.tlds(crawl(spark, sf_dir))


@query(w(f"""SELECT array_to_string(l[n - 1:n], '.') AS domain, CASE WHEN n > 2 THEN array_to_string(l[1:n - 2], '.') ELSE 'root' END AS subdomain, COUNT(DISTINCT url) AS urls
  FROM (SELECT url, string_split({FULL}, '.') AS l, len(string_split({FULL}, '.')) AS n FROM named) x WHERE n >= 2 GROUP BY 1, 2""", LABELS))
def sd_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.hierarchy(crawl(spark, sf_dir))


@query(w(f"""SELECT domain, subdomain, place // 50 AS block, COUNT(*)::INT AS size, array_to_string(list(url ORDER BY url), ' ') AS urls FROM
  (SELECT domain, subdomain, url, ROW_NUMBER() OVER (PARTITION BY domain, subdomain ORDER BY url) - 1 AS place FROM
    (SELECT DISTINCT array_to_string(l[n - 1:n], '.') AS domain, CASE WHEN n > 2 THEN array_to_string(l[1:n - 2], '.') ELSE 'root' END AS subdomain, url
     FROM (SELECT url, string_split({FULL}, '.') AS l, len(string_split({FULL}, '.')) AS n FROM named) x WHERE n >= 2) y) z GROUP BY 1, 2, 3""", LABELS))
def sd_hierarchy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = domains.hierarchy_urls(crawl(spark, sf_dir), 50)
    return found.select("domain", "subdomain", "block", F.size("urls").alias("size"), F.array_join("urls", " ").alias("urls"))



# --- patterns ------------------------------------------------------------------------------------------------------
YEARS, MONTHS = "regexp_extract_all(path, '/([0-9]{4})(?:/|$)', 1)", "regexp_extract_all(path, '/([0-9]{2})(?:/|$)', 1)"


@query(w(f"""SELECT kind, value, COUNT(*) AS count FROM (SELECT 'year' AS kind, y AS value FROM (SELECT unnest({YEARS}) AS y FROM parts) a WHERE y::INT BETWEEN 2000 AND 2030
  UNION ALL SELECT 'month', (m::INT)::VARCHAR FROM (SELECT unnest({MONTHS}) AS m FROM parts) b WHERE m::INT BETWEEN 1 AND 12
  UNION ALL SELECT 'year_month', concat({YEARS}[1], '-', {MONTHS}[1]) FROM parts WHERE len({YEARS}) > 0 AND len({MONTHS}) > 0) x GROUP BY 1, 2"""))
def pr_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.temporal(crawl(spark, sf_dir))


IDS = "/([0-9]+)(?:/|[.]|[?]|$)"


@query(w(f"""SELECT urls_with_ids, urls_with_uuids, total_ids, unique_ids, min_id, max_id FROM (SELECT COUNT(CASE WHEN regexp_matches(path, '{IDS}') THEN 1 END) AS urls_with_ids, COUNT(CASE WHEN regexp_matches(path, '/[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 1 END) AS urls_with_uuids FROM parts) a,
  (SELECT COUNT(*) AS total_ids, COUNT(DISTINCT i::BIGINT) AS unique_ids, MIN(i::BIGINT) AS min_id, MAX(i::BIGINT) AS max_id FROM (SELECT unnest(regexp_extract_all(path, '{IDS}', 1)) AS i FROM parts) y WHERE length(i) < 10) b"""))
def pr_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.ids(crawl(spark, sf_dir))


SHAPE = f"concat('/', array_to_string(list_transform({SEGMENTS}, lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '<NUM>' WHEN s LIKE '%.%' THEN '<FILE>' ELSE s END), '/'))"


@query(w(f"SELECT {SHAPE} AS structure, {DEPTH}::INT AS depth, COUNT(*) AS count FROM parts GROUP BY 1, 2"))
def pr_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.structures(crawl(spark, sf_dir))


@query(w(f"SELECT depth, COUNT(*) AS structures FROM (SELECT DISTINCT {SHAPE} AS s, {DEPTH}::INT AS depth FROM parts) x GROUP BY depth"))
def pr_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.variety(crawl(spark, sf_dir))


def times(c: str) -> str:
    return f"(SUM(length(path) - length(replace(path, '{c}', ''))) + 1)::BIGINT"


@query(w(f"SELECT {times('-')} AS hyphens, {times('_')} AS underscores, {times('.')} AS dots, COUNT(CASE WHEN strpos(path, '-') > 0 THEN 1 END) AS kebab_case_urls, COUNT(CASE WHEN strpos(path, '_') > 0 THEN 1 END) AS snake_case_urls FROM parts"))
def pr_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(patterns.naming(crawl(spark, sf_dir)), "hyphens", "underscores", "dots")


@query(w("SELECT prefix, COUNT(*) AS count FROM (SELECT unnest(regexp_extract_all(path, '/([a-z]{2,3})-', 1)) AS prefix FROM parts) x GROUP BY prefix ORDER BY 2 DESC, 1 LIMIT 10"))
def pr_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.prefixes(crawl(spark, sf_dir))


@query(w("SELECT extension, COUNT(*) AS count FROM (SELECT lower(regexp_extract(path, '[.]([a-zA-Z0-9]+)$', 1)) AS extension FROM parts) x WHERE extension <> '' GROUP BY extension"))
def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.files(crawl(spark, sf_dir))


@query(w(f"""SELECT l.domain, l.urls, concat('<DOMAIN>/', COALESCE(t.template, '')) AS template FROM (SELECT netloc AS domain, MIN({DEPTH}) AS length, COUNT(*) AS urls FROM parts GROUP BY netloc) l LEFT JOIN
  (SELECT domain, string_agg(cell, '/' ORDER BY pos) AS template FROM (SELECT x.domain, pos, CASE WHEN MIN(part) = MAX(part) THEN MIN(part) WHEN bool_and(regexp_full_match(part, '[0-9]+')) THEN '<NUM>' ELSE '<VAR>' END AS cell
    FROM (SELECT netloc AS domain, unnest({SEGMENTS}) AS part, generate_subscripts({SEGMENTS}, 1) AS pos FROM parts) x JOIN (SELECT netloc AS domain, MIN({DEPTH}) AS length FROM parts GROUP BY netloc) m ON m.domain = x.domain WHERE pos <= length GROUP BY x.domain, pos) c GROUP BY domain) t ON t.domain = l.domain"""))
def pr_common_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.common_template(crawl(spark, sf_dir))


# --- normalisation -------------------------------------------------------------------------------------------------
CANON = "concat(CASE WHEN scheme = '' THEN 'https' ELSE scheme END, '://', lower(netloc), CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END, CASE WHEN query <> '' THEN concat('?', query) ELSE '' END)"
RANKED = f"""ranked AS (SELECT *, {CANON} AS canonical, ((content_type IS NOT NULL)::INT, (COALESCE(title, '') <> '')::INT, len(regexp_extract_all(html, 'href="([^"]*)"', 1)), -COALESCE(depth, 999), -ordinal) AS rank FROM parts)"""


@query(w("""SELECT canonical, sha256(canonical) AS url_hash, arg_max(url, rank) AS url, arg_max(title, rank) AS title, arg_max(depth, rank) AS depth, COUNT(*) AS records, COUNT(DISTINCT url) AS variants, MIN(discovered_at) AS discovered_at,
  MIN(ordinal) AS first_ordinal, MAX((fragment <> '')::INT) AS had_fragment FROM ranked GROUP BY canonical""", RANKED))
def nz_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.merged(crawl(spark, sf_dir))


@query(w(f"""SELECT canonical, array_to_string(list_sort(list(DISTINCT link)), ' ') AS links FROM (SELECT {CANON} AS canonical, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM parts) x GROUP BY canonical"""))
def nz_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.merged_links(crawl(spark, sf_dir)).withColumn("links", F.array_join("links", " "))


@query(w("""SELECT r.canonical AS url, sha256(r.canonical) AS url_hash, b.ordinal, b.title, b.status_code, b.content_type, b.depth, r.merged_count, r.discovered_at, COALESCE(l.links, '') AS links, COALESCE(r.fragments, '') AS fragments
  FROM (SELECT canonical, arg_max(ordinal, rank) AS best, COUNT(*) AS merged_count, MIN(discovered_at) AS discovered_at, array_to_string(list_sort(list(DISTINCT NULLIF(fragment, ''))), ' ') AS fragments FROM ranked GROUP BY canonical) r
  JOIN crawl b ON b.ordinal = r.best
  LEFT JOIN (SELECT canonical, array_to_string(list_sort(list(DISTINCT link)), ' ') AS links FROM (SELECT canonical, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM ranked) u GROUP BY canonical) l ON l.canonical = r.canonical""", RANKED))
def nz_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = normalize.merged_records(crawl(spark, sf_dir))
    lists = {c: F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("links", "fragments")}
    return m.withColumns(lists).select("url", "url_hash", "ordinal", "title", "status_code", "content_type", "depth", "merged_count", "discovered_at", "links", "fragments")


@query(w(f"SELECT total, unique_urls, total - unique_urls AS removed, ROUND((total - unique_urls) * 100.0 / total, 6)::DOUBLE AS reduction_pct FROM (SELECT COUNT(*) AS total, COUNT(DISTINCT {CANON}) AS unique_urls FROM parts) x"))
def nz_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.reduction(normalize.merged(crawl(spark, sf_dir))), "reduction_pct")


DUPS = "SELECT key, COUNT(*) AS count, MIN(ordinal) AS first_ordinal FROM (SELECT ordinal, {} AS key FROM {}) x GROUP BY key HAVING COUNT(*) > 1 ORDER BY 2 DESC, 3 LIMIT 10"


@query(w(DUPS.format("url", "parts")))
def sc_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.duplicates(crawl(spark, sf_dir), "url")


@query(w(DUPS.format("concat(scheme, '://', netloc, path)", "parts")))
def sc_duplicates_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.duplicates(crawl(spark, sf_dir), "params")


@query(w("SELECT link_at, COUNT(*) AS links, COUNT(DISTINCT link) AS targets FROM (SELECT pos AS link_at, link FROM links) x GROUP BY 1", needs=("links",)))
def nw_link_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(raw_links(spark, sf_dir), "at").groupBy(F.col("at").alias("link_at")).agg(F.count("*").alias("links"), F.countDistinct("link").alias("targets"))
