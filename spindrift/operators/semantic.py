"""Path vocabulary: tokens, n-grams, categories, actions, templates, parameters, quality and content prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.functions import urls as U
from spindrift.operators.stats import grade

# Stop words, keywords of categories and actions, and path pieces of content types.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "www", "com", "org", "net", "html",
    "htm", "php", "aspx", "jsp", "default", "index", "home", "main",
    "page", "pages", "site", "sites", "web",
]
CATEGORIES = {
    "educational": ["course", "class", "student", "faculty", "academic", "education", "school", "university", "college", "learning", "study", "degree", "program", "admission"],
    "commerce": ["shop", "store", "buy", "cart", "checkout", "product", "price", "payment", "order", "purchase"],
    "content": ["blog", "article", "post", "news", "story", "press", "release", "publication"],
    "user": ["profile", "account", "user", "login", "register", "signup", "dashboard", "settings"],
    "information": ["about", "info", "contact", "faq", "help", "support", "guide", "documentation"],
    "media": ["image", "video", "gallery", "photo", "media", "download", "file"],
    "search": ["search", "find", "query", "results", "browse", "explore"],
    "community": ["forum", "community", "discussion", "comment", "social", "share"],
    "administrative": ["admin", "manage", "dashboard", "control", "settings", "config"],
    "events": ["event", "calendar", "schedule", "date", "conference", "meeting"],
}
ACTIONS = {
    "create": ["create", "new", "add", "insert", "post"],
    "read": ["view", "show", "display", "get", "fetch", "read", "list"],
    "update": ["edit", "update", "modify", "change", "revise"],
    "delete": ["delete", "remove", "destroy", "cancel"],
    "search": ["search", "find", "query", "filter", "browse"],
    "auth": ["login", "logout", "signin", "signout", "register", "signup"],
}
CONTENT_TYPES = {
    "API Endpoint": ["/api/", "/rest/", "/graphql"],
    "Blog/Article": ["/blog/", "/post/", "/article/", "/news/"],
    "Product Page": ["/product/", "/item/", "/shop/"],
    "User Profile": ["/user/", "/profile/", "/account/"],
    "Admin Page": ["/admin/", "/dashboard/", "/manage/"],
    "Search Results": ["/search", "/results", "/find"],
    "Category/Archive": ["/category/", "/tag/", "/archive/"],
    "Information Page": ["/about", "/contact", "/faq", "/help"],
}


def tokens(path: Column) -> Column:
    """Lowered pieces between / - _ and dots without stop words and numbers, cut into runs of a to z if they have any."""
    pieces = F.filter(F.split(F.lower(path), r"[/\-_.]"), lambda t: (F.char_length(t) > 1) & ~t.isin(STOP_WORDS) & ~t.rlike(r"^\d+$"))
    cut = F.flatten(F.transform(pieces, lambda t: F.when(t.rlike("[a-z]"), F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1))).otherwise(F.array(t))))
    return F.filter(cut, lambda t: ~t.isin(STOP_WORDS))


def tokenized(crawl: DataFrame) -> DataFrame:
    """(ordinal, url, tokens) with the path percent-decoded first. The path comes out of a generator, so that the plan computes it once
    and doesn't repeat it in each of the tokens' functions."""
    paths = crawl.select("ordinal", "url", F.explode(F.array(U.decoded(U.path(F.col("url"))))).alias("path"))
    return paths.select("ordinal", "url", tokens(F.col("path")).alias("tokens"))


def token_counts(t: DataFrame) -> DataFrame:
    return t.select("ordinal", F.posexplode("tokens").alias("at", "token")).groupBy("token").agg(F.count("*").alias("count"), F.min(F.struct("ordinal", "at")).alias("first"))


def vocabulary(t: DataFrame) -> DataFrame:
    one = token_counts(t).agg(F.count("*").alias("unique_tokens"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_tokens"))
    r = F.coalesce(F.try_divide(F.col("unique_tokens").cast("double"), F.col("total_tokens")), F.lit(0.0))
    return one.withColumn("type_token_ratio", r).withColumn("richness", F.when(r > 0.5, "high").when(r > 0.3, "medium").otherwise("low"))


def top_tokens(t: DataFrame, n: int = 50) -> DataFrame:
    return token_counts(t).orderBy(F.desc("count"), "first").limit(n).select("token", "count")


def keyword_hits(t: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(name, hits): tokens that contain a keyword of the group, a token once for each group."""
    hits = F.array_compact(F.array(*[F.when(F.col("token").rlike("|".join(words)), name) for name, words in groups.items()]))
    return t.select(F.explode("tokens").alias("token")).select(F.explode(hits).alias("name")).groupBy("name").agg(F.count("*").alias("hits"))


def crud(hits: DataFrame) -> DataFrame:
    """(name, hits) of the four basic actions, 0 where there is none."""
    names = hits.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("create", "read", "update", "delete")))).alias("name"))
    return names.join(hits, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"))


def with_share(counts: DataFrame, column: str) -> DataFrame:
    return counts.withColumn("percentage", F.col(column) * 100.0 / F.sum(column).over(W.partitionBy()))  # a row a group


def ngrams(t: DataFrame, n: int, top: int) -> DataFrame:
    grams = F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, n), " ")))
    return t.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "gram").limit(top)


def template(path: Column) -> Column:
    """Numbers, UUIDs and long runs replaced; as numbers go first, dates and most ids are numbers already."""
    t = F.regexp_replace(path, r"(?U)\d+", "{num}")
    t = F.regexp_replace(t, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}")
    return F.regexp_replace(t, r"(?i)[a-z0-9]{20,}", "{id}")


def templates(crawl: DataFrame, n: int = 30) -> DataFrame:
    return crawl.groupBy(template(U.path(F.col("url"))).alias("template")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "template").limit(n)


def parameter_values(crawl: DataFrame, names: int = 10, values: int = 10) -> DataFrame:
    """Of the first parameter names seen: their most frequent values (cut to 100 characters), blanks left out."""
    p = crawl.select("ordinal", F.explode(U.parameters(U.query(F.col("url")), keep_blank=False)).alias("p")).select("ordinal", "p.at", "p.key", F.substring("p.value", 1, 100).alias("value"))
    first = p.groupBy("key").agg(F.min(F.struct("ordinal", "at")).alias("first")).orderBy("first").limit(names).select("key")
    counts = p.join(F.broadcast(first), "key", "left_semi").groupBy("key", "value").agg(F.count("*").alias("count"))  # first: names rows
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= values)


def top_parameters(crawl: DataFrame, n: int = 20) -> DataFrame:
    """The n parameter names on most records, a name once a record, blank values left out; with the number of records that have a query."""
    q = U.query(F.col("url"))
    names = crawl.where(q != "").select(F.array_distinct(F.transform(U.parameters(q, keep_blank=False), lambda p: p["key"])).alias("names"))
    counts = names.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "name").limit(n)
    return counts.crossJoin(F.broadcast(names.agg(F.count("*").alias("with_query"))))  # one row


def url_quality(crawl: DataFrame) -> DataFrame:
    """Counts of length, depth, character and keyword properties, the score from three of them, and its grade."""
    u, n = F.col("url"), F.char_length("url")
    p, d = U.path(u), U.path_depth(u)
    one = crawl.agg(
        F.count("*").alias("total"), F.count_if(n > 100).alias("too_long"), F.count_if(n < 20).alias("too_short"), F.count_if(n.between(20, 100)).alias("optimal_length"), F.count_if(p.rlike(r"(?U)\d")).alias("has_numbers"),
        F.count_if(p.contains("_")).alias("has_underscores"), F.count_if(p.rlike("[A-Z]")).alias("has_uppercase"), F.count_if(d > 5).alias("too_deep"), F.count_if(d.between(2, 4)).alias("optimal_depth"), F.count_if(F.size(tokens(p)) >= 2).alias("keyword_rich"),
    )
    part = lambda c, w: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total")), F.lit(0.0)) * w
    one = one.withColumn("quality_score", part("optimal_length", 30) + part("optimal_depth", 30) + part("keyword_rich", 40))
    return one.withColumn("quality_grade", grade(F.col("quality_score")))


def content_type(url: Column) -> Column:
    low, out = F.lower(url), None
    for name, pieces in CONTENT_TYPES.items():
        hit = low.rlike("|".join(pieces))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("General Content")


def predicted_content(crawl: DataFrame) -> DataFrame:
    return with_share(crawl.groupBy(content_type(F.col("url")).alias("content_type")).agg(F.count("*").alias("count")), "count")


def seo_messages(crawl: DataFrame) -> DataFrame:
    """(kind, position, message) of the findings as texts: strengths, issues and recommendations in their order."""
    t = tokenized(crawl)
    top = t.select("ordinal", F.posexplode("tokens").alias("at", "token")).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "at")).alias("first"))
    best = top.agg(F.min_by(F.struct("token", "n"), F.struct(-F.col("n"), F.col("first"))).alias("best"))
    one = crawl.agg(F.count("*").alias("urls"), F.coalesce(F.avg(F.char_length("url")), F.lit(0.0)).alias("avg_length"), F.countDistinct(template(U.path(F.col("url")))).alias("templates")).crossJoin(F.broadcast(best))  # one row each
    long = F.col("avg_length") > 100
    diverse = F.coalesce(F.try_divide(F.col("templates").cast("double"), F.col("urls")), F.lit(0.0)) >= 0.1
    said = {
        "strengths": [(F.col("best").isNotNull(), F.format_string("Top keyword: '%s' appears %d times", F.col("best.token"), F.col("best.n"))), (diverse, F.lit("Good URL diversity"))],
        "issues": [(long, F.lit("URLs are too long on average. Recommend shortening.")), (F.col("best.n") > F.col("urls") * 0.5, F.lit("Possible keyword stuffing detected")), (~diverse, F.lit("Low URL diversity - too many similar URLs"))],
        "recommendations": [(long, F.lit("Keep URLs under 100 characters for better SEO"))],
    }
    rows = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("position"), message.alias("message"))) for kind, some in said.items() for k, (test, message) in enumerate(some)]
    return one.select(F.inline(F.array_compact(F.array(*rows))))


def seo_insights(crawl: DataFrame) -> DataFrame:
    """(kind, flag): which findings about length, keyword stuffing and diversity hold."""
    t = tokenized(crawl)
    most = token_counts(t).agg(F.coalesce(F.max("count"), F.lit(0)).alias("top_count"))
    one = crawl.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.char_length("url")), F.lit(0.0)).alias("avg_length"), F.countDistinct(template(U.path(F.col("url")))).alias("templates"))
    both = one.crossJoin(F.broadcast(most))  # one row each
    diversity = F.coalesce(F.try_divide(F.col("templates").cast("double"), F.col("n")), F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("too_long").alias("insight"), (F.col("avg_length") > 100).alias("found")),
        F.struct(F.lit("keyword_stuffing").alias("insight"), (F.col("top_count") > F.col("n") * 0.5).alias("found")),
        F.struct(F.lit("low_diversity").alias("insight"), (diversity < 0.1).alias("found")),
        F.struct(F.lit("good_diversity").alias("insight"), (diversity >= 0.1).alias("found")),
    )
    return both.select(F.inline(rows))
