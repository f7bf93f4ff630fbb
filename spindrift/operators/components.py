"""URL components: schemes, credentials, hosts, ports, paths, extensions, parameters, fragments, encodings, structures."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.functions import urls as U

# Well-known ports and categories of file extensions.
WELL_KNOWN_PORTS = {80: "HTTP", 443: "HTTPS", 8080: "HTTP Alternate", 8443: "HTTPS Alternate", 3000: "Development Server", 5000: "Development Server", 8000: "Development Server"}
EXTENSIONS = {
    "web": ["html", "htm", "php", "asp", "aspx", "jsp", "xhtml"],
    "style": ["css", "scss", "sass", "less"],
    "script": ["js", "ts", "jsx", "tsx", "mjs"],
    "document": ["pdf", "doc", "docx", "txt", "rtf", "odt"],
    "image": ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico"],
    "video": ["mp4", "avi", "mov", "wmv", "flv", "webm"],
    "audio": ["mp3", "wav", "ogg", "flac", "aac"],
    "archive": ["zip", "rar", "tar", "gz", "7z"],
    "data": ["json", "xml", "csv", "yaml", "yml"],
    "font": ["ttf", "woff", "woff2", "eot", "otf"],
}
SPECIAL = "!@#$%^&*()[]{}|\\:;\"'<>?~`"

u = lambda: F.col("url")


def counted(crawl: DataFrame, value: Column, name: str, n: int | None = None) -> DataFrame:
    out = crawl.where(value.isNotNull()).groupBy(value.alias(name)).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), name).limit(n) if n else out


def schemes(crawl: DataFrame) -> DataFrame:
    s = U.part(crawl, "scheme")
    return crawl.groupBy(s.alias("scheme")).agg(F.count("*").alias("count")).withColumn("secure", F.col("scheme") == "https")


def credentials(crawl: DataFrame, n: int = 20) -> DataFrame:
    return counted(crawl, F.nullif(U.part(crawl, "username"), F.lit("")), "username", n)


def hosts(crawl: DataFrame) -> DataFrame:
    """Distinct hosts by kind; an address in numbers is an IP even if it is the local one."""
    h = F.col("host")
    kind = F.when(h.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip").when(h.rlike(r"^(localhost|::1)$"), "localhost").otherwise("name")
    return counted(crawl, F.nullif(U.part(crawl, "host"), F.lit("")), "host").withColumn("kind", kind)


def ports(crawl: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for x in chain(*WELL_KNOWN_PORTS.items())])
    return counted(crawl, F.nullif(U.part(crawl, "port"), F.lit(0)), "port").withColumn("purpose", F.coalesce(F.try_element_at(known, F.col("port")), F.lit("Custom/Unknown"))).withColumn("standard", F.col("port").isin(80, 443))


def paths(crawl: DataFrame) -> DataFrame:
    """Of non-empty paths: how many, their average depth, how many end with a slash or are files."""
    p = U.part(crawl, "path")
    d = F.size(U.segments(p))
    return crawl.where(p != "").agg(F.count("*").alias("paths"), F.countDistinct(p).alias("unique_paths"), F.avg(d).alias("avg_depth"), F.max(d).alias("max_depth"), F.count_if(p.endswith("/")).alias("trailing_slash"), F.count_if(U.extension_of_path(p).isNotNull()).alias("with_extension"))


def segments(crawl: DataFrame, n: int = 30) -> DataFrame:
    return counted(crawl.select(F.explode(U.segments(U.part(crawl, "path"))).alias("segment")), F.col("segment"), "segment", n)


def extension_category(ext: Column) -> Column:
    out = None
    for name, some in EXTENSIONS.items():
        out = F.when(ext.isin(some), name) if out is None else out.when(ext.isin(some), name)
    return out.otherwise("other")


def extensions(crawl: DataFrame) -> DataFrame:
    return counted(crawl, U.extension_of_path(U.part(crawl, "path")), "extension").withColumn("category", extension_category(F.col("extension")))


def parameter_counts(crawl: DataFrame) -> DataFrame:
    """(key, value, n, first): each value's count and first place."""
    p = crawl.where(U.part(crawl, "query") != "").select("ordinal", F.explode(U.parameters(U.part(crawl, "query"))).alias("p"))
    return p.groupBy("p.key", "p.value").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", F.col("p.at").alias("at"))).alias("first"))


def parameters(crawl: DataFrame, n: int = 30) -> DataFrame:
    """Each key's uses and values, and its most common value, of equal counts the first."""
    rank = F.struct("n", -F.col("first.ordinal"), -F.col("first.at"))
    return parameter_counts(crawl).groupBy("key").agg(F.sum("n").alias("count"), F.count("*").alias("unique_values"), F.max_by("value", rank).alias("most_common_value"), F.max("n").alias("most_common_count")).orderBy(F.desc("count"), "key").limit(n)


def parameter_samples(crawl: DataFrame, n: int = 10) -> DataFrame:
    """The first n values of each key, in order of their first use."""
    rank = F.row_number().over(W.partitionBy("key").orderBy("first"))
    return parameter_counts(crawl).select("key", "value", rank.alias("rank")).where(F.col("rank") <= n)


def fragments(crawl: DataFrame) -> DataFrame:
    """Distinct decoded fragments with their counts and class; each is decoded once."""
    raw = counted(crawl, F.nullif(U.part(crawl, "fragment"), F.lit("")), "raw")
    decoded = raw.groupBy(U.decoded(F.col("raw")).alias("fragment")).agg(F.sum("count").alias("count"))
    return decoded.withColumn("kind", U.fragment_class(F.col("fragment")))


def encodings(crawl: DataFrame) -> DataFrame:
    times = lambda rx: F.regexp_count(u(), F.lit(rx))
    one = crawl.agg(F.sum(times("%[0-9A-Fa-f]{2}")).alias("percent"), F.sum(times("[A-Za-z0-9+/]{20,}={0,2}")).alias("base64_candidate"), F.sum(F.lower(u()).contains("xn--").cast("int")).alias("punycode"))
    return one.unpivot([], ["percent", "base64_candidate", "punycode"], "encoding", "count")


def special_characters(crawl: DataFrame) -> DataFrame:
    chars = F.regexp_extract_all(u(), F.lit("[" + re.escape(SPECIAL) + "]"), F.lit(0))
    return crawl.select(F.explode(chars).alias("char")).groupBy("char").agg(F.count("*").alias("count"))


def structures(crawl: DataFrame, n: int = 20) -> DataFrame:
    """Signatures such as https://HOST/PATH[3]/QUERY."""
    some = lambda c, name: F.when(c, name)
    sig = F.concat(U.part(crawl, "scheme"), F.lit("://"), F.concat_ws("/", some(F.coalesce(U.part(crawl, "username"), F.lit("")) != "", "AUTH"), F.lit("HOST"), some(F.coalesce(U.part(crawl, "port"), F.lit(0)) != 0, "PORT"), F.concat(F.lit("PATH["), F.size(U.segments(U.part(crawl, "path"))).cast("string"), F.lit("]")), some(U.part(crawl, "query") != "", "QUERY"), some(U.part(crawl, "fragment") != "", "FRAGMENT")))
    return counted(crawl, sig, "signature", n)


def embedded(crawl: DataFrame) -> DataFrame:
    """Counts of UUIDs, of three forms of dates, each tried on its own, and of numbers of six digits or more in paths."""
    kinds = {"uuid": r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "date": r"\d{4}-\d{2}-\d{2}", "date_path": r"\d{4}/\d{2}/\d{2}", "date_reversed": r"\d{2}-\d{2}-\d{4}", "id": r"\b\d{6,}\b"}
    def of(kind: str, rx: str) -> Column:
        return F.transform(F.regexp_extract_all(U.part(crawl, "path"), F.lit(rx), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*[of(k, rx) for k, rx in kinds.items()]))
    return crawl.select(F.explode(found).alias("x")).groupBy("x.kind").agg(F.count("*").alias("count"), F.countDistinct("x.value").alias("unique_values"))
