"""URL functions as column expressions: splitting, normalising, resolving and classifying, all on the JVM.

Splitting follows RFC 3986's regular expression with the usual library rules on top: the scheme and host are lowered,
parameters of the last path segment are cut off, tabs and line breaks inside and blanks before a URL are dropped. A URL with
an impossible port or an open bracket has no parts at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
PORT = r"(?=[0-9]{1,9}$)0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
#: URLs of a lowered scheme and a location without port, user or brackets, followed by a slash or nothing: their first
#: pieces between slashes are their scheme and location.
PLAIN = r"^[a-z][a-z0-9+.\-]*+://[^/?#\x00-\x20:\[\]@]++(?:/|$)"
#: URLs that are their own canonical form: lowered scheme and location, and a path without parameters, query, fragment or a slash at its end.
CANONICAL = r"^[a-z][a-z0-9+.\-]*+://[a-z0-9.\-]++(?:/[^?#;\x00-\x20]*+(?<!/))?\z"
#: URLs without user, port, parameters of a segment, query and fragment, scheme and location lowered: what follows the location is their path.
SIMPLE = r"^[a-z][a-z0-9+.\-]*+://[a-z0-9.\-]++(?:/[^?#;\x00-\x20]*+)?\z"
#: What follows the last @: brackets both ways or not at all, and after the last colon nothing or a port.
LOCATION = rf"^(?:[\s\S]*@)?(?=[^@]*$)(?:(?![^@]*[\[\]])|(?=[^@]*\[)(?=[^@]*\]))(?:(?![^@]*:[^:\]]*$)|(?=[^@]*:(?:{PORT})?$))"

# Query parameters that tracking adds.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "_ga", "_gl", "mc_cid", "mc_eid",
    "ref", "source", "campaign", "ad_id", "ad_name",
]


def cleaned(url: Column) -> Column:
    """url without blanks before it and tabs and line breaks in it. One node, since other expressions contain it often."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+|[\t\r\n]", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(cleaned(url), rf"^(?:{SCHEME}:)?//([^/?#]*)", 1)


def hostport(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"([^@]*)$", 1)


def port_text(url: Column) -> Column:
    return F.regexp_extract(hostport(url), r":([^:\]]*)$", 1)


def valid(url: Column) -> Column:
    """Whether the URL can be split: a port of digits up to 65535 and closed brackets."""
    return netloc(url).rlike(LOCATION)


def _if_valid(url: Column, value: Column) -> Column:
    return F.when(valid(url), value).otherwise("")


def scheme(url: Column) -> Column:
    return _if_valid(url, F.lower(F.regexp_extract(cleaned(url), rf"^({SCHEME}):", 1)))


def path(url: Column) -> Column:
    whole = F.regexp_extract(cleaned(url), rf"(?s)^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)
    return _if_valid(url, F.when(cleaned(url).contains(";"), F.regexp_replace(whole, r";[^/]*$", "")).otherwise(whole))


def query(url: Column) -> Column:
    return _if_valid(url, F.when(cleaned(url).contains("?"), F.regexp_extract(cleaned(url), r"(?s)^[^?#]*\?([^#]*)", 1)).otherwise(""))


def fragment(url: Column) -> Column:
    return _if_valid(url, F.when(cleaned(url).contains("#"), F.regexp_extract(cleaned(url), r"(?s)^[^#]*#(.*)$", 1)).otherwise(""))


def host(url: Column) -> Column:
    return _if_valid(url, F.lower(F.regexp_replace(F.regexp_extract(hostport(url), r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", "")))


def port(url: Column) -> Column:
    return F.when(valid(url) & (port_text(url) != ""), port_text(url).try_cast("int"))


def username(url: Column) -> Column:
    user = F.regexp_extract(netloc(url), r"^([^@]*)@", 1)
    return F.when(valid(url) & netloc(url).contains("@"), F.split_part(user, F.lit(":"), F.lit(1)))


#: By name, the functions of a URL that parsed() calls; and their column.
PARTS = {"scheme": scheme, "netloc": netloc, "username": username, "host": host, "port": port, "path": path, "query": query, "fragment": fragment}
PARSED = "_url_parts"


def simple_path(url: Column) -> Column:
    """The path of a URL that matches SIMPLE."""
    return F.substr(url, F.char_length(F.substring_index(url, "/", 3)) + 1)


def parsed(df: DataFrame) -> DataFrame:
    """df with the PARTS of its URLs, which part() takes instead of looking for each of them again. Simple URLs are rows of their own there, so
    that the search isn't compiled into their way."""
    url = F.col("url")
    simple, location_ = F.coalesce(url.rlike(SIMPLE), F.lit(False)), F.split_part(url, F.lit("/"), F.lit(3))
    known = {"scheme": F.substring_index(url, ":", 1), "netloc": location_, "host": location_, "path": simple_path(url), "query": F.lit(""), "fragment": F.lit(""), "username": F.lit(None).cast("string"), "port": F.lit(None).cast("int")}
    plain = df.where(simple).withColumn(PARSED, F.struct(*[known[name].alias(name) for name in PARTS]))
    return plain.unionByName(df.where(~simple).withColumn(PARSED, F.struct(*[f(url).alias(name) for name, f in PARTS.items()])))


def part(df: DataFrame, name: str) -> Column:
    """One of the PARTS of df's URLs."""
    return F.col(f"{PARSED}.{name}") if PARSED in df.columns else PARTS[name](F.col("url"))


def segments(path_: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(path_, "/"), lambda x: x != "")


def path_depth(url: Column) -> Column:
    """Number of path segments; a string without :// is a path as a whole, query included."""
    return F.size(segments(F.when(url.contains("://"), path(url)).otherwise(F.coalesce(url, F.lit("")))))


def base_url(url: Column) -> Column:
    return F.when(url.rlike(PLAIN), F.substring_index(url, "/", 3)).otherwise(F.concat(scheme(url), F.lit("://"), netloc(url)))


def location(url: Column) -> Column:
    """netloc(), without a search in plain URLs."""
    return F.when(url.rlike(PLAIN), F.split_part(url, F.lit("/"), F.lit(3))).otherwise(netloc(url))


def same_domain(a: Column, b: Column) -> Column:
    """Equal, case-sensitive network locations, port included; false where either is empty."""
    return (location(a) == location(b)) & (location(a) != "")


def has_dots(link: Column) -> Column:
    """Whether a path has a segment of one or two dots."""
    return link.contains("/.") & link.rlike(r"/\.\.?(/|$)")


def on_own_site(link: Column, source: Column) -> Column:
    """Whether a link is a path on its plain source's site, so that its target needs no search; see PLAIN."""
    return F.coalesce(link.startswith("/") & ~link.startswith("//") & ~link.contains("/.") & source.rlike(PLAIN), F.lit(False))


def resolve_plain(link: Column, source: Column, own: Column | None = None) -> Column:
    """Links that need no merging: empty and fragment links have no target, // takes https, / takes the source's base and
    whatever starts with http stays. Other links are null here; see merge_reference(). own is on_own_site(), where it is known."""
    return (
        F.when(on_own_site(link, source) if own is None else own, F.concat(F.substring_index(source, "/", 3), link))
        .when(F.coalesce(link, F.lit("")) == "", F.lit(None).cast("string"))
        .when(link.startswith("#"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/") & ~has_dots(link), F.concat(base_url(source), link))
        .when(link.startswith("http"), link)
    )


@F.pandas_udf(StringType())
def merge_reference(links: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """RFC 3986 section 5.2 for the few links that resolve_plain leaves."""
    for link, source in links:
        yield pd.Series([urljoin(s or "", x or "") for x, s in zip(link, source, strict=True)])


def is_relative(link: Column) -> Column:
    """Whether a link needs merging with its source."""
    return (F.coalesce(link, F.lit("")) != "") & ~link.startswith("#") & ~link.startswith("//") & ~link.startswith("http") & (~link.startswith("/") | has_dots(link))


def fragment_class(f: Column) -> Column:
    return F.when(f.rlike(r"(?U)^[a-zA-Z][\w-]*$"), "anchor").when(f.startswith("/") | f.startswith("!"), "route").otherwise("other")


def extension_of_path(path_: Column) -> Column:
    """Lowered last dot-piece of the whole path if it is alphanumeric and at most ten characters."""
    piece = F.lower(F.element_at(F.split(path_, r"\."), -1))
    return F.when(path_.contains(".") & piece.rlike(r"^[a-z0-9]{1,10}$"), piece)


def extension_of_file(path_: Column) -> Column:
    """The same, of the last segment only."""
    return extension_of_path(F.element_at(F.split(path_, "/"), -1))


def query_param_count(url: Column) -> Column:
    q = query(url)
    return F.when(q != "", F.size(F.split(q, "&"))).otherwise(0)


def decoded(text: Column) -> Column:
    """Percent-decoding that keeps + and leaves malformed escapes as they are."""
    plain = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(~text.contains("%"), text).otherwise(F.coalesce(F.when(~text.rlike(r"%(?![0-9A-Fa-f]{2})"), plain), unquoted(text)))


@F.pandas_udf(StringType())
def unquoted(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unquote(x))


def parameters(q: Column, keep_blank: bool = True) -> Column:
    """array<struct<at, key, value>> of a query string, decoded, + as blank."""
    pieces = F.filter(F.split(q, "&"), lambda x: x != "")
    plus = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(pieces, lambda x, i: F.struct(i.alias("at"), plus(F.substring_index(x, "=", 1)).alias("key"), plus(F.when(x.contains("="), F.regexp_extract(x, r"=(.*)$", 1)).otherwise("")).alias("value")))
    return pairs if keep_blank else F.filter(pairs, lambda p: p["value"] != "")


def normalized_query(q: Column, drop_tracking: bool = False) -> Column:
    """Parameters sorted by key, values in their order, joined again without encoding."""
    kept = parameters(q)
    if drop_tracking:
        kept = F.filter(kept, lambda p: ~F.lower(p["key"]).isin(TRACKING))
    by_key = F.array_sort(F.transform(kept, lambda p: F.struct(p["key"].alias("key"), p["at"].alias("at"), p["value"].alias("value"))))
    return F.array_join(F.transform(by_key, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def normalized_url(url: Column, remove_fragment: bool = True, remove_tracking: bool = True) -> Column:
    """Scheme, network location, path without a trailing slash, sorted query and, if kept, the fragment."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    p = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, r"/+$", "")).otherwise(p)
    q = normalized_query(query(url), remove_tracking)
    out = F.concat(scheme(url), F.lit("://"), netloc(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return out if remove_fragment else F.concat(out, F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(""))


def canonical_url(url: Column, remove_fragment: bool = True, remove_query: bool = False) -> Column:
    """Lowered scheme (https if none) and location, path without trailing slashes; the deduplication key."""
    return F.when(url.rlike(CANONICAL), url).otherwise(_canonical_url(url, remove_fragment, remove_query))


def _canonical_url(url: Column, remove_fragment: bool, remove_query: bool) -> Column:
    p = F.when(path(url) == "/", "/").otherwise(F.regexp_replace(path(url), r"/+$", ""))
    s = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    q = F.lit("") if remove_query else F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    f = F.lit("") if remove_fragment else F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")
    return F.concat(s, F.lit("://"), F.lower(netloc(url)), p, q, f)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def labels(loc: Column) -> dict[str, Column]:
    """Suffix, domain and subdomain of a network location by its dots: last, second last and the labels before."""
    parts = F.split(loc, r"\.")
    n = F.size(parts)
    return {
        "suffix": F.when(n >= 2, F.element_at(parts, -1)).otherwise(""),
        "domain": F.when(n >= 2, F.element_at(parts, -2)).otherwise(loc),
        "subdomain": F.when(n > 2, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), ".")).otherwise(""),
    }


def components(url: Column) -> dict[str, Column]:
    """All parts of a URL, by name."""
    p, h = path(url), host(url)
    dotted = F.split(h, r"\.")
    return {
        "scheme": scheme(url), "netloc": netloc(url), "host": h, "port": port(url), "username": username(url), "path": p, "query": query(url), "fragment": fragment(url),
        "domain": F.when(F.size(dotted) >= 2, F.array_join(F.slice(dotted, -2, 2), ".")).otherwise(h),
        "subdomain": F.when(F.size(dotted) > 2, F.array_join(F.slice(dotted, 1, F.greatest(F.size(dotted) - 2, F.lit(1))), ".")).otherwise(""),
        "depth": F.size(segments(p)), "extension": extension_of_file(p), "param_count": query_param_count(url), "query_normalized": normalized_query(query(url)),
        "url_length": F.char_length(url), "is_root": p.isin("", "/"), "is_file": extension_of_file(p).isNotNull(),
        "has_query": query(url) != "", "has_fragment": fragment(url) != "", "has_port": F.coalesce(port(url), F.lit(0)) != 0,
    }
