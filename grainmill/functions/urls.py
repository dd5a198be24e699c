"""URLs as column expressions: canonical form, parts, hashes, resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that whoever linked a page adds.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format",
    "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "twclid",
    "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url",
    "_ga", "_gl", "yclid", "ttclid",
)

_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


@dataclass(frozen=True)
class UrlOptions:
    """Which optional rewrites a canonical URL gets."""

    strip_query: tuple[str, ...] = ()
    sort_query: bool = False
    strip_trailing_slash: bool = False
    lower_path: bool = False


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def trimmed(text: Column) -> Column:
    """Without white space at the ends, any Unicode white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def clean_path(path: Column) -> Column:
    """Dot segments resolved as a server does; a trailing slash stays. Paths without dot segments are left as they are."""
    return let(path, _clean)


def _clean(path: Column) -> Column:
    resolved = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(resolved, "/"))
    cleaned = let(joined, lambda j: F.when(path.endswith("/") & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))
    return F.when(path == "", F.lit("/")).when(path.rlike(r"\./|/\.\.?$"), cleaned).otherwise(path)


def encode_path(path: Column) -> Column:
    """Characters that no URL path holds (white space, quotes, anything beyond ASCII) as percent-encoded UTF-8; other paths are left as they are."""
    return let(path, _encode)


def _encode(path: Column) -> Column:
    encoded = F.array_join(F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9\-._~$&+,/:;=@%]$"), c).when(c == " ", "%20").otherwise(F.regexp_replace(F.url_encode(c), r"\*", "%2A"))), "")
    return F.when(path.rlike(r"[^!-~]|[\"<>\\^`{|}]"), encoded).otherwise(path)


def strip_query(query: Column, names: tuple[str, ...]) -> Column:
    """A query (without its question mark) less the named parameters; order kept, empty pairs gone; a query that can't be decoded stays."""
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    decoded = lambda p: F.coalesce(F.try_url_decode(name(p)), name(p))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~decoded(p).isin(*names)), "&")
    return F.when(query.rlike(r"%(?![0-9A-Fa-f]{2})|;"), query).otherwise(kept)


def sort_query(query: Column) -> Column:
    """Pairs by name, then by value, written anew in encoded form."""
    text = lambda x: F.coalesce(F.try_url_decode(x), x)
    # the form encoder keeps * and leaves ~ encoded; URLs want the reverse
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda p: F.struct(text(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), text(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair))
    return F.when(query.rlike(r"%(?![0-9A-Fa-f]{2})|;"), query).otherwise(F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&"))


def normalise(url: Column, options: UrlOptions = UrlOptions()) -> Column:
    """The canonical form; null for what is no absolute http(s) URL with a host."""
    return let(trimmed(url), lambda u: let(_canonical(u, options), lambda c: F.when(c != "", c)))


def _canonical(url: Column, options: UrlOptions) -> Column:
    scheme = F.lower(_part(url, 1))
    host = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = encode_path(clean_path(_part(url, 3)))
    if options.lower_path:
        path = F.lower(path)
    if options.strip_trailing_slash:
        path = let(path, lambda path: F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path))
    query = F.substring(_part(url, 4), 2, 1 << 30)
    if options.strip_query or options.sort_query:
        query = strip_query(query, options.strip_query)
    if options.sort_query:
        query = sort_query(query)
    fine = scheme.isin("http", "https") & (host != "") & ~_part(url, 2).rlike(r"[\s\x00-\x1f]|%(?![0-9A-Fa-f]{2})")
    return F.when(fine, F.concat(scheme, F.lit("://"), host, path, let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))))


def host(url: Column) -> Column:
    """Lower-case host with its port."""
    return F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))


def without_port(host: Column) -> Column:
    """Of [v6]:port the bracketed address's inside, of name:port the name."""
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]?", 1)).when(host.rlike("^[^:]*:[0-9]*$"), F.regexp_replace(host, ":[0-9]*$", "")).otherwise(host)


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.array_join(F.slice(F.concat(F.array(F.lit("")), F.split(without_port(host), r"\.")), -2, 2), ".").substr(F.when(without_port(host).contains("."), 1).otherwise(2), F.lit(1 << 20))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return F.substring(_part(url, 4), 2, 1 << 30)


def url_hash(url: Column) -> Column:
    """What identifies a canonical URL: 16 bytes of its SHA-256, as hex."""
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 32)


def cache_key(url: Column) -> Column:
    return F.sha2(url.cast("binary"), 256)


def absolute(base: Column, href: Column) -> Column:
    """An href as an absolute URL by RFC 3986, not normalised; empty for blank ones, fragments alone, and schemes other than http(s)."""
    return let(F.regexp_replace(trimmed(href), "(?s)#.*$", ""), lambda h: let(base, lambda b: _absolute(b, h)))


def _absolute(base: Column, href: Column) -> Column:
    scheme = F.lower(F.regexp_extract(href, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    root = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2))
    path, query = F.regexp_extract(href, "^([^?]*)", 1), F.regexp_extract(href, r"^[^?]*(\?.*)?$", 1)
    folder = F.regexp_replace(F.when(_part(base, 3) == "", "/").otherwise(_part(base, 3)), "[^/]*$", "")
    return (
        F.when((href == "") | href.isNull(), F.lit(""))
        .when(scheme.isin("http", "https"), href)
        .when(scheme != "", F.lit(""))
        .when(href.startswith("//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, clean_path(path), query))
        .when(href.startswith("?"), F.concat(root, _part(base, 3), href))
        .otherwise(F.concat(root, clean_path(F.concat(folder, path)), query))
    )


def resolve(base: Column, href: Column, options: UrlOptions = UrlOptions()) -> Column:
    """An href found on a page as a canonical URL; null where it has none."""
    target = let(trimmed(href), lambda h: F.when((h == "") | h.startswith("#"), trimmed(base)).otherwise(absolute(trimmed(base), h)))
    return normalise(target, options)
