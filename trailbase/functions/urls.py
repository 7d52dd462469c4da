"""URLs as columns: resolution, canonical form, fingerprint, domains.

Everything is built-in expressions, so URL work stays in generated code beside
the scan.  Patterns follow the generic URI syntax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Query parameters that only track.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "ref", "source", "spm", "sc_campaign", "mc_cid", "mc_eid")
#: First labels of a host that don't change who owns it.
HOST_PREFIXES = ("www", "m", "api", "cdn", "static", "assets", "media", "files", "docs", "blog", "shop", "store", "mail", "news", "dev", "staging", "test", "app")
#: Path words of pages of low and of high value.
LOW_PATHS = ("about", "contact", "privacy", "terms", "login", "signup", "signin", "register", "cart", "checkout", "account", "subscribe", "unsubscribe")
HIGH_PATHS = ("docs", "documentation", "blog", "news", "article", "post", "guide", "tutorial", "reference", "api", "spec", "changelog", "release")

URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
SCHEME, NETLOC, PATH, QUERY = 1, 2, 3, 4


def part(url: Column, which: int) -> Column:
    return F.regexp_extract(url, URI, which)


def parts(url: Column) -> Column:
    """scheme, netloc, path and query of a URL, in one struct."""
    return F.struct(F.lower(part(url, SCHEME)).alias("scheme"), part(url, NETLOC).alias("netloc"), part(url, PATH).alias("path"), part(url, QUERY).alias("query"))


def without_dots(path: Column) -> Column:
    """A path without "." and ".." segments; ".." never climbs above the root."""

    def squeeze(pieces: Column) -> Column:
        kept = F.aggregate(
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
        )
        last = F.when(F.element_at(pieces, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), squeeze(F.split(path, "/"))).otherwise(path)


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for a link found on the page at ``base``."""

    def join(h: Column, b: Column) -> Column:
        tail = F.concat(F.regexp_extract(href, r"(\?[^#]*)", 1), F.regexp_extract(href, r"(#.*)$", 1))
        root = F.concat(b["scheme"], F.lit("://"), b["netloc"])
        folder = F.regexp_extract(b["path"], r"^(.*/)[^/]*$", 1)
        path = F.when(h["path"].startswith("/"), h["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), h["path"]))
        own = (h["scheme"] == "") | (h["scheme"] == b["scheme"])
        return (
            F.when(F.coalesce(href, F.lit("")) == "", base)
            .when(~own | ((h["scheme"] != "") & (h["netloc"] != "")), href)
            .when(h["netloc"] != "", F.concat(b["scheme"], F.lit(":"), href))
            .when((h["path"] == "") & href.startswith("?"), F.concat(root, b["path"], tail))
            .when(h["path"] == "", F.concat(root, b["path"], F.regexp_extract(base, r"(\?[^#]*)", 1), tail))
            .otherwise(F.concat(root, let(path, without_dots), tail))
        )

    return let(parts(href), lambda h: let(parts(base), lambda b: join(h, b)))


def _form_encode(text: Column) -> Column:
    """Form encoding that leaves "~" and encodes "*"."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def clean_query(query: Column, strip: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """A query without tracking parameters, sorted by key; equal keys keep their order."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(_form_decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _form_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(keyed, lambda x: ~F.lower(x["k"]).isin(*strip))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_form_encode(x["k"]), F.lit("="), _form_encode(x["v"]))), "&")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(part(url, NETLOC), "^.*@", ""), r"^([^:]*)", 1))


def reg_domain(host: Column) -> Column:
    """The host without known first labels (two labels stay at least), and of that the last three labels."""
    bare = F.regexp_replace(host, rf"^(?:(?:{'|'.join(HOST_PREFIXES)})\.)+([^.]+\.[^.]+.*)$", "$1")
    return F.substring_index(bare, ".", -3)


def fingerprint(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_url(url: Column, strip: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """Lower-case scheme and host, no default port, single slashes, a clean query, no fragment."""

    def build(u: Column) -> Column:
        host = F.lower(F.regexp_extract(F.regexp_replace(u["netloc"], "^.*@", ""), r"^([^:]*)", 1))
        port = F.regexp_extract(u["netloc"], r":(\d+)$", 1)
        default = ((u["scheme"] == "http") & (port == "80")) | ((u["scheme"] == "https") & (port == "443"))
        where = F.concat(host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)))
        path = F.regexp_replace(F.when(u["path"] == "", "/").otherwise(u["path"]), "/+", "/")
        front = F.when(u["netloc"] == "", F.concat(u["scheme"], F.lit(":"))).otherwise(F.concat(u["scheme"], F.lit("://"), where))
        query = let(clean_query(u["query"], strip), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.concat(front, path, F.when(u["query"] == "", "").otherwise(query))

    return let(parts(url), build)


def url_struct(href: Column, base: Column, strip: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """raw, canonical, url_key, scheme, host, path, query, domain and reg_domain of a link."""

    def build(canonical: Column) -> Column:
        fields = lambda u, host: F.struct(href.alias("raw"), canonical.alias("canonical"), fingerprint(canonical).alias("url_key"), u["scheme"].alias("scheme"), host.alias("host"), u["path"].alias("path"), u["query"].alias("query"), host.alias("domain"), reg_domain(host).alias("reg_domain"))
        return let(parts(canonical), lambda u: let(host_of(canonical), lambda host: fields(u, host)))

    return let(let(resolve(href, base), lambda u: canonical_url(u, strip)), build)


def path_signal(raw_url: Column) -> Column:
    """0 for a path with a low-value word, else 1 with a high-value word, else 0.5."""
    words = F.filter(F.split(F.lower(part(raw_url, PATH)), "/"), lambda w: w != "")
    among = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return F.when(among(LOW_PATHS), 0.0).when(among(HIGH_PATHS), 1.0).otherwise(0.5)
