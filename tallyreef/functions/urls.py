"""URL functions. The canonical forms differ on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyreef.functions.rules import bound
from tallyreef.functions.text import blank

# Query parameters that only track visitors.
TRACKING = ("fbclid", "gclid", "ref_src", "ref_url", "twclid", "xclid")
SHOP_TRACKING = ("_gl", "gclid", "fbclid", "yclid")
# Hosts that only carry posts and lists of links.
SOCIAL_HOSTS = (
    "x.com", "twitter.com", "www.instagram.com", "instagram.com", "www.facebook.com", "facebook.com",
    "www.youtube.com", "youtube.com", "www.tiktok.com", "tiktok.com", "linktr.ee",
)


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(blank(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://"))


def netloc(url: Column) -> Column:
    return F.lower(_part(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return _part(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def query(url: Column) -> Column:
    return _part(blank(url), r"^[^?#]*\?([^#]*)")


def _decoded(text: Column) -> Column:
    """A part of a query as it is meant; a percent sign that begins no code stands for itself."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def parameters(url: Column, dropped: tuple[str, ...], ordered: bool = False) -> Column:
    """The parameters that stay, decoded and written anew, so that different spellings of one are equal."""
    items = F.filter(F.split(query(url), "&"), lambda x: x != "")

    def pair(item: Column) -> Column:
        return F.struct(_decoded(F.substring_index(item, "=", 1)).alias("key"), _decoded(F.when(item.contains("="), F.regexp_replace(item, "^[^=]*=", "")).otherwise("")).alias("value"))

    pairs = F.transform(items, pair)
    if dropped:
        pairs = F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*dropped) & ~F.lower(p["key"]).startswith("utm_"))
    pairs = F.array_sort(pairs) if ordered else pairs
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")


def canonical(url: Column, *, empty_root: bool = False, ordered: bool = False, whole_path: bool = False, https_only: bool = False, dropped: tuple[str, ...] = TRACKING) -> Column:
    """Canonical form; "" for what is no web address.

    Scheme and host in lower case, no fragment, no trailing slash, and tracking
    parameters removed. ``empty_root``: a root path is "" and not "/"; ``ordered``:
    parameters are sorted; ``whole_path``: slashes at the end stay; ``https_only``:
    other schemes give "".
    """
    tail = path(url) if whole_path else F.regexp_replace(path(url), "/+$", "")
    tail = tail if empty_root else bound(tail, lambda found: F.when(found == "", F.lit("/")).otherwise(found))
    kept = bound(parameters(url, dropped, ordered), lambda found: F.when(found == "", "").otherwise(F.concat(F.lit("?"), found)))
    kept = F.when(url.contains("?"), kept).otherwise("")
    web = scheme(url).isin("https") if https_only else scheme(url).isin("http", "https")
    return F.when(web & (host(url) != ""), F.concat(scheme(url), F.lit("://"), netloc(url), tail, kept)).otherwise("")


def application_url(url: Column) -> Column:
    return canonical(url)


def discovery_url(url: Column) -> Column:
    return canonical(url, empty_root=True)


def article_url(url: Column) -> Column:
    return canonical(url, ordered=True, whole_path=True, dropped=())


def shop_url(url: Column) -> Column:
    return canonical(url, ordered=True, whole_path=True, https_only=True, dropped=SHOP_TRACKING)


def in_domain(url: Column, domain: Column) -> Column:
    """The host is the domain or lies below it."""
    return (host(url) == domain) | F.endswith(host(url), F.concat(F.lit("."), domain))


def path_number(url: Column) -> Column:
    """Last number of the path, as an id; null if there is none."""
    return F.nullif(_part(path(url), r"/(\d+)/?$"), F.lit("")).try_cast("long")


def safety_error(url: Column) -> Column:
    """Why a link is not followed, the first reason that holds; "" if it may be."""
    name = F.regexp_replace(host(url), r"^\.+|\.+$", "")
    return (
        F.when(scheme(url) != "https", "scheme")
        .when(netloc(url).contains("@"), "credentials")
        .when(F.regexp_replace(netloc(url), r"\[.*\]", "").rlike(":(?!443$)[0-9]+$"), "port")
        .when((name == "") | (name == "localhost") | name.rlike(r"\.(?:local|localhost)$"), "local")
        .when(name.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | netloc(url).contains("["), "address")
        .when(name.isin(*SOCIAL_HOSTS), "social")
        .otherwise("")
    )
