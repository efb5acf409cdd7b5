"""Addresses as Column expressions: their parts, and the keys by which equal pages meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters by which links are tracked, besides those that begin with utm_. Fixed values.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
#: Those that vote ids leave out. Fixed values.
VOTE_TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Those of social posts, besides names that begin with two underscores. Fixed values.
POST_TRACKING = ("refid", "ref", "mibextid", "paipv", "eav")


def part(url: Column, name: str) -> Column:
    """A part of an address (HOST, PATH, QUERY, PROTOCOL, ...); null where there is none."""
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-case host without www., empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def is_web(url: Column) -> Column:
    """Whether an address is a page's, not a script's or a file's."""
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https") & part(url, "HOST").isNotNull(), F.lit(False))


def in_domains(name: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of some domains or below one; names merely ending alike are not."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))


def _parameters(url: Column, tracking: Sequence[str], prefix: str) -> Column:
    """Sorted parameters of an address without those for tracking, joined."""
    pairs = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")

    def kept(pair: Column) -> Column:
        name = F.lower(F.substring_index(pair, "=", 1))
        return ~(name.startswith(prefix) | name.isin(*tracking))

    return F.array_join(F.array_sort(F.filter(pairs, kept)), "&")


def _joined(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def canonical_link(url: Column) -> Column:
    """An article's key: no tracking parameters, the others sorted, no fragment.

    Scheme, www. and a closing slash stay. What is no address stays as it is.
    """
    page = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), F.coalesce(blank(path(url)), F.lit("/")))
    return F.coalesce(_joined(page, _parameters(url, TRACKING, "utm_")), F.trim(url))


def blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def vote_link(url: Column) -> Column:
    """The address that votes are about: no scheme, www., port, fragment and closing slash."""
    page = F.concat(host(url), F.regexp_replace(path(url), "/$", ""))
    return F.when(host(url) != "", _joined(page, _parameters(url, VOTE_TRACKING, "utm_"))).otherwise(F.trim(url))


def vote_id(url: Column) -> Column:
    """SHA-256 of `vote_link`."""
    return F.sha2(vote_link(url), 256)


def page_identity(url: Column) -> Column:
    """(host, path, query) by which an address and the page it gave are compared."""
    authority = F.regexp_replace(F.lower(part(url, "AUTHORITY")), r"^(?:[^@]*@)?(?:www\.)?", "")
    return F.struct(
        F.coalesce(authority, F.lit("")).alias("host"),
        F.regexp_replace(path(url), "/+$", "").alias("path"),
        _parameters(url, TRACKING, "utm_").alias("query"),
    )


def same_page(left: Column, right: Column) -> Column:
    return page_identity(left) == page_identity(right)


def post_link(url: Column) -> Column:
    """A social post's key: fragment and tracking parameters gone."""
    page = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "HOST")), F.regexp_replace(path(url), "/$", ""))
    return F.coalesce(_joined(page, _parameters(url, POST_TRACKING, "__")), F.trim(url))


def is_tracked(url: Column) -> Column:
    """Whether an address has a tracking parameter."""
    names = "|".join(TRACKING)
    return F.coalesce(url.rlike(rf"(?i)[?&](?:utm_[a-z_]+|{names})="), F.lit(False))


def has_fragment(url: Column) -> Column:
    return F.coalesce(F.length(F.substring_index(url, "#", -1)) < F.length(url), F.lit(False))


def resolve(url: Column, base: Column) -> Column:
    """An address relative to a page as a whole one: absolute, protocol-relative, rooted or sibling."""
    root = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), url))
    )


def search_feed(query: Column, endpoint: str) -> Column:
    """Address of a search feed for a query."""
    return F.concat(F.lit(endpoint), F.url_encode(query))
