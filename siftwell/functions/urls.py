"""URL normalisation, canonical form, classification and social links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import blank_to_null, let


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)\??([^#]*)", group)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return blank_to_null(F.regexp_replace(host, r"^www\.", ""))


def query_pairs(url: Column) -> Column:
    """``key=value`` parts with a non-empty value."""
    return F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+$"))


def normalize_external_url(c: Column) -> Column:
    """Website URL with scheme, lower-case host and without tracking parameters; NULL if not a URL."""
    def complete(raw: Column) -> Column:
        bare = raw.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(/.*)?$")
        return (F.when(raw.rlike("(?i)^(mailto|tel):"), F.lit(None).cast("string"))
                .when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
                .when(raw.rlike("(?i)^https?://"), raw).when(bare, F.concat(F.lit("https://"), raw)))

    def build(url: Column) -> Column:
        kept = F.filter(query_pairs(url), lambda p: ~F.lower(p).rlike("^(utm_[^=]*|fbclid|gclid)="))
        return F.when(_part(url, 2) != "", F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _part(url, 3), _query(kept)))

    return let(let(_bare_link(c), complete), build)


def _bare_link(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[<>\"']+|[<>\"';,]+$", "")


def _query(pairs: Column) -> Column:
    return let(F.array_join(pairs, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def canonical_url(c: Column, listing: bool = False) -> Column:
    """https, lower-case host without ``www.``, single slashes, sorted unique query, no fragment.

    Parameter names are lower-cased, numeric ``class`` values lose leading zeros and, on
    listings, page 1 is the same page as no page.
    """
    pairs = F.transform(query_pairs(c), lambda p: F.concat(
        F.lower(F.substring_index(p, "=", 1)), F.lit("="), F.trim(F.regexp_extract(p, "^[^=]+=(.*)$", 1))))
    pairs = F.transform(pairs, lambda p: F.when(p.rlike(r"^class=0+\d+$"), F.regexp_replace(p, "^class=0+", "class=")
                                                ).otherwise(p))
    if listing:
        pairs = F.filter(pairs, lambda p: ~p.rlike(r"^page=[01]$"))
    pairs = F.array_sort(F.array_distinct(pairs))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    path = F.regexp_replace(F.concat(F.lit("/"), _part(c, 3)), "/+", "/")
    return F.when(F.lower(_part(c, 1)).isin("http", "https"),
                  F.concat(F.lit("https://"), host_of(c), path, query))


def page_number(c: Column) -> Column:
    n = F.regexp_extract(_part(c, 4), r"(?:^|&)page=(\d+)(?:&|$)", 1).try_cast("int")
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))


def with_page(c: Column, page: Column) -> Column:
    """The same search on another page; page 1 is written without the parameter."""
    base = canonical_url(c, listing=True)
    kept = F.filter(query_pairs(base), lambda p: ~p.startswith("page="))
    number = F.array(F.concat(F.lit("page="), page.cast("string")))
    pairs = F.array_sort(F.when(page > 1, F.concat(kept, number)).otherwise(kept))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(base, r"\?.*$", ""), query)


def same_search(a: Column, b: Column, benign: list[str]) -> Column:
    """``b`` is another page of search ``a``: same path, same parameters, only benign extras."""
    ca, cb = canonical_url(a, listing=True), canonical_url(b, listing=True)
    own = F.filter(query_pairs(ca), lambda p: ~p.startswith("page="))
    other = F.filter(query_pairs(cb), lambda p: ~p.startswith("page="))
    extras = F.filter(F.array_except(other, own), lambda p: ~F.substring_index(p, "=", 1).isin(benign))
    same_path = F.regexp_replace(ca, r"\?.*$", "") == F.regexp_replace(cb, r"\?.*$", "")
    return same_path & (F.size(F.array_except(own, other)) == 0) & (F.size(extras) == 0)


def numeric_id(c: Column, marker: str = "profile") -> Column:
    """Digits of ``/<marker>/<digits>``."""
    return blank_to_null(F.regexp_extract(c, rf"(?i)/{marker}/(\d+)", 1))


def profile_root(c: Column, marker: str = "profile") -> Column:
    """Shortest URL that still names the profile: id plus at most two descriptive segments."""
    return blank_to_null(F.regexp_extract(canonical_url(c), rf"(?i)^(https://[^/]+/{marker}/\d+(?:/[^/?]+){{0,2}})", 1))


def profile_subpage(c: Column, page: str, marker: str = "profile") -> Column:
    """Sub-page URL; needs the id and both descriptive segments."""
    root = blank_to_null(F.regexp_extract(canonical_url(c), rf"(?i)^(https://[^/]+/{marker}/\d+/[^/?]+/[^/?]+)", 1))
    return F.concat(root, F.lit(f"/{page}/"))


def url_kind(c: Column, marker: str = "profile") -> Column:
    """``contacts``, ``projects``, ``profile``, ``listing`` or ``other``."""
    path = F.lower(_part(c, 3))
    return (
        F.when(path.rlike("/locations-contacts/?$"), F.lit("contacts"))
        .when(path.rlike("/completed-projects/?$"), F.lit("projects"))
        .when(path.rlike(rf"/{marker}/\d+"), F.lit("profile"))
        .when(path.rlike(r"/(search|city-search)\.html$") | path.contains("/isearch/results/"), F.lit("listing"))
        .when(_part(c, 3).rlike(r"^/[^/]*-[^/]*/[A-Za-z0-9.-]+-[A-Z]{2}/?$"), F.lit("listing"))
        .otherwise(F.lit("other"))
    )


def social_platform(c: Column) -> Column:
    def match(host: Column) -> Column:
        result = F.lit(None).cast("string")
        for platform, hosts in V.SOCIAL_HOSTS.items():
            pattern = "(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$"
            result = F.when(host.rlike(pattern), F.lit(platform)).otherwise(result)
        return result

    return let(host_of(c), match)


def clean_social_url(c: Column) -> Column:
    """Profile URL of a social network without tracking, NULL for share and dialog links."""
    def complete(raw: Column) -> Column:
        return (F.when(raw.rlike("^https?://"), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
                .otherwise(F.concat(F.lit("https://"), raw)))

    def parts(url: Column) -> Column:
        slug = F.regexp_extract(_part(url, 3), r"^/(?:pg/|people/[^/]+/|p/|company/|in/|channel/|c/|user/)?([^/]+)", 1)
        return F.struct(url.alias("url"), _part(url, 3).alias("path"), F.lower(slug).alias("slug"))

    def build(p: Column) -> Column:
        url = p["url"]
        kept = F.filter(query_pairs(url), lambda q: ~F.lower(q).rlike("^(utm_[^=]*|fbclid|gclid|locale)="))
        share = F.lower(p["path"]).rlike("/(sharer|share|intent|dialog|plugins)")
        good = (_part(url, 2) != "") & ~share & ~p["slug"].isin(V.IGNORED_SOCIAL_SLUGS) & (F.length(p["slug"]) >= 2)
        return F.when(good, F.concat(_part(url, 1), F.lit("://"), F.lower(_part(url, 2)), F.regexp_replace(p["path"], "/+$", ""), _query(kept)))

    return let(let(let(_bare_link(c), complete), parts), build)
