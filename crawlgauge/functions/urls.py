"""URL shaping: scheme defaulting, site roots, link resolution, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgauge.functions.text import matches

_NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
_HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_DOT_SEGMENT = r"(?:^|/)\.{1,2}(?:/|$)"

# Substrings that mark a URL as part of a sign-in flow.
LOGIN_MARKERS = ["login", "signin", "sign-in", "/auth/", "/sso", "saml"]


def normalize_url(url: Column) -> Column:
    """Prefix https:// unless the text already starts with http:// or https://."""
    return F.when(matches(url, "^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column) -> Column:
    """Authority part as written (userinfo, port and case kept); '' when there is none."""
    return F.regexp_extract(url, _NETLOC, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def base_url(url: Column) -> Column:
    """scheme://authority of the requested URL."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _fold_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(segments, empty, step)
    tail = F.when(matches(path, r"(?:^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(folded, "/"), tail)
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(matches(path, _DOT_SEGMENT), rooted).otherwise(path)


def url_join(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on the page at ``base`` (a scheme://authority root)."""
    clean = F.translate(href, "\t\r\n", "")
    path = F.regexp_extract(clean, r"^[^?#]*", 0)
    suffix = F.regexp_extract(clean, r"^[^?#]*(.*)$", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit("/"), F.regexp_replace(path, "/{2,}", "/"))
    )
    return (
        F.when(href.startswith("http"), href)
        .when(clean.startswith("//"), F.concat(scheme(base), F.lit(":"), clean))
        .when(
            matches(clean, _HAS_SCHEME),
            F.concat(F.lower(F.substring_index(clean, ":", 1)), F.regexp_extract(clean, "(?s)^[^:]*(:.*)$", 1)),
        )
        .when(path == "", F.concat(base, suffix))
        .otherwise(F.concat(base, _fold_dots(rooted), suffix))
    )


def same_site(url: Column, base: Column) -> Column:
    """Exact authority equality; www. prefixes and ports count."""
    return netloc(url) == netloc(base)


def display_domain(url: Column) -> Column:
    return F.split_part(F.regexp_replace(url, "^(.*?)https?://", "$1"), F.lit("/"), F.lit(1))


def report_file_name(url: Column, ext: str, prefix: str = "audit_") -> Column:
    """File name for a site's report: scheme dropped, slashes made safe."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.concat(F.lit(prefix), F.replace(bare, F.lit("/"), F.lit("_")), F.lit("." + ext))


def login_url(url: Column) -> Column:
    """Whether any sign-in marker occurs anywhere in the URL, host included."""
    return matches(F.lower(url), "|".join(LOGIN_MARKERS))
