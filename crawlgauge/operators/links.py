"""Which links of a homepage lead to its pricing, contact and documentation pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.text import str_array
from crawlgauge.functions.urls import same_site, url_join

# Page types in order of preference, with the words that reveal them.
SUBPAGE_KEYWORDS = {
    "pricing": ["pricing", "plans", "price"],
    "contact": ["contact", "talk to us", "reach us", "get in touch"],
    "docs": ["docs", "documentation", "developer", "api reference"],
}
SKIPPED_HREFS = ["#", "mailto:", "tel:", "javascript:"]


def usable_href(href: Column) -> Column:
    ok = href != ""
    for prefix in SKIPPED_HREFS:
        ok = ok & ~href.startswith(prefix)
    return ok


def resolve_links(anchors: Column, base: Column) -> Column:
    """Usable same-site anchors with their absolute URL."""
    usable = F.filter(anchors, lambda a: usable_href(a["href"]))
    absolute = F.transform(
        usable,
        lambda a: F.struct(
            a["pos"].alias("pos"), a["text"].alias("text"), url_join(base, a["href"]).alias("abs_url")
        ),
    )
    return F.filter(absolute, lambda a: same_site(a["abs_url"], base))


def keyword_hit(text: Column, url: Column, page_type: str) -> Column:
    words = str_array(SUBPAGE_KEYWORDS[page_type])
    return F.exists(words, lambda w: text.contains(w) | url.contains(w))


def fetch_path(url: Column, base: Column) -> Column:
    """Path (with query) a link is fetched under; NULL if it is on another host. The scheme does not matter."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[^:/?#]+://[^/?#]*", ""), "(?s)#.*$", "")
    path = F.when(rest == "", F.lit("/")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(same_site(url, base), path)


def _free_hit(page_type: str, taken: list[str]):
    """Predicate: the anchor fits ``page_type`` and serves none of the ``taken`` types."""

    def free(h: Column) -> Column:
        ok = h[page_type]
        for other in taken:
            ok = ok & ~h["pos"].eqNullSafe(F.col(f"_{other}")["pos"])
        return ok

    return free


def with_subpage_links(pages: DataFrame, base: Column, anchors: str = "anchors") -> DataFrame:
    """Replace ``anchors`` by ``links``: at most one link per page type, ordered by position.

    The first anchor that fits a type wins, and an anchor serves one type only.
    That greedy choice equals: the first pricing hit, the first contact hit other
    than it, the first documentation hit other than those two.
    """
    keep = [c for c in pages.columns if c != anchors]
    types = list(SUBPAGE_KEYWORDS)
    hits = F.transform(
        resolve_links(F.col(anchors), base),
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["abs_url"].alias("page_url"),
            *[keyword_hit(a["text"], F.lower(a["abs_url"]), t).alias(t) for t in types],
        ),
    )
    any_hit = F.filter(hits, lambda h: h["pricing"] | h["contact"] | h["docs"])
    pages = pages.select(*keep, base.alias("_base"), any_hit.alias("_hits"))

    taken: list[str] = []
    for t in types:
        first = F.try_element_at(F.filter("_hits", _free_hit(t, taken)), F.lit(1))
        pages = pages.select("*", first.alias(f"_{t}"))
        taken.append(t)

    chosen = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_{t}").isNotNull(),
                    F.struct(
                        F.col(f"_{t}")["pos"].alias("pos"),
                        F.lit(t).alias("page_type"),
                        F.col(f"_{t}")["page_url"].alias("page_url"),
                        fetch_path(F.col(f"_{t}")["page_url"], F.col("_base")).alias("path"),
                    ),
                )
                for t in types
            ]
        )
    )
    return pages.select(*keep, F.array_sort(chosen).alias("links"))
