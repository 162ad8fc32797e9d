"""Unscored audits of the pricing, contact and documentation pages a homepage links to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.outcomes import OUTCOME
from crawlgauge.operators.audit import verdicts, worded
from crawlgauge.operators.signals import PAGE_RULES, page_facts
from crawlgauge.registry import BUILTIN, Check
from crawlgauge.sources.tables import HOME_PATH

# Checks applied to each page type, in report order.
SUBPAGE_CHECKS = {
    "pricing": ["pricing_parsability", "js_rendering"],
    "contact": ["contact_parsability"],
    "docs": ["structured_data", "js_rendering"],
}
# Display names; anything else is shown by its key.
PAGE_LABELS = {"pricing": "Pricing Page", "contact": "Contact Page", "docs": "Docs Page"}
CHECK_LABELS = {
    "pricing_parsability": "Pricing Parsability",
    "contact_parsability": "Contact Parsability",
    "js_rendering": "JS Rendering",
    "structured_data": "Structured Data",
}


# Bits of the filter of linked pages: its rows are 64 bits each and are broadcast.
LINK_BITS = 1 << 26


def label(key: Column, names: dict[str, str]) -> Column:
    chain = None
    for k, v in names.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(key)


def subpage_links(audited: DataFrame) -> DataFrame:
    """One row per detected link, in page order."""
    return audited.select("scan_id", "url", F.inline("links"))


def link_words(links: DataFrame) -> DataFrame:
    """A Bloom filter of linked (scan_id, path): (word, mask), a word being 64 bits of it.

    It has LINK_BITS bits, so at most LINK_BITS / 64 rows however many links there are.
    """
    bit = F.col("_bit")
    placed = links.select(_link_bit().alias("_bit"))
    return placed.groupBy(_word(bit).alias("_word")).agg(F.bit_or(_mask(bit)).alias("_set"))


def _link_bit() -> Column:
    return F.pmod(F.xxhash64("scan_id", "path"), F.lit(LINK_BITS))


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6)


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))


def linked_resources(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Served resources, without homepages, that a page may link to; the others are dropped at their scan.

    The filter lets some others through (about one in nine while there are fewer than LINK_BITS / 8 links): a join on
    (scan_id, path) with the links decides. Nothing is exchanged but the filter.
    """
    rows = resources
    if "kind" in resources.columns:
        rows = resources.filter(F.col("kind") != "home")
    served = rows.filter(
        (F.col("path") != HOME_PATH) & (F.col("status") == 200) & F.col("error").isNull()
    )
    bit = F.col("_bit")
    asked = served.withColumn("_bit", _link_bit()).withColumn("_word", _word(bit))
    # At most LINK_BITS / 64 rows of two numbers.
    found = asked.join(F.broadcast(link_words(links)), "_word")
    return found.filter(F.col("_set").bitwiseAND(_mask(bit)) != 0).drop("_bit", "_word", "_set")


def fetched_pages(links: DataFrame, resources: DataFrame, page: Column | None = None) -> DataFrame:
    """Linked pages other than homepages that answered 200, judged on their own row: (scan_id, path, page).

    Pages that were not served, or that nothing links to, are never parsed. Re-delivered copies of a page shrink to
    the latest before the exchange.
    """
    facts = page_facts(
        linked_resources(links, resources).select(
            "scan_id", "path", "fetched_at", F.coalesce("body", F.lit("")).alias("html")
        )
    )
    if page is None:
        page = F.struct(*[rule().alias(k) for k, rule in PAGE_RULES.items()])
    judged = facts.select("scan_id", "path", "fetched_at", page.alias("page"))
    newest = F.max(F.struct("fetched_at", "page"))["page"]
    pages = judged.groupBy("scan_id", "path").agg(newest.alias("page"))
    return pages.join(links.select("scan_id", "path"), ["scan_id", "path"], "left_semi")


def page_results(
    audited: DataFrame, resources: DataFrame, checks: tuple[Check, ...] = BUILTIN
) -> DataFrame:
    """One row per scan and linked page with the findings as an array; pages not served are left out.

    ``audited`` is read twice, for the filter of links and for the links themselves: store it.
    """
    home_ok = F.col("home_status") == 200
    links = audited.select(
        "scan_id",
        "url",
        F.inline("links"),
        F.when(home_ok, F.col("page")).alias("home_page"),
    )
    links = links.withColumn("home_page", F.when(F.col("path") == HOME_PATH, F.col("home_page")))
    fetched = fetched_pages(subpage_links(audited).filter(F.col("path").isNotNull()), resources)
    found = links.join(fetched, ["scan_id", "path"], "left").withColumn("page", F.coalesce("page", "home_page"))
    found = found.filter(F.col("page").isNotNull())

    of_type = F.lit(None)
    for page_type, keys in SUBPAGE_CHECKS.items():
        rows = [
            F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col("page")[k].cast(OUTCOME).alias("o"))
            for i, k in enumerate(keys)
        ]
        of_type = F.when(F.col("page_type") == page_type, F.array(*rows)).otherwise(of_type)
    judged = F.transform(
        of_type,
        lambda x: F.struct(
            x.alias("x"),
            F.try_element_at(_page_verdicts(checks), F.concat_ws(".", x["key"], x["o"]["reason"])).alias("v"),
        ),
    )
    findings = F.transform(
        judged,
        lambda j: F.struct(
            j["x"]["ord"].alias("ord"),
            j["x"]["key"].alias("key"),
            label(j["x"]["key"], CHECK_LABELS).alias("check_label"),
            j["v"]["status"].alias("status"),
            j["x"]["o"]["reason"].alias("reason"),
            worded(j["v"]["detail"], j["x"]["o"]["args"]).alias("detail"),
            worded(j["v"]["action"], j["x"]["o"]["args"]).alias("action"),
        ),
    )
    return found.select(
        "scan_id",
        "url",
        "pos",
        "page_type",
        label(F.col("page_type"), PAGE_LABELS).alias("page_label"),
        "page_url",
        findings.alias("checks"),
    )


def audit_subpages(
    audited: DataFrame, resources: DataFrame, checks: tuple[Check, ...] = BUILTIN
) -> DataFrame:
    """Long form of ``page_results``: one row per scan, linked page and check."""
    return long_form(page_results(audited, resources, checks))


def long_form(pages: DataFrame) -> DataFrame:
    return pages.select("scan_id", "url", "pos", "page_type", "page_label", "page_url", F.inline("checks"))


def _page_verdicts(checks: tuple[Check, ...]) -> Column:
    return verdicts(tuple(c for c in checks if c.key in PAGE_RULES))
