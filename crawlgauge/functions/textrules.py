"""Price, e-mail, phone, sitemap, llms.txt and consent-provider extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgauge.functions.text import find_all, matches, present, split_lines, str_array, strip

# Patterns of money amounts, e-mail addresses and phone numbers.
PRICE = r"(?U)[$£€¥]\s*[\d,]+(?:\.\d{2})?"
_LOCAL = r"[a-zA-Z0-9._%+\-]"
_DOMAIN = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?U)(?:\+\d[\d\s\-\(\)]{8,14}|\(\d{3}\)\s?\d{3}[\-\s]\d{4})"
# An address starts where a run of local-part characters starts or where the
# previous match ended; anchoring there keeps long runs without '@' linear.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}"
# File endings that make an address-like text an asset name.
ASSET_ENDING = r"(?i)\.(png|jpg|svg|gif|css|js)$"

# Script-host fragments of consent managers, in match order.
CONSENT_SCRIPTS = [
    "cookielaw.org", "onetrust.com", "cookiebot.com", "trustarc.com",
    "cookiepro.com", "didomi.io", "quantcast.com/choice", "usercentrics",
    "iubenda.com", "cookiefirst.com",
]

LLMS_ELEMENTS = ["title", "summary", "links"]


def price_mentions(text: Column) -> Column:
    return find_all(text, PRICE)


def email_mentions(text: Column) -> Column:
    found = F.filter(find_all(text, EMAIL), lambda e: ~e.rlike(ASSET_ENDING))
    return F.when(text.contains("@"), found).otherwise(str_array([]))


def phone_mentions(text: Column) -> Column:
    return find_all(text, PHONE)


def sitemap_url_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit("<url>"))


def llms_structure(body: Column) -> Column:
    """Structural elements present in an llms.txt body, as a subset of LLMS_ELEMENTS."""
    content = strip(body)
    lines = split_lines(content)
    return present(
        [
            (F.exists(lines, lambda l: l.startswith("# ")), "title"),
            (F.exists(lines, lambda l: l.startswith("> ")), "summary"),
            (matches(content, r"(?d)\[.+?\]\(https?://"), "links"),
        ]
    )


def llms_missing(found: Column) -> Column:
    return F.array_except(str_array(LLMS_ELEMENTS), found)


def cmp_providers(script_srcs: Column, element_ids: Column) -> Column:
    """Sorted consent providers seen in script sources or element ids."""
    signatures = str_array(CONSENT_SCRIPTS)

    def first_signature(src: Column) -> Column:
        return F.try_element_at(F.filter(signatures, lambda s: src.contains(s)), F.lit(1))

    by_script = F.transform(
        F.array_compact(F.transform(script_srcs, first_signature)),
        lambda s: F.substring_index(s, ".", 1),
    )
    by_element = F.transform(element_ids, lambda e: F.substring_index(e, "-", 1))
    return F.array_sort(F.array_union(by_script, by_element))
