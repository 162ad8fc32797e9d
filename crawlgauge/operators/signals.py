"""Pages to signals and facts, one row in and one row out, with no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions import jsonld, textrules
from crawlgauge.functions.html import with_signals
from crawlgauge.functions.outcomes import (
    contact_parsability,
    js_rendering,
    pricing_parsability,
    structured_data,
)

# Checks that read nothing but the page itself, as used for sub-pages.
PAGE_RULES = {
    "structured_data": structured_data,
    "js_rendering": js_rendering,
    "pricing_parsability": pricing_parsability,
    "contact_parsability": contact_parsability,
}


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Signals of each page plus the small values the page checks decide on."""
    signals = with_signals(pages, html)
    text = F.col("text_all_concat")
    read = signals.select(
        "*",
        F.char_length("text_body_joined").alias("text_len_body"),
        F.char_length("text_all_joined").alias("text_len_all"),
        F.size(textrules.price_mentions(text)).alias("n_prices"),
        F.size(textrules.email_mentions(text)).alias("n_emails"),
        F.size(textrules.phone_mentions(text)).alias("n_phones"),
        textrules.cmp_providers(F.col("script_srcs"), F.col("consent_elements")).alias("providers"),
        jsonld.jsonld_items(F.col("ld_json")).alias("ld_items"),
    )
    items = F.col("ld_items")
    return read.select(
        "*",
        jsonld.of_grade(items, jsonld.HIGH_VALUE_TYPES).alias("ld_high"),
        jsonld.of_grade(items, jsonld.GENERIC_TYPES).alias("ld_generic"),
    )
