"""Schema.org types declared in JSON-LD blocks, read through the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgauge.functions.text import str_array

# Types that describe an offer, answer or entity an agent can act on.
HIGH_VALUE_TYPES = [
    "FAQPage", "Product", "Service", "SoftwareApplication",
    "ContactPoint", "PriceSpecification", "ItemList", "Article",
    "BlogPosting", "Event", "Person", "Review", "AggregateRating",
    "HowTo", "QAPage",
]
# Types that only identify the site.
GENERIC_TYPES = ["Organization", "WebSite", "WebPage", "BreadcrumbList"]

_ITEM = "struct<kind:string,name:string>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]*", 0)


def _is_object(v: Column) -> Column:
    return _kind(v) == "OBJECT"


def _item(v: Column) -> Column:
    return F.struct(
        _kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("name")
    ).cast(_ITEM)


def _node_items(node: Column) -> Column:
    """Declared types of one node; a missing, empty or zero value declares nothing."""
    declared = F.try_variant_get(node, '$["@type"]', "variant")
    text, kind = F.try_variant_get(declared, "$", "string"), _kind(declared)
    number = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (F.try_variant_get(declared, "$", "double") == 0)
    nothing = (kind == "STRING") & (text == "") | (kind == "BOOLEAN") & (text == "false") | (kind == "OBJECT") & (text == "{}")
    blank = declared.isNull() | text.isNull() | number | nothing
    none = F.array().cast(f"array<{_ITEM}>")
    listed = F.try_variant_get(declared, "$", "array<variant>")
    return (
        F.when(kind == "ARRAY", F.transform(listed, _item))
        .when(blank | (kind == "VOID"), none)
        .otherwise(F.array(_item(declared)))
    )


def _document(body: Column) -> Column:
    """The one JSON document of a block; NULL if anything follows it.

    The parser stops at the end of a document, so the block is read as the only member of a list as well.
    """
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(alone) == 1, F.try_parse_json(body))


def _block_items(body: Column) -> Column:
    doc = _document(body)
    graph = F.try_variant_get(doc, '$["@graph"]', "variant")
    members = F.try_variant_get(graph, "$", "array<variant>")
    # Members after the first one that is not an object are not reached.
    bad = F.array_position(F.transform(members, _is_object), False)
    usable = F.when(bad > 0, F.slice(members, F.lit(1), (bad - 1).cast("int"))).otherwise(members)
    none = F.array().cast(f"array<{_ITEM}>")
    from_graph = F.when(
        _kind(graph) == "ARRAY", F.flatten(F.transform(usable, _node_items))
    ).otherwise(none)
    return (
        F.when(doc.isNull() | ~_is_object(doc), none)
        .when(graph.isNotNull(), from_graph)
        .otherwise(_node_items(doc))
    )


def jsonld_items(blocks: Column) -> Column:
    """Declared types over all blocks as (kind, name), in document order, duplicates kept."""
    return F.flatten(F.transform(blocks, _block_items))


def jsonld_types(items: Column) -> Column:
    return F.transform(items, lambda i: i["name"])


def of_grade(items: Column, names: list[str]) -> Column:
    """String types that belong to ``names``, in order, duplicates kept."""
    graded = F.filter(
        items, lambda i: (i["kind"] == "STRING") & F.array_contains(str_array(names), i["name"])
    )
    return F.transform(graded, lambda i: i["name"])


def has_unhashable(items: Column) -> Column:
    """An object or list used as a type: grading such a page is not possible."""
    return F.exists(items, lambda i: i["kind"].isin("OBJECT", "ARRAY"))


def has_nonstring(items: Column) -> Column:
    return F.exists(items, lambda i: i["kind"] != "STRING")


def type_grade(name: Column) -> Column:
    return (
        F.when(name.isin(*HIGH_VALUE_TYPES), "high_value")
        .when(name.isin(*GENERIC_TYPES), "generic")
        .otherwise("other")
    )
