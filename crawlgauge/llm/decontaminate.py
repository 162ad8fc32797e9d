"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every run of K words is hashed and every window of W consecutive hashes keeps its smallest, so two
texts that share K + W - 1 = SPAN words share at least one kept hash. Kept hashes of documents are
joined with those of the benchmark; each hit gives a diagonal (document position minus item position)
along which the item's windows are compared word by word, so the result is exact. An item shorter than
SPAN words is one window; documents then keep all hashes of that length.

Words are found after lower-casing A-Z. Work between the scans is on distinct texts: copies of one text
share one result. Tables are broadcast only after their rows were counted; beyond BROADCAST_ROWS the same
joins are shuffled.

Defined cases: a null or empty text has no words, no hits and is not contaminated; an item without
words never occurs; equal item ids count once; a null item id reads as the empty string; an empty
benchmark leaves every document clean; further columns of the documents are kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import materialize

SPAN = 13
K = 8
W = SPAN - K + 1
# Rows of a table that may be sent to every task; a row has under 100 bytes.
BROADCAST_ROWS = 200_000
# Characters between words, as a Java pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_KEY = ["_k1", "_k2"]


def words(text: Column) -> Column:
    """Words after lower-casing A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _joined(a: str, b: str, shift: int, fn) -> Column:
    """fn over a[i] and b[i + shift] for every i that has both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), fn)


def with_grams(df: DataFrame, lengths: set[int], column: str = "_words") -> DataFrame:
    """Add ``_h<n>``: the hash of the n words from each position, for every length asked for."""
    df = df.withColumn("_h1", F.transform(column, lambda w: F.xxhash64(w)))
    for n in range(2, max(lengths, default=1) + 1):
        # Powers of two on the way to a larger length, and the lengths themselves from two powers.
        half = n // 2 if n & (n - 1) == 0 else 1 << (n.bit_length() - 1)
        needed = n in lengths or (n & (n - 1) == 0 and any(m > n for m in lengths))
        if needed:
            rest = _rest(n, half)
            df = df.withColumn(f"_h{n}", _joined(f"_h{half}", f"_h{rest}", n - rest, lambda x, y: F.xxhash64(x, y)))
    return df.drop(*(f"_h{n}" for n in range(1, max(lengths, default=1) + 1) if n not in lengths))


def _rest(n: int, half: int) -> int:
    """The second power for length n: it may overlap the first, both together cover all n words."""
    return half if n - half <= half else n - half


def with_minima(df: DataFrame, hashes: str = f"_h{K}", width: int = W) -> DataFrame:
    """Add ``_kept``: the distinct smallest hashes of every window of ``width`` hashes."""
    smaller = lambda x, y: F.least(x, y)
    df, have = df.withColumn("_m", F.col(hashes)), 1
    while have < width:
        step = min(have, width - have)
        df, have = df.withColumn("_m", _joined("_m", "_m", step, smaller)), have + step
    return df.withColumn("_kept", F.array_distinct("_m")).drop("_m")


def _items(benchmark: DataFrame) -> DataFrame:
    named = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("_item")
    )
    return (
        named.filter(F.size("_item") > 0)
        .distinct()
        .withColumns({"_n": F.size("_item"), "_span": F.least(F.size("_item"), F.lit(SPAN))})
    )


def _item_prints(items: DataFrame, lengths: set[int]) -> DataFrame:
    """(fp, _at) of every item: the positions of its kept hashes, or its only window."""
    grams = with_minima(with_grams(items, lengths | {K}, "_item"))
    kept = F.filter(
        F.transform(f"_h{K}", lambda h, i: F.struct(h.alias("fp"), i.alias("at"))),
        lambda s: F.array_contains(F.col("_kept"), s["fp"]),
    )
    prints = F.when(F.col("_n") >= SPAN, kept)
    for n in sorted(lengths):
        whole = F.transform(f"_h{n}", lambda h, i: F.struct(h.alias("fp"), i.alias("at")))
        prints = prints.when(F.col("_n") == n, whole)
    return grams.select("item_id", "_item", "_n", "_span", F.explode(prints).alias("_p")).select(
        "item_id", "_item", "_n", "_span", F.col("_p.fp").alias("fp"), F.col("_p.at").alias("_at")
    )


def _sized(df: DataFrame) -> DataFrame:
    """Mark a stored table for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per distinct text with a hit: _k1, _k2, n_hit, n_items, items (sorted ids)."""
    items = materialize(_items(benchmark), "benchmark-items")
    # At most SPAN - 1 lengths below SPAN exist.
    lengths = {r["_n"] for r in items.filter(F.col("_n") < SPAN).select("_n").distinct().collect()}
    prints = materialize(_item_prints(items, lengths), "benchmark-prints")
    texts = _keyed(docs.select("text").filter("text != ''"))

    tokenised = texts.select(*_KEY, words(F.col("text")).alias("_words"))
    grams = with_minima(with_grams(tokenised, lengths | {K}))
    short = [F.array_distinct(f"_h{n}") for n in sorted(lengths)]
    found = (
        grams.select(*_KEY, F.explode(F.concat("_kept", *short)).alias("fp"))
        .join(_sized(prints.select("fp").distinct()), "fp", "left_semi")
        .select(*_KEY)
        .distinct()
    )
    candidates = _sized(materialize(found, "candidate-texts"))
    hit_texts = materialize(
        texts.join(candidates, _KEY, "left_semi")
        .groupBy(*_KEY)
        .agg(F.first("text").alias("text"))
        .select(*_KEY, words(F.col("text")).alias("_words")),
        "candidate-words",
    )

    at = with_grams(hit_texts, lengths | {K}).select(
        *_KEY, F.explode(F.array(*(F.col(f"_h{n}") for n in sorted(lengths | {K})))).alias("_h")
    )
    diagonals = (
        at.select(*_KEY, F.posexplode("_h").alias("_pos", "fp"))
        .join(_sized(prints.drop("_item")), "fp")
        .select(*_KEY, "item_id", "_n", (F.col("_pos") - F.col("_at")).alias("_d"))
        .distinct()
    )
    pairs = diagonals.join(hit_texts, _KEY).join(_sized(items), ["item_id", "_n"])
    same = lambda j: (
        (j + F.col("_d") >= 0)
        & (j + F.col("_d") + F.col("_span") <= F.size("_words"))
        & (
            F.slice("_words", F.greatest(j + F.col("_d"), F.lit(0)) + 1, F.col("_span"))
            == F.slice("_item", j + 1, F.col("_span"))
        )
    )
    starts = F.filter(F.sequence(F.lit(0), F.col("_n") - F.col("_span")), same)
    inside = F.transform(starts, lambda j: F.sequence(j + F.col("_d"), j + F.col("_d") + F.col("_span") - 1))
    return (
        pairs.select(*_KEY, "item_id", F.explode(F.array_distinct(F.flatten(inside))).alias("_pos"))
        .groupBy(*_KEY)
        .agg(F.count_distinct("_pos").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
        .withColumn("n_items", F.size("items").cast("long"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items and contaminated.

    A document is contaminated if it has hits and they are at least one in twenty of its words.
    """
    hits = _sized(materialize(occurrences(docs, benchmark), "contaminated-texts"))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items", "contaminated")]
    counted = _keyed(docs.select(*own)).withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    zero = F.lit(0).cast("long")
    out = counted.join(hits, _KEY, "left").drop(*_KEY)
    out = out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", zero),
            "n_items": F.coalesce("n_items", zero),
            "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
