"""Scores, bands, counters and ranked fixes.

A site's findings travel as one array, so scoring and ranking work inside the
row. The long-form variants serve stored ``check_results``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlgauge.registry import BUILTIN, FAIL, PASS, WARNING, Check, max_total

# Lower bounds and names of the readiness bands.
BANDS = [(80, "Agent-Ready"), (60, "Above Average"), (40, "Average"), (20, "Below Average")]
LOWEST_BAND = "Not Ready"


def band(score: Column) -> Column:
    chain = None
    for floor, name in BANDS:
        chain = F.when(score >= floor, name) if chain is None else chain.when(score >= floor, name)
    return chain.otherwise(LOWEST_BAND)


def status_tag(status: Column) -> Column:
    return F.when(status == PASS, "PASS").when(status == WARNING, "WARN").otherwise("FAIL")


def status_icon(status: Column) -> Column:
    return F.when(status == PASS, "✓").when(status == WARNING, "⚠").when(status == FAIL, "✕")


def percent_half_even(raw: Column, total: Column) -> Column:
    """raw as a whole percentage of total; exact halves go to the even neighbour."""
    return F.bround(raw * F.lit(100) / total).cast("int")


def _sum_points(checks: Column, field: str) -> Column:
    return F.aggregate(checks, F.lit(0), lambda acc, c: acc + c[field])


def _count_status(checks: Column, status: str) -> Column:
    return F.size(F.filter(checks, lambda c: c["status"] == status))


def ranked_fixes(checks: Column) -> Column:
    """Findings that are not a pass, most points lost first, ties in registry order."""
    open_items = F.filter(checks, lambda c: c["status"] != PASS)
    keyed = F.transform(
        open_items,
        lambda c: F.struct((-c["points_lost"]).alias("k"), c["check_idx"].alias("i"), c.alias("c")),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def with_score(audited: DataFrame) -> DataFrame:
    """Add score, band, totals and counters next to ``checks``."""
    checks = F.col("checks")
    totals = audited.select(
        "*",
        _sum_points(checks, "points_earned").alias("raw_points"),
        _sum_points(checks, "points_max").alias("max_points"),
        _count_status(checks, PASS).alias("n_pass"),
        _count_status(checks, WARNING).alias("n_warning"),
        _count_status(checks, FAIL).alias("n_fail"),
    )
    score = percent_half_even(F.col("raw_points"), F.col("max_points"))
    return totals.withColumn("score", score).withColumn("band", band(F.col("score")))


SCORE_COLUMNS = [
    "scan_id", "url", "raw_points", "max_points", "score", "band", "n_pass", "n_warning", "n_fail",
]


def scan_scores(audited: DataFrame) -> DataFrame:
    return with_score(audited).select(*SCORE_COLUMNS)


def score_results(results: DataFrame) -> DataFrame:
    """scan_scores from stored long-form results: one partial aggregation, integers only."""
    totals = results.groupBy("scan_id").agg(
        F.max("url").alias("url"),
        F.sum("points_earned").cast("int").alias("raw_points"),
        F.sum("points_max").cast("int").alias("max_points"),
        *[
            F.count_if(F.col("status") == s).cast("int").alias(f"n_{s}")
            for s in (PASS, WARNING, FAIL)
        ],
    )
    score = percent_half_even(F.col("raw_points"), F.col("max_points"))
    scored = totals.withColumn("score", score).withColumn("band", band(F.col("score")))
    return scored.select(*SCORE_COLUMNS)


def recommendations(audited: DataFrame) -> DataFrame:
    """Ranked fixes, numbered from 1 within each scan."""
    ranked = audited.select("scan_id", "url", F.posexplode(ranked_fixes(F.col("checks"))))
    return ranked.select("scan_id", "url", (F.col("pos") + 1).alias("rank"), "col.*")


def rank_results(results: DataFrame) -> DataFrame:
    """recommendations from stored long-form results (a scan has one row per check)."""
    w = W.partitionBy("scan_id").orderBy(F.col("points_lost").desc(), F.col("check_idx"))
    return results.filter(F.col("status") != PASS).withColumn("rank", F.row_number().over(w))


def progress(results: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """Share of checks done per scan in percent, halves rounded up."""
    done = results.groupBy("scan_id").agg(F.count("*").alias("n_done"))
    pct = F.floor(F.col("n_done") * 100 / F.lit(len(checks)) + F.lit(0.5)).cast("int")
    return done.withColumn("progress_pct", pct)


def points_of(status: Column, points_max: Column) -> Column:
    """Full points for a pass, half rounded down for a warning, none otherwise."""
    half = F.floor(points_max / 2).cast("int")
    return F.when(status == PASS, points_max).when(status == WARNING, half).otherwise(0)


__all__ = [
    "band", "max_total", "points_of", "progress", "rank_results", "ranked_fixes",
    "recommendations", "scan_scores", "score_results", "status_icon", "status_tag", "with_score",
]
