"""Side-by-side comparisons of requested sites, site rankings and fleet-wide roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlgauge.functions.urls import normalize_url
from crawlgauge.operators.scoring import status_icon
from crawlgauge.registry import BUILTIN, Check, check_dim

DEFAULT_LIMIT = 3
ABSENT = "—"
TOTAL_LABEL = "Total Score"


def compare_requests(requests: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(compare_id, urls) to one row per requested URL; URLs past the limit are not compared."""
    rows = requests.select(
        "compare_id", F.posexplode(F.slice("urls", F.lit(1), F.lit(limit))).alias("ord", "url")
    )
    return rows.withColumn("url", normalize_url(F.col("url")))


def latest_scans(scans: DataFrame) -> DataFrame:
    """The most recent scan (highest scan_id) of each URL; reads and shuffles two columns only."""
    return scans.groupBy("url").agg(F.max("scan_id").alias("scan_id"))


def result_or_error(scored: DataFrame, errors: DataFrame, columns: list[str]) -> DataFrame:
    """Result rows and error rows in one table; an error row has NULL results."""
    ok = scored.select("scan_id", "url", *columns)
    return ok.unionByName(errors.select("scan_id", "url", "error"), allowMissingColumns=True)


def compare(
    requests: DataFrame,
    scored: DataFrame,
    errors: DataFrame,
    limit: int = DEFAULT_LIMIT,
    columns: tuple[str, ...] = ("score", "band", "checks"),
) -> DataFrame:
    """One row per requested URL in request order, duplicates and failures kept.

    A matrix of more than the default number of sites needs the same ``limit``.

    ``scored`` and ``errors`` are read twice and so should be stored tables: once
    for the latest scan of each URL, once for the results of the scans asked for.
    Popular URLs may be named by very many requests: the right side of both joins
    is unique, so adaptive execution splits their rows. The results side is reduced
    to the scans asked for before its wide columns move. Nothing runs until the
    result is read; what both uses of the asked rows share is exchanged once.
    """
    known = result_or_error(scored, errors, list(columns))
    asked = compare_requests(requests, limit).join(latest_scans(known), "url", "left")
    wanted = asked.select("scan_id").distinct()
    picked = known.join(wanted, "scan_id", "left_semi").drop("url")
    rows = asked.join(picked, "scan_id", "left")
    missing = F.when(F.col("scan_id").isNull(), F.lit("not scanned"))
    return rows.withColumn("error", F.coalesce("error", missing))


def _cell(status: Column, earned: Column, top: Column) -> Column:
    return F.concat(status_icon(status), F.lit(" "), earned.cast("string"), F.lit("/"), top.cast("string"))


def _cells(checks: tuple[Check, ...], find) -> Column:
    """Every check of the registry as a cell; ``find`` gives its finding, NULL where there is none."""
    def shown(c: Column) -> Column:
        return F.coalesce(_cell(c["status"], c["points_earned"], c["points_max"]), F.lit(ABSENT))

    return F.array(*[shown(find(c.key)) for c in checks])


def compare_matrix(
    compared: DataFrame, limit: int = DEFAULT_LIMIT, checks: tuple[Check, ...] = BUILTIN
) -> DataFrame:
    """One row per comparison and check with one column per site, then a total row.

    The cells of a site are built in its row; one aggregation puts the at most ``limit`` sites of a comparison side
    by side, and its rows are read off there. A site at or beyond ``limit`` has no column: it is an error, not left out.
    """
    beyond = F.raise_error(F.concat(F.lit(f"compare_matrix has a limit of {limit} sites but got site "), F.col("ord").cast("string")))

    def find(key: str) -> Column:
        return F.try_element_at(F.filter("checks", lambda c: c["key"] == key), F.lit(1))

    total = F.coalesce(F.concat(F.col("score").cast("string"), F.lit("/100")), F.lit(ABSENT))
    sites = compared.select(
        "compare_id",
        F.when(F.col("ord") >= limit, beyond).otherwise(F.col("ord")).alias("ord"),
        F.concat(_cells(checks, find), F.array(total)).alias("cells"),
    )
    columns = [F.max(F.when(F.col("ord") == i, F.col("cells"))).alias(f"site_{i}") for i in range(limit)]
    side_by_side = sites.groupBy("compare_id").agg(*columns)
    heads = [(i, c.key, c.label) for i, c in enumerate(checks)] + [(len(checks), "total", TOTAL_LABEL)]
    rows = [
        F.struct(
            F.lit(i).alias("check_idx"), F.lit(key).alias("key"), F.lit(label).alias("label"),
            *[F.col(f"site_{n}")[i].alias(f"site_{n}") for n in range(limit)],
        )
        for i, key, label in heads
    ]
    return side_by_side.select("compare_id", F.inline(F.array(*rows)))


def compare_lookup(
    requested: DataFrame, results: DataFrame, checks: tuple[Check, ...] = BUILTIN
) -> DataFrame:
    """Every check of each requested scan next to stored results: absent ones show as a dash.

    Results are gathered to one row per scan before anything is joined, so a scan is one row of the exchange.
    """
    finding = F.struct("status", "points_earned", "points_max")
    gathered = results.groupBy("scan_id").agg(
        *[F.max(F.when(F.col("key") == c.key, finding)).alias(f"_{i}") for i, c in enumerate(checks)]
    )
    cells = _cells(checks, lambda key: F.col(f"_{[c.key for c in checks].index(key)}"))
    joined = requested.join(gathered, "scan_id", "left").select("scan_id", cells.alias("cells"))
    rows = [
        F.struct(F.lit(i).alias("check_idx"), F.lit(c.key).alias("key"), F.col("cells")[i].alias("cell"))
        for i, c in enumerate(checks)
    ]
    return joined.select("scan_id", F.inline(F.array(*rows)))


def rank_sites(scores: DataFrame, group: str) -> DataFrame:
    """Competition rank by score within each group, however large a group is.

    Scores are whole numbers from 0 to 100, so a group has at most 101 distinct
    ones: the window runs over that histogram, never over the sites themselves.
    ``scores`` is read twice, for the histogram and for the join with the ranks,
    whose rows are unique: a hot group's sites are split by adaptive execution.
    """
    hist = scores.groupBy(group, "score").agg(F.count("*").alias("_n"))
    above = W.partitionBy(group).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = hist.select(
        F.struct(F.col(group), F.col("score")).alias("_k"),
        (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"),
    )
    keyed = scores.withColumn("_k", F.struct(F.col(group), F.col("score")))
    return keyed.join(ranks, "_k").drop("_k")


def fleet_rollup(results: DataFrame) -> DataFrame:
    """Status shares per check, per effort level and overall, across all audited sites.

    Counts are reduced to one row per check first; the roll-up then runs on those few rows.
    """
    per_check = results.groupBy("effort_level", "key").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warning", "fail")],
        F.sum("points_earned").alias("earned"),
    )
    rolled = per_check.rollup("effort_level", "key").agg(
        F.sum("n").alias("n_results"),
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("pass", "warning", "fail")],
        F.sum("earned").alias("earned"),
    )
    share = {
        f"pct_{s}": F.round(F.col(f"n_{s}") * 100 / F.col("n_results"), 4)
        for s in ("pass", "warning", "fail")
    }
    return rolled.select(
        "effort_level",
        "key",
        "n_results",
        "n_pass",
        "n_warning",
        "n_fail",
        *[c.alias(n) for n, c in share.items()],
        F.round(F.col("earned") / F.col("n_results"), 4).alias("avg_points_earned"),
    )


def dim_join(results: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """Bare outcomes (scan_id, key, status) enriched with label, points and effort."""
    dim = check_dim(results.sparkSession, checks)
    return results.join(F.broadcast(dim), "key")
