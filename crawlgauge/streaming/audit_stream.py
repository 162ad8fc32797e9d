"""The same audit over a stream of arriving resources, as one table of events.

Every resource carries the time its scan started. That start is the event time of all its rows, so a scan is one
group however long it runs and whatever pauses it makes; it closes once the watermark passes, i.e. when scans that
started ``SCAN_TIME`` later arrive. SCAN_TIME is thus the longest a scan may take to arrive in full.

  check     as soon as its input is there: page checks with the homepage, checks of text files once the homepage is
            known to be usable; the checks over several resources, and those of text files that never came, when the
            scan closes
  complete  when a scan closes: score, band and the result as a document
  error     when a scan closes without a usable homepage, one that comes too late included; such a scan has no checks

The result of a closed scan is that of the batch audit: aggregates are maxima over (fetch time, value), so
re-delivered resources change nothing there and copies of a hot scan merge map-side. Check events emitted before are
those of the first delivery. Rows are judged before they enter any state, which holds codes and reasons only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.urls import normalize_url
from crawlgauge.operators.audit import (
    TEXT_STAGES,
    VERDICT,
    failure,
    findings_of,
    fold_events,
    home_rows,
    judged_rows,
    of_stage,
    scannable,
    verdicts,
    worded,
)
from crawlgauge.operators.scoring import ranked_fixes, with_score
from crawlgauge.registry import BUILTIN, HOME, SITE, Check
from crawlgauge.sources.tables import HOME_PATH, PROBE_PATHS, TEXT_PATHS

# The longest time from the start of a scan to the arrival of its last resource.
SCAN_TIME = "2 hours"
STARTED = "started_at"
_UNION = "spark.sql.unionOutputPartitioning"
_SCAN = ["scan_id", STARTED]

EVENT = (
    "struct<event_type:string,url:string,key:string,status:string,reason:string,points_earned:int,detail:string,"
    "action:string,score:int,band:string,error:string,document:string>"
)
_EVENT_COLUMNS = [f.split(":")[0] for f in EVENT[len("struct<") : -1].split(",")]


def arriving(resources: DataFrame, scan_time: str = SCAN_TIME) -> DataFrame:
    """The stream with its watermark; a resource without a start counts as a scan started when it was fetched."""
    started = F.coalesce(STARTED, "fetched_at") if STARTED in resources.columns else F.col("fetched_at")
    return resources.withColumn(STARTED, started).withWatermark(STARTED, scan_time)


def dedup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Drop re-delivered rows; state per key expires with the watermark.

    Copies are first dropped per slice of the input, with as many slices as there are state partitions, so that a
    resource delivered very often is spread over all tasks and only one copy per slice goes on.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    per_slice = sliced.dropDuplicatesWithinWatermark([*keys, "_slice"])
    return per_slice.dropDuplicatesWithinWatermark(keys).drop("_slice")


def _emit(rows: DataFrame, outcomes: list[tuple[Check, Column]], checks: tuple[Check, ...]) -> DataFrame:
    raw = F.array(*[F.struct(F.lit(c.key).alias("key"), o.alias("o")) for c, o in outcomes])
    emitted = rows.select(*_SCAN, F.inline(F.filter(raw, lambda x: x["o"].isNotNull())))
    v = F.try_element_at(verdicts(checks), F.concat_ws(".", F.col("key"), F.col("o")["reason"]))
    judged = emitted.withColumn("v", v.cast(VERDICT))
    args = F.col("o")["args"]
    return judged.select(
        *_SCAN,
        F.lit("check").alias("event_type"),
        "key",
        F.col("v")["status"].alias("status"),
        F.col("o")["reason"].alias("reason"),
        F.col("v")["earned"].alias("points_earned"),
        worded(F.col("v")["detail"], args).alias("detail"),
        worded(F.col("v")["action"], args).alias("action"),
    )


def early_events(rows: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """Events of the checks on one resource, as they can first be told; ``rows`` come from ``arriving``.

    A resource is judged when it first arrives, re-delivered and late ones tell nothing.
    """
    judged = judged_rows(rows.filter(F.col("path").isin([HOME_PATH, *TEXT_PATHS])), checks, carry=(STARTED,))
    # Whether a homepage is usable is told without its body.
    usable = rows.filter((F.col("path") == HOME_PATH) & F.col("error").isNull() & (F.col("status") < 400))
    told = dedup(judged, [*_SCAN, "path"]).join(dedup(usable.select(*_SCAN), _SCAN), _SCAN)
    outcomes = [(c, F.when(scannable(), F.col("home")[c.key])) for c in of_stage(checks, HOME)]
    outcomes += [(c, F.col(c.key)) for s in TEXT_STAGES for c in of_stage(checks, s)]
    return _emit(told, outcomes, checks)


def closed_scans(rows: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """One row per closed scan: scored findings, or the reason why there are none."""
    sites = fold_events(judged_rows(rows, checks, carry=(STARTED,)), _SCAN, checks)
    url = F.coalesce(F.col("home")["url"], normalize_url(F.col("site_url")))
    found = sites.select(
        *_SCAN,
        url.alias("url"),
        "n_resources",
        "absent",
        F.when(scannable(), findings_of(checks)).alias("checks"),
        F.when(~scannable(), failure()).alias("error"),
    )
    return with_score(found)


def closing_events(closed: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """What is told when a scan closes: the remaining checks and its completion, or its error."""
    at_end = F.array(*[F.lit(c.key) for c in of_stage(checks, SITE)]).cast("array<string>")
    due = F.filter("checks", lambda c: F.array_contains(at_end, c["key"]) | F.array_contains(F.col("absent"), c["key"]))

    def event(kind: str, **values: Column) -> Column:
        fields = {"event_type": F.lit(kind), **values}
        return F.struct(*[fields.get(c, F.lit(None)).alias(c) for c in _EVENT_COLUMNS]).cast(EVENT)

    names = ("key", "status", "reason", "points_earned", "detail", "action")
    told = F.transform(due, lambda c: event("check", **{n: c[n] for n in names}))
    result = F.struct("url", "score", "checks", ranked_fixes(F.col("checks")).alias("recommendations"))
    done = event(
        "complete", url=F.col("url"), score=F.col("score"), band=F.col("band"), document=F.to_json(result)
    )
    failed = event("error", url=F.col("url"), error=F.col("error"))
    events = F.when(F.col("error").isNotNull(), F.array(failed)).otherwise(F.concat(told, F.array(done)))
    return closed.select(*_SCAN, F.inline(events))


def audit_events(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, scan_time: str = SCAN_TIME
) -> DataFrame:
    """The event table: check, complete and error events of all scans in one append stream."""
    rows = arriving(resources, scan_time)
    closing = closing_events(closed_scans(rows, checks), checks)
    return closing.unionByName(early_events(rows, checks), allowMissingColumns=True)


def completed_sites(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, scan_time: str = SCAN_TIME
) -> DataFrame:
    """One audited site per usable scan, emitted once the scan has closed."""
    closed = closed_scans(arriving(resources, scan_time), checks)
    return closed.filter(F.col("error").isNull()).select(*_SCAN, "url", "checks", "n_resources")


def error_events(resources: DataFrame) -> DataFrame:
    """An error event per failed homepage, as it arrives."""
    homes = home_rows(resources, (), links=False)
    failed = homes.filter(~scannable())
    return failed.select(
        "scan_id",
        "fetched_at",
        F.lit("error").alias("event_type"),
        F.col("home")["url"].alias("url"),
        failure().alias("error"),
    )


def late_resources(arrived: DataFrame, closed: DataFrame, scan_time: str = SCAN_TIME) -> DataFrame:
    """Resources that came after their scan had closed: scan_id, started_at, n_late.

    Counted from the stored rows of the stream and of ``closed_scans``, so any number of batches and restarts
    counts in full. ``arrived`` are the stream's source rows read as a table; scans that are still open are left out.
    """
    rows = resources_of_sites(arrived)
    if STARTED not in rows.columns:
        rows = rows.withColumn(STARTED, F.col("fetched_at"))
    rows = rows.withColumn(STARTED, F.coalesce(STARTED, "fetched_at"))
    came = rows.groupBy(*_SCAN).agg(F.count("*").alias("n"))
    taken = closed.select(*_SCAN, "n_resources")
    last = arrived.agg(F.max(F.coalesce(STARTED, "fetched_at") if STARTED in arrived.columns else "fetched_at").alias("last"))
    # One row: the watermark after the last batch.
    both = came.join(taken, _SCAN, "left").crossJoin(F.broadcast(last))
    over = F.col(STARTED) <= F.col("last") - F.expr(f"INTERVAL {scan_time}")
    late = F.col("n") - F.coalesce("n_resources", F.lit(0))
    return both.filter(over & (late > 0)).select(*_SCAN, late.alias("n_late"))


def resources_of_sites(resources: DataFrame) -> DataFrame:
    """Resources that a site row takes in."""
    return resources.filter(F.col("path").isin([HOME_PATH, *TEXT_PATHS, *PROBE_PATHS]))


def run_to_sink(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
):
    """Append a stream to files, exactly once per checkpoint; processes what is there and stops by default.

    Branches of a union keep tasks of their own in the stream: one task cannot hold the state stores of two.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_UNION)
    writer = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    spark.conf.set(_UNION, "false")
    try:
        # The query keeps the settings it starts with.
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_UNION, before)


__all__ = [
    "arriving", "audit_events", "closed_scans", "closing_events", "completed_sites", "dedup", "early_events",
    "error_events", "late_resources", "run_to_sink",
]
