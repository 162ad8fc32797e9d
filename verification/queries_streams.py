"""Streaming queries: the fixture resources written as files and read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.operators import scoring
from crawlgauge.operators.audit import check_results
from crawlgauge.plans.session import scratch_path
from crawlgauge.sources.tables import resource_stream
from crawlgauge.streaming import audit_stream as st
from verification.base import query


# Files of a step; a batch reads one step, in parallel.
FILES = 8


def beats_of(frame: DataFrame) -> DataFrame:
    """A heartbeat row in every file of its step."""
    return frame.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(FILES)))).drop("_copy")


# Longer than all scans of the fixture together, for steps that deliver a part of every scan.
ALL_SCANS = "3650 days"
# A heartbeat's scan and start.
BEAT, FAR = -1, 4102444800000000


def with_start(frame: DataFrame) -> DataFrame:
    """The start of each scan of the fixture: one a minute."""
    first = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return frame.withColumn("started_at", F.timestamp_micros(first + F.col("scan_id") * 60_000_000))


def staged(d, frames: list[DataFrame], heartbeats: bool = False, path: str | None = None) -> DataFrame:
    """Each frame as one arriving file set, in order; heartbeats at the end close all scans.

    A heartbeat is a resource of a scan that started far in the future: the last one stays open.
    """
    path = path or scratch_path(d.spark, "arriving")
    beat = d.pages.limit(1).select(
        F.lit(BEAT).cast("bigint").alias("scan_id"), "url", F.lit("/robots.txt").alias("path"),
    )
    beats = [
        beat.select(
            "scan_id", F.col("url").alias("site_url"), "path", F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("final_url"), F.create_map().cast("map<string,string>").alias("headers"),
            F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("error"),
            F.timestamp_micros(F.lit(FAR) + F.lit(n)).alias("fetched_at"),
            F.timestamp_micros(F.lit(FAR) + F.lit(n)).alias("started_at"),
        )
        for n in range(2)
    ]
    columns = beats[0].columns
    for n, frame in enumerate([*frames, *(map(beats_of, beats) if heartbeats else [])]):
        # One directory per step: a glob reads them as one source, oldest files first.
        frame = frame if "started_at" in frame.columns else with_start(frame)
        frame.select(*columns).repartition(FILES).write.parquet(f"{path}/step={n}")
    return resource_stream(d.spark, f"{path}/step=*", FILES)


def drained(d, stream: DataFrame, name: str):
    """Run a stream over everything that has arrived; returns its output and the query."""
    out = scratch_path(d.spark, name)
    running = run(d, stream, out, scratch_path(d.spark, f"{name}-state"))
    return d.spark.read.schema(stream.schema).parquet(out), running


def run(d, stream: DataFrame, out: str, state: str, fmt: str = "parquet"):
    """State partitions are fixed when a stream starts, so they are sized to the cores here."""
    before = d.spark.conf.get("spark.sql.shuffle.partitions")
    d.spark.conf.set("spark.sql.shuffle.partitions", str(d.spark.sparkContext.defaultParallelism))
    try:
        running = st.run_to_sink(stream, out, state, fmt)
        running.awaitTermination()
    finally:
        d.spark.conf.set("spark.sql.shuffle.partitions", before)
    return running


_CHECKS = """
SELECT scan_id, 'check' AS event_type, url, key, status, reason, CAST(points_earned AS INTEGER) AS points_earned, detail, action,
  CAST(NULL AS INTEGER) AS score, CAST(NULL AS VARCHAR) AS band, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS INTEGER) AS n_fixes
FROM results"""
_EVENTS = f"""
SELECT * REPLACE (CAST(NULL AS VARCHAR) AS url) FROM ({_CHECKS})
UNION ALL
SELECT scan_id, 'complete', url, NULL, NULL, NULL, NULL, NULL, NULL, score, band, NULL,
  (SELECT CAST(count(*) AS INTEGER) FROM recs r WHERE r.scan_id = s.scan_id) FROM scores s
UNION ALL
SELECT scan_id, 'error', url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error, NULL FROM errors"""
_CHECK_COLUMNS = ["scan_id", "event_type", "key", "status", "reason", "points_earned", "detail", "action"]
_ONLY_CHECKS = f"SELECT {', '.join(_CHECK_COLUMNS)} FROM ({_CHECKS})"
_COLUMNS = [*_CHECK_COLUMNS, "url", "score", "band", "error"]


@query("stream_checks", _ONLY_CHECKS)
def _(d):
    """All twelve checks of every usable scan, each as soon as it can be told."""
    out, _ = drained(d, st.audit_events(staged(d, [d.resources], True)), "events")
    return out.filter("event_type = 'check'").select(*_CHECK_COLUMNS)


@query("event_sink", _EVENTS)
def _(d):
    """The whole event table as JSON lines: checks, completions with their document, errors."""
    stream = st.audit_events(staged(d, [d.resources], True))
    out = scratch_path(d.spark, "event-lines")
    run(d, stream, out, scratch_path(d.spark, "event-lines-state"), "json")
    events = d.spark.read.schema(stream.schema).json(out).filter(F.col("scan_id") != BEAT)
    fixes = F.try_variant_get(F.try_parse_json("document"), "$.recommendations", "array<variant>")
    n_fixes = F.when(F.col("document").isNotNull(), F.size(fixes))
    return events.select(*_COLUMNS, n_fixes.alias("n_fixes"))


@query("stream_errors", "SELECT scan_id, 'error' AS event_type, url, error FROM errors")
def _(d):
    out, _ = drained(d, st.error_events(staged(d, [d.resources])), "errors")
    return out.select("scan_id", "event_type", "url", "error")


_SCORES = "SELECT scan_id, url, raw_points, max_points, score, band, n_pass, n_warning, n_fail FROM scores"


@query("stream_complete", _SCORES)
def _(d):
    out, _ = drained(d, st.completed_sites(staged(d, [d.resources], True)), "sites")
    return scoring.scan_scores(out)


@query("stream_parity", "SELECT scan_id, key, status, reason, detail FROM results")
def _(d):
    """Scans of zero, half, twenty and forty minutes, every third delivered twice: the result is that of the batch."""
    pace = F.element_at(F.array(*[F.lit(n) for n in (0, 1_500_000, 60_000_000, 120_000_000)]), F.pmod(F.col("scan_id"), F.lit(4)).cast("int") + 1)
    slow = with_start(d.resources)
    nth = F.unix_micros("fetched_at") - F.unix_micros("started_at")
    slow = slow.withColumn("fetched_at", F.timestamp_micros((F.unix_micros("started_at") + nth / 1_000_000 * pace).cast("bigint")))
    # The first half hour of every scan arrives before the rest of any.
    first = F.col("fetched_at") < F.col("started_at") + F.expr("INTERVAL 30 MINUTES")
    again = slow.filter(F.col("scan_id") % 3 == 0)
    out, _ = drained(d, st.completed_sites(staged(d, [slow.filter(first), slow.filter(~first), again], True), scan_time=ALL_SCANS), "sites")
    return check_results(out).select("scan_id", "key", "status", "reason", "detail")


@query("stream_dedup", _ONLY_CHECKS)
def _(d):
    """Every third scan is delivered twice at once, yet each of its events is emitted once."""
    again = d.resources.filter(F.col("scan_id") % 3 == 0)
    stream = staged(d, [d.resources.unionByName(again)], True)
    out, _ = drained(d, st.audit_events(stream), "events")
    return out.filter("event_type = 'check'").select(*_CHECK_COLUMNS)


@query("stream_late", """
SELECT CAST(count(*) AS BIGINT) AS n_late_scans, CAST(sum(CASE WHEN path = '/' THEN 1 ELSE 2 END) AS BIGINT) AS n_dropped, 0 AS n_late_sites
FROM res WHERE scan_id % 10 = 0 AND path IN ('/', '/robots.txt')""".replace("count(*)", "count(DISTINCT scan_id)"))
def _(d):
    """Resources that arrive after their scan has closed are dropped and counted, however many come of one scan."""
    late = with_start(d.resources.filter((F.col("scan_id") % 10 == 0) & F.col("path").isin("/", "/robots.txt")))
    moved = late.withColumn("scan_id", F.col("scan_id") + 1_000_000_000)
    twice = moved.filter(F.col("path") == "/robots.txt")
    on_time = d.resources.filter(F.col("path") == "/")
    far = F.timestamp_micros(F.lit(FAR))
    beat = with_start(on_time.limit(1)).withColumn("fetched_at", far).withColumn("started_at", far)
    beats = [beats_of(beat.withColumn("scan_id", F.lit(-n).cast("bigint"))) for n in (2, 3)]
    path = scratch_path(d.spark, "arriving")
    rows = st.arriving(staged(d, [on_time, *beats, moved, twice], path=path))
    closed, _ = drained(d, st.closed_scans(rows), "sites")
    arrived = d.spark.read.parquet(f"{path}/step=*")
    counts = st.late_resources(arrived, closed).agg(
        F.count("*").alias("n_late_scans"), F.coalesce(F.sum("n_late"), F.lit(0)).alias("n_dropped")
    )
    late_sites = closed.filter(F.col("scan_id") >= 1_000_000_000).agg(F.count("*").cast("int").alias("n_late_sites"))
    return counts.crossJoin(late_sites)
