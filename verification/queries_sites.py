"""Queries over assembled sites: joins, aggregates, rankings, sub-pages, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgauge.functions.outcomes import API_PATHS, MCP_PATHS
from crawlgauge.functions.text import latin1_clean
from crawlgauge.operators import audit, compare, reports, scoring, subpages
from crawlgauge.operators.signals import page_facts
from crawlgauge.plans.session import materialize, scratch_path
from crawlgauge.sources import sinks
from crawlgauge.sources.tables import HOME_PATH, TEXT_PATHS
from verification import fixtures as fx
from verification import oracle as o
from verification.base import query

AS_OF = "2024-06-30"


# --- joins and errors -----------------------------------------------------------------------




@query("site_resources", f"""
SELECT h.scan_id, len_all AS text_len, coalesce(a.found, '') AS api, coalesce(m.found, '') AS mcp, coalesce(g.found, '') AS gated,
  oc.reason AS robots FROM home_facts h LEFT JOIN api_found a USING (scan_id) LEFT JOIN mcp_found m USING (scan_id)
LEFT JOIN gated_found g USING (scan_id) JOIN outcomes oc ON oc.scan_id = h.scan_id AND oc.key = 'ai_crawler_access'""")
def _(d):
    from crawlgauge.functions.outcomes import API_PATHS, KEY_PATHS, MCP_PATHS, named_hits

    sites = audit.scannable_sites(audit.assemble(d.resources, links=False, failed=False))
    return sites.select(
        "scan_id",
        F.col("home")["text_len_all"].cast("bigint").alias("text_len"),
        F.array_join(named_hits(F.col("api"), API_PATHS), ", ").alias("api"),
        F.array_join(named_hits(F.col("mcp"), MCP_PATHS), ", ").alias("mcp"),
        F.array_join(named_hits(F.col("gated"), KEY_PATHS), ", ").alias("gated"),
        F.col("ai_crawler_access")["reason"].alias("robots"),
    )


@query("failed_sites", "SELECT scan_id, url, error FROM errors")
def _(d):
    return d.errors


@query("scannable_sites", "SELECT scan_id, url FROM ok_home")
def _(d):
    sites = audit.scannable_sites(audit.assemble(d.resources, (), links=False, failed=False))
    return sites.select("scan_id", F.col("home")["url"].alias("url"))


@query("check_results", """
SELECT scan_id, url, CAST(check_idx AS INTEGER) AS check_idx, key, label, status, reason, CAST(points_earned AS INTEGER) AS points_earned,
  CAST(points_max AS INTEGER) AS points_max, CAST(points_lost AS INTEGER) AS points_lost, detail, action, effort_level, effort_time FROM results""")
def _(d):
    return d.results


@query("points", "SELECT status, CAST(points_max AS INTEGER) AS points_max, CAST(points_earned AS INTEGER) AS points_earned, CAST(points_lost AS INTEGER) AS points_lost, count(*) AS n FROM results GROUP BY ALL")
def _(d):
    earned = scoring.points_of(F.col("status"), F.col("points_max"))
    bare = d.results.select("status", "points_max", earned.alias("points_earned"))
    out = bare.withColumn("points_lost", F.col("points_max") - F.col("points_earned"))
    return out.groupBy("status", "points_max", "points_earned", "points_lost").agg(F.count("*").alias("n"))


@query("max_total", "SELECT CAST(max_points AS INTEGER) AS max_points, count(*) AS n_sites FROM scores GROUP BY 1")
def _(d):
    return scoring.scan_scores(d.audited).groupBy("max_points").agg(F.count("*").alias("n_sites"))


@query("check_order", "SELECT scan_id, array_to_string(list(key ORDER BY check_idx), '|') AS keys FROM results GROUP BY scan_id")
def _(d):
    return d.audited.select("scan_id", F.array_join(F.transform("checks", lambda c: c["key"]), "|").alias("keys"))


# --- scores ---------------------------------------------------------------------------------

_SCORES = "SELECT scan_id, url, raw_points, max_points, score, band, n_pass, n_warning, n_fail FROM scores"


@query("score", _SCORES)
def _(d):
    return scoring.scan_scores(d.audited)


@query("score_from_results", _SCORES)
def _(d):
    return scoring.score_results(d.results)


@query("score_band", "SELECT band, count(*) AS n_sites, min(score) AS low, max(score) AS high FROM scores GROUP BY band")
def _(d):
    scored = scoring.scan_scores(d.audited)
    return scored.groupBy("band").agg(
        F.count("*").alias("n_sites"), F.min("score").alias("low"), F.max("score").alias("high")
    )


@query("status_counts", "SELECT scan_id, n_pass, n_warning, n_fail FROM scores")
def _(d):
    return scoring.scan_scores(d.audited).select("scan_id", "n_pass", "n_warning", "n_fail")


@query("progress", """
SELECT scan_id, count(*) AS n_done, CAST(round(count(*) * 100.0 / 12) AS INTEGER) AS progress_pct FROM results
WHERE check_idx <= scan_id % 12 GROUP BY scan_id""")
def _(d):
    """Scans caught part-way: only the first checks have reported."""
    so_far = d.results.filter(F.col("check_idx") <= F.col("scan_id") % 12)
    return scoring.progress(so_far)


_RECS = """SELECT scan_id, url, rank, CAST(check_idx AS INTEGER) AS check_idx, key, label, status, reason, CAST(points_earned AS INTEGER) AS points_earned,
  CAST(points_max AS INTEGER) AS points_max, CAST(points_lost AS INTEGER) AS points_lost, detail, action, effort_level, effort_time FROM recs"""


@query("recommendations", _RECS)
def _(d):
    return scoring.recommendations(d.audited)


@query("recommendations_from_results", _RECS)
def _(d):
    return scoring.rank_results(d.results)


_NESTED = """
SELECT s.scan_id, s.url, s.score, s.band, r.checks, coalesce(f.fixes, '') AS fixes, coalesce(p.pages, '') AS subpages FROM scores s
JOIN (SELECT scan_id, array_to_string(list(key || '=' || status || ':' || points_earned ORDER BY check_idx), '|') AS checks FROM results GROUP BY scan_id) r USING (scan_id)
LEFT JOIN (SELECT scan_id, array_to_string(list(key ORDER BY rank), '|') AS fixes FROM recs GROUP BY scan_id) f USING (scan_id)
LEFT JOIN (SELECT scan_id, array_to_string(list(page_type || '>' || page_url || '>' || cs ORDER BY pos), '|') AS pages FROM (
    SELECT scan_id, pos, page_type, page_url, array_to_string(list(key || '=' || status ORDER BY ord), ',') AS cs FROM subs GROUP BY ALL)
  GROUP BY scan_id) p USING (scan_id)"""


def nested(d):
    stored = d.stored()
    return reports.nest_results(stored, subpages.page_results(stored, d.resources))


def flattened(n):
    checks = F.transform(
        "checks",
        lambda c: F.concat(c["key"], F.lit("="), c["status"], F.lit(":"), c["points_earned"].cast("string")),
    )
    pages = F.transform(
        "subpages",
        lambda p: F.concat_ws(
            ">", p["page_type"], p["page_url"],
            F.array_join(F.transform(p["checks"], lambda c: F.concat(c["key"], F.lit("="), c["status"])), ","),
        ),
    )
    return n.select(
        "scan_id", "url", "score", "band",
        F.array_join(checks, "|").alias("checks"),
        F.array_join(F.transform("recommendations", lambda c: c["key"]), "|").alias("fixes"),
        F.coalesce(F.array_join(pages, "|"), F.lit("")).alias("subpages"),
    )


@query("nested_result", _NESTED)
def _(d):
    return flattened(nested(d))


@query("result_sink", _NESTED)
def _(d):
    """Results written as JSON lines to the shared folder and read back."""
    path = scratch_path(d.spark, "results")
    n = nested(d)
    sinks.write_results(n, path, "json")
    return flattened(d.spark.read.schema(n.schema).json(path))


@query("result_document", """
SELECT s.scan_id, s.score, (SELECT count(*) FROM results r WHERE r.scan_id = s.scan_id) AS n_checks,
  (SELECT count(*) FROM recs r WHERE r.scan_id = s.scan_id) AS n_fixes,
  (SELECT count(DISTINCT page_type) FROM subs r WHERE r.scan_id = s.scan_id) AS n_subpages FROM scores s""")
def _(d):
    docs = reports.as_document(nested(d))
    doc = F.try_parse_json("document")
    sized = "array<variant>"
    return docs.select(
        "scan_id",
        F.try_variant_get(doc, "$.score", "int").alias("score"),
        F.size(F.try_variant_get(doc, "$.checks", sized)).cast("bigint").alias("n_checks"),
        F.size(F.try_variant_get(doc, "$.recommendations", sized)).cast("bigint").alias("n_fixes"),
        F.size(F.map_keys(F.try_variant_get(doc, "$.subpages", "map<string,variant>"))).cast("bigint").alias("n_subpages"),
    )


# --- comparisons ----------------------------------------------------------------------------


def compared(d):
    scored = materialize(scoring.with_score(d.audited), "scored")
    errors = materialize(d.errors, "errors")
    return compare.compare(fx.compare_requests(d.pages), scored, errors)


@query("compare_limit", "SELECT compare_id, ord, url FROM asked")
def _(d):
    return compare.compare_requests(fx.compare_requests(d.pages))


@query("order_restore", "SELECT compare_id, ord, url, scan_id, score, band, error FROM compared")
def _(d):
    return compared(d).select("compare_id", "ord", "url", "scan_id", "score", "band", "error")


@query("result_or_error", "SELECT scan_id, url, score, NULL AS error FROM scores UNION ALL SELECT scan_id, url, NULL, error FROM errors")
def _(d):
    return compare.result_or_error(scoring.scan_scores(d.audited), d.errors, ["score"])


@query("compare_lookup", f"""
SELECT r.scan_id, CAST(d.check_idx AS INTEGER) AS check_idx, d.key, coalesce({o.ICON} || ' ' || points_earned || '/' || s.points_max, '—') AS cell
FROM (SELECT i AS scan_id FROM pg) r CROSS JOIN dim d LEFT JOIN results s ON s.scan_id = r.scan_id AND s.key = d.key""")
def _(d):
    requested = d.pages.select(F.col("page_id").alias("scan_id"))
    return compare.compare_lookup(requested, d.results)


@query("compare_pivot", """
SELECT compare_id, CAST(check_idx AS INTEGER) AS check_idx, key, label, max(CASE WHEN ord = 0 THEN cell END) AS site_0,
  max(CASE WHEN ord = 1 THEN cell END) AS site_1, max(CASE WHEN ord = 2 THEN cell END) AS site_2
FROM (SELECT * FROM cells UNION ALL
      SELECT compare_id, ord, 12, 'total', 'Total Score', coalesce(score || '/100', '—') FROM compared)
GROUP BY ALL""")
def _(d):
    return compare.compare_matrix(compared(d))


@query("site_ranking", """
SELECT domain, scan_id, score, rank() OVER (PARTITION BY domain ORDER BY score DESC) AS rank
FROM (SELECT *, split_part(regexp_replace(url, 'https?://', ''), '/', 1) AS domain FROM scores)""")
def _(d):
    from crawlgauge.functions.urls import display_domain

    scored = scoring.scan_scores(d.audited).select(
        "scan_id", "score", display_domain(F.col("url")).alias("domain")
    )
    scored = materialize(scored, "domain-scores")
    return compare.rank_sites(scored, "domain").select("domain", "scan_id", "score", "rank")


@query("fleet_rollup", """
SELECT effort_level, key, CAST(count(*) AS BIGINT) AS n_results, CAST(count(*) FILTER (status = 'pass') AS BIGINT) AS n_pass,
  CAST(count(*) FILTER (status = 'warning') AS BIGINT) AS n_warning, CAST(count(*) FILTER (status = 'fail') AS BIGINT) AS n_fail,
  round(count(*) FILTER (status = 'pass') * 100 / count(*), 4) AS pct_pass,
  round(count(*) FILTER (status = 'warning') * 100 / count(*), 4) AS pct_warning,
  round(count(*) FILTER (status = 'fail') * 100 / count(*), 4) AS pct_fail,
  round(sum(points_earned) / count(*), 4) AS avg_points_earned
FROM results GROUP BY ROLLUP (effort_level, key)""")
def _(d):
    return compare.fleet_rollup(d.results)


# --- sub-pages ------------------------------------------------------------------------------


@query("detect_subpages", "SELECT scan_id, page_type, page_url, pos FROM links")
def detect(d):
    sites = audit.audit(d.resources, (), links=True)
    return subpages.subpage_links(sites).select("scan_id", "page_type", "page_url", "pos")


@query("first_match_link", "SELECT page_type, pos, count(*) AS n FROM links GROUP BY ALL")
def _(d):
    return detect(d).groupBy("page_type", "pos").agg(F.count("*").alias("n"))


@query("subpage_scan", "SELECT scan_id, path, CAST(coalesce(len_body, 0) AS INTEGER) AS text_len FROM facts WHERE path <> '/'")
def _(d):
    """All pages other than homepages that were served, whatever their path and whether linked or not."""
    served = d.resources.filter(
        ~F.col("path").isin(HOME_PATH, *TEXT_PATHS, *API_PATHS, *MCP_PATHS)
        & (F.col("status") == 200) & F.col("error").isNull()
    )
    pages = served.select("scan_id", "path", F.coalesce("body", F.lit("")).alias("html"))
    return page_facts(pages).select("scan_id", "path", F.col("text_len_body").alias("text_len"))


@query("subpage_resolve", "SELECT DISTINCT scan_id, page_type, page_url FROM subs")
def _(d):
    return d.subpages.select("scan_id", "page_type", "page_url").distinct()


@query("subpage_audit", "SELECT scan_id, url, pos, page_type, page_url, CAST(ord AS INTEGER) AS ord, key, status, reason, detail, action FROM subs")
def _(d):
    return d.subpages.select(
        "scan_id", "url", "pos", "page_type", "page_url", "ord", "key", "status", "reason", "detail", "action"
    )


@query("subpage_labels", "SELECT page_label, check_label, status, count(*) AS n FROM subs GROUP BY ALL")
def _(d):
    return d.subpages.groupBy("page_label", "check_label", "status").agg(F.count("*").alias("n"))


# --- reports --------------------------------------------------------------------------------

_LINE = "chr(10)"
_REPORT = f"""
SELECT s.scan_id, 'audit_' || replace(replace(replace(s.url, 'https://', ''), 'http://', ''), '/', '_') || '.txt' AS file_name,
  '# Audit of ' || s.url || {_LINE} || 'Score ' || score || ' of 100 (' || band || '), as of {AS_OF}' || {_LINE}
  || {_LINE} || '## Checks' || {_LINE} || c.txt
  || coalesce({_LINE} || {_LINE} || '## Fixes by gain' || {_LINE} || f.txt, '')
  || coalesce({_LINE} || {_LINE} || '## Further pages' || {_LINE} || p.txt, '') AS report
FROM scores s
JOIN (SELECT scan_id, string_agg('- ' || label || ': ' || status || ', ' || points_earned || ' of ' || points_max || ' points' || {_LINE}
    || '  ' || detail || CASE WHEN status <> 'pass' THEN {_LINE} || '  To do: ' || action ELSE '' END, {_LINE} ORDER BY check_idx) AS txt
  FROM results GROUP BY scan_id) c USING (scan_id)
LEFT JOIN (SELECT scan_id, string_agg(rank || '. ' || label || ' gains ' || points_lost || ' points; effort ' || effort_level || ', ' || effort_time
    || {_LINE} || '   ' || action, {_LINE} ORDER BY rank) AS txt FROM recs GROUP BY scan_id) f USING (scan_id)
LEFT JOIN (SELECT scan_id, string_agg('### ' || page_type || ': ' || page_url || {_LINE} || lines, {_LINE} ORDER BY pos) AS txt
  FROM (SELECT scan_id, pos, page_type, page_url, string_agg('- ' || key || ': ' || status || '; ' || detail, {_LINE} ORDER BY ord) AS lines
        FROM subs GROUP BY scan_id, pos, page_type, page_url) GROUP BY scan_id) p USING (scan_id)"""


@query("report_txt", _REPORT)
def report(d):
    return reports.report_text(nested(d), AS_OF).select("scan_id", "file_name", "report")


@query("report_sink", _REPORT)
def _(d):
    """Reports written to the shared folder and read back."""
    path = scratch_path(d.spark, "reports")
    sinks.write_reports(reports.report_text(nested(d), AS_OF), path)
    return d.spark.read.parquet(path)


_TYPO = "'–—‘’“”…' || chr(322)"


@query("latin1_clean", f"""
SELECT scan_id, regexp_replace(replace(translate(txt, '–—‘’“”', '--''''""'), '…', '...'), '[^\\x00-\\xFF]', '?', 'g') AS cleaned
FROM (SELECT scan_id, text_body || {_TYPO} AS txt FROM rawf)""")
def _(d):
    raw = fx.spread(d.pages, "page_id").withColumnRenamed("page_id", "scan_id")
    text = F.concat("text_body_joined", F.lit("–—‘’“”…ł"))
    return page_facts(raw).select("scan_id", latin1_clean(text).alias("cleaned"))
