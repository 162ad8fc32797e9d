"""Queries over URLs, HTML signals and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlgauge.functions import html as H
from crawlgauge.functions import jsonld, robots, textrules, urls
from crawlgauge.functions.outcomes import (
    API_PATHS, KEY_PATHS, MCP_PATHS, js_rendering, llms_txt, named_hits,
)
from crawlgauge.operators import audit, scoring
from crawlgauge.operators.compare import dim_join
from crawlgauge.operators.links import keyword_hit, resolve_links
from crawlgauge.operators.signals import page_facts
from crawlgauge.registry import BUILTIN, EXCEPTION, Check, Reason, check_dim, register_check
from crawlgauge.sources.tables import fetch_frontier
from verification import fixtures as fx
from verification import oracle as o
from verification.base import query


def fetched(d):
    """Homepages whose fetch gave no error."""
    answered = d.of_path("/").filter("error IS NULL")
    return answered.select("scan_id", F.col("site_url").alias("url"), F.col("body").alias("html"))


def joined(col):
    return F.array_join(col, "|")


# --- sources --------------------------------------------------------------------------------


@query("page_scan", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_chars FROM pages")
def _(d):
    return d.pages.select("page_id", "url", F.char_length("html").alias("html_chars"))


@query("resource_scan", """
SELECT scan_id, path, CAST(status AS INTEGER) AS status, final_url, error, CAST(length(body) AS INTEGER) AS body_chars,
  CASE WHEN error IS NULL THEN array_to_string(list_filter([
    'Access-Control-Allow-Origin=' || acao, 'Content-Type=' || ctype, 'ETag=' || etag, 'Etag=' || etag_odd,
    'Last-Modified=' || lm], lambda x: x IS NOT NULL), '|') END AS headers,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(scan_id AS INTEGER)) + to_seconds(idx), '%Y-%m-%d %H:%M:%S') AS fetched_at
FROM res""")
def _(d):
    entries = F.array_sort(F.map_entries("headers"))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.resources.select(
        "scan_id", "path", "status", "final_url", "error",
        F.char_length("body").alias("body_chars"),
        joined(shown).alias("headers"),
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
    )


@query("fetch_frontier", f"""
SELECT scan_id, CAST(path_idx AS INTEGER) AS path_idx, path,
  CASE WHEN path = '/' THEN site ELSE lower(regexp_extract(site, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', 1)) || '://'
    || regexp_extract(site, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1) || path END AS url,
  CAST(timeout_s AS INTEGER) AS timeout_s
FROM (SELECT i AS scan_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE 'https://' || url END AS site FROM pg)
CROSS JOIN ({o.values([(n, p, t) for n, (p, t) in enumerate(o.TIMEOUTS.items())], 'path_idx, path, timeout_s', 't')}) t""")
def _(d):
    return fetch_frontier(d.pages.select(F.col("page_id").alias("scan_id"), "url"))


@query("registry_scan", """
SELECT CAST(d.check_idx AS INTEGER) AS check_idx, d.key, d.label, CAST(d.points_max AS INTEGER) AS points_max,
  d.effort_level, d.effort_time, count(r.scan_id) AS n_results
FROM dim d LEFT JOIN results r ON r.key = d.key GROUP BY ALL""")
def _(d):
    used = d.results.groupBy("key").agg(F.count("*").alias("n_results"))
    dim = check_dim(d.spark)
    return dim.join(used, "key", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


# --- URLs -----------------------------------------------------------------------------------

_TYPED = """(SELECT i AS scan_id, CASE i % 6 WHEN 1 THEN bare WHEN 2 THEN 'HTTP://' || bare
  WHEN 3 THEN 'https://user:pw@' || replace(bare, '/', ':8443/') WHEN 4 THEN url || '?next=/auth/x'
  WHEN 5 THEN 'http://login.' || bare ELSE url END AS typed
  FROM (SELECT i, url, regexp_replace(url, '^https?://', '') AS bare FROM pg))"""
_NORM = f"""(SELECT *, CASE WHEN typed LIKE 'http://%' OR typed LIKE 'https://%' THEN typed ELSE 'https://' || typed END AS url
  FROM {_TYPED})"""
_NETLOC = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)"


def typed(d):
    return fx.raw_urls(d.pages).withColumnRenamed("url", "typed")


def normalized(d):
    return typed(d).withColumn("url", urls.normalize_url(F.col("typed")))


@query("url_normalize", f"SELECT scan_id, typed, url FROM {_NORM}")
def _(d):
    return normalized(d)


@query("base_url", f"""
SELECT scan_id, url, lower(split_part(url, '://', 1)) || '://' || {_NETLOC.format('url')} AS base FROM {_NORM}""")
def _(d):
    return normalized(d).select("scan_id", "url", urls.base_url(F.col("url")).alias("base"))


@query("url_join", "SELECT scan_id, pos, href, abs_url FROM site_links")
def _(d):
    base = urls.base_url(F.col("url"))
    a = links(d).select("scan_id", "base", F.inline("anchors"))
    usable = (F.col("href") != "") & ~F.col("href").rlike("^(#|mailto:|tel:|javascript:)")
    return a.filter(usable).select(
        "scan_id", "pos", "href", urls.url_join(F.col("base"), F.col("href")).alias("abs_url")
    )


@query("url_netloc_equal", "SELECT scan_id, pos, abs_url, same_site FROM site_links")
def _(d):
    a = links(d).select("scan_id", "base", F.inline("anchors"))
    usable = (F.col("href") != "") & ~F.col("href").rlike("^(#|mailto:|tel:|javascript:)")
    out = a.filter(usable).select(
        "scan_id", "base", "pos", urls.url_join(F.col("base"), F.col("href")).alias("abs_url")
    )
    return out.select(
        "scan_id", "pos", "abs_url", urls.same_site(F.col("abs_url"), F.col("base")).alias("same_site")
    )


@query("display_domain", f"SELECT scan_id, split_part(regexp_replace(url, 'https?://', ''), '/', 1) AS domain FROM {_NORM}")
def _(d):
    return normalized(d).select("scan_id", urls.display_domain(F.col("url")).alias("domain"))


@query("report_file_name", f"""
SELECT scan_id, 'audit_' || replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_') || '.txt' AS file_name FROM {_NORM}""")
def _(d):
    return normalized(d).select("scan_id", urls.report_file_name(F.col("url"), "txt").alias("file_name"))


@query("status_tag", "SELECT scan_id, key, CASE status WHEN 'pass' THEN 'PASS' WHEN 'warning' THEN 'WARN' ELSE 'FAIL' END AS tag FROM results")
def _(d):
    return d.results.select("scan_id", "key", scoring.status_tag(F.col("status")).alias("tag"))


@query("status_icon", f"SELECT scan_id, key, {o.ICON} || ' ' || points_earned || '/' || points_max AS cell FROM results")
def _(d):
    cell = F.concat(
        scoring.status_icon(F.col("status")), F.lit(" "), F.col("points_earned").cast("string"),
        F.lit("/"), F.col("points_max").cast("string"),
    )
    return d.results.select("scan_id", "key", cell.alias("cell"))


@query("login_url_flag", f"SELECT scan_id, url, regexp_matches(lower(url), '{o.LOGIN_RE}') AS is_login FROM {_NORM}")
def _(d):
    return normalized(d).select("scan_id", "url", urls.login_url(F.col("url")).alias("is_login"))


# --- HTML signals ---------------------------------------------------------------------------


@query("page_text_signals", """
SELECT r.scan_id, text_body AS text_body_joined, CAST(len_body AS INTEGER) AS text_len, CAST(n_scripts AS INTEGER) AS script_count,
  CASE WHEN reason = 'ssr' THEN 'pass' WHEN reason = 'spa_thin' THEN 'warning' ELSE 'fail' END AS status,
  CAST(CASE WHEN reason = 'ssr' THEN 15 WHEN reason = 'spa_thin' THEN 7 ELSE 0 END AS INTEGER) AS points
FROM (SELECT *, CASE WHEN len_body < 200 AND n_scripts > 0 THEN 'empty_csr'
  WHEN csr_root IS NOT NULL AND len_body < 600 THEN 'spa_thin' ELSE 'ssr' END AS reason FROM rawf) r""")
def page_text_signals(d):
    """Raw pages to the rendering check: text, scripts, status and points."""
    raw = fx.spread(d.pages, "page_id").withColumnRenamed("page_id", "scan_id")
    judged = page_facts(raw).select(
        "scan_id", "text_body_joined", F.col("text_len_body").alias("text_len"), "script_count",
        js_rendering()["reason"].alias("reason"),
    )
    status = F.when(F.col("reason") == "ssr", "pass").when(F.col("reason") == "spa_thin", "warning").otherwise("fail")
    out = judged.withColumn("status", status)
    return out.withColumn("points", scoring.points_of(F.col("status"), F.lit(15))).drop("reason")


@query("sig_scripts", "SELECT scan_id, CAST(n_scripts AS INTEGER) AS script_count FROM richf")
def _(d):
    return d.facts.select("scan_id", "script_count")


@query("sig_script_srcs", "SELECT scan_id, array_to_string(srcs, '|') AS srcs FROM richf")
def _(d):
    return d.facts.select("scan_id", joined("script_srcs").alias("srcs"))


@query("sig_ld_json", "SELECT scan_id, array_to_string(ld, '|') AS ld_json FROM richf")
def _(d):
    return d.facts.select("scan_id", joined("ld_json").alias("ld_json"))


@query("sig_og_title", "SELECT scan_id, og AS has_og_title FROM richf")
def _(d):
    return d.facts.select("scan_id", "has_og_title")


@query("sig_text_joined_body", "SELECT scan_id, text_body AS text, CAST(len_body AS INTEGER) AS n FROM richf")
def _(d):
    return d.facts.select("scan_id", F.col("text_body_joined").alias("text"), F.col("text_len_body").alias("n"))


@query("sig_text_joined_all", "SELECT scan_id, text_all AS text, CAST(len_all AS INTEGER) AS n FROM richf")
def _(d):
    return d.facts.select("scan_id", F.col("text_all_joined").alias("text"), F.col("text_len_all").alias("n"))


@query("sig_text_concat_all", "SELECT scan_id, text_concat AS text FROM richf")
def _(d):
    return d.facts.select("scan_id", F.col("text_all_concat").alias("text"))


@query("sig_csr_root", "SELECT scan_id, csr_root FROM richf")
def _(d):
    return d.facts.select("scan_id", "csr_root")


@query("sig_itemprop_price", "SELECT scan_id, itemprop AS has_itemprop_price FROM richf")
def _(d):
    return d.facts.select("scan_id", "has_itemprop_price")


@query("sig_password", "SELECT scan_id, pw AS has_password FROM richf")
def _(d):
    return d.facts.select("scan_id", "has_password")


@query("sig_anchors", """
SELECT scan_id, pos, text, href FROM anchor_rows WHERE scan_id IN (SELECT scan_id FROM res WHERE path = '/' AND error IS NULL)""")
def _(d):
    return H.with_signals(fetched(d)).select("scan_id", F.inline("anchors"))


@query("sig_html_lower", "SELECT scan_id, sha256(lower(html)) AS html_lower_sha FROM enriched_docs")
def _(d):
    return d.homes.select("scan_id", F.sha2(F.lower("html"), 256).alias("html_lower_sha"))


@query("sig_entity_decode", f"SELECT i AS page_id, sha256({o.decode('html')}) AS decoded_sha FROM pg")
def _(d):
    return d.pages.select("page_id", F.sha2(H.decode_entities(F.col("html")), 256).alias("decoded_sha"))


# --- the twelve checks ----------------------------------------------------------------------


def _check_query(key: str) -> None:
    sql = (
        "SELECT scan_id, status, reason, CAST(points_earned AS INTEGER) AS points_earned, detail, action "
        f"FROM results WHERE key = '{key}'"
    )
    slug = {
        "pricing_parsability": "check_pricing", "contact_parsability": "check_contact",
        "cookie_consent_wall": "check_cookie_consent", "mcp_discoverability": "check_mcp",
    }.get(key, f"check_{key}")

    @query(slug, sql)
    def _(d):
        return d.results_of(key).select(
            "scan_id", "status", "reason", "points_earned", "detail", "action"
        )


for _c in BUILTIN:
    _check_query(_c.key)


@query("check_exception", """
SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'check_exception' WHEN scan_id % 3 = 1 THEN 'check_exception' ELSE 'high_value' END AS reason,
  CASE WHEN scan_id % 3 = 2 THEN 'pass' ELSE 'warning' END AS status,
  CAST(CASE WHEN scan_id % 3 = 2 THEN 20 ELSE 10 END AS INTEGER) AS points_earned
FROM ok_home WHERE scan_id IN (SELECT scan_id FROM facts WHERE path = '/' AND len(types) = 0 AND len(ld) = 0)""")
def _(d):
    """Types that are not names: an object gives up, a number only where nothing else decides."""
    block = (
        F.when(F.col("scan_id") % 3 == 0, F.lit('{"@type":{"a":1}}'))
        .when(F.col("scan_id") % 3 == 1, F.lit('{"@type":7}'))
        .otherwise(F.lit('{"@type":["Product",7]}'))
    )
    script = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script><footer>"))
    plain = (F.col("path") == "/") & ~F.col("body").contains("application/ld+json")
    body = F.when(plain, F.replace("body", F.lit("<footer>"), script)).otherwise(F.col("body"))
    touched = d.resources.withColumn("body", body)
    only = tuple(c for c in BUILTIN if c.key == "structured_data")
    results = audit.check_results(audit.audit(touched, only))
    mine = results.filter(F.col("reason").isin(EXCEPTION, "high_value"))
    untouched = d.resources.filter(plain & F.col("error").isNull()).select("scan_id")
    return mine.join(untouched, "scan_id", "left_semi").select("scan_id", "reason", "status", "points_earned")


# --- extractors -----------------------------------------------------------------------------


def robots_files(d):
    ok = (F.col("path") == "/robots.txt") & F.col("error").isNull() & (F.col("status") == 200)
    return d.resources.filter(ok).select("scan_id", "body")


@query("robots_blocked_agents", """
SELECT r.scan_id, coalesce(blocked, '') AS blocked FROM res r LEFT JOIN robots_blocked USING (scan_id)
WHERE path = '/robots.txt' AND error IS NULL AND status = 200""")
def _(d):
    blocked = F.array_join(robots.robots_blocked(F.col("body")), ", ")
    return robots_files(d).select("scan_id", blocked.alias("blocked"))


@query("bot_access_matrix", """
SELECT r.scan_id, bot, EXISTS (SELECT 1 FROM robots_hits h WHERE h.scan_id = r.scan_id AND h.bot = b.bot) AS blocked,
  EXISTS (SELECT 1 FROM robots_hits h WHERE h.scan_id = r.scan_id AND h.bot = '*') AS all_blocked
FROM res r CROSS JOIN bots b WHERE path = '/robots.txt' AND error IS NULL AND status = 200""")
def _(d):
    names = robots.robots_blocked(F.col("body"))
    rows = robots_files(d).select("scan_id", names.alias("names"))
    bots = F.explode(F.array(*[F.lit(b) for b in robots.AI_BOTS]))
    grid = rows.select("scan_id", "names", bots.alias("bot"))
    return grid.select(
        "scan_id", "bot", F.array_contains("names", F.col("bot")).alias("blocked"),
        F.array_contains("names", robots.ALL_AGENTS).alias("all_blocked"),
    )


@query("agent_carry_forward", "SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY pos) - 1 AS INTEGER) AS pos, val AS value, agent FROM robots_carry")
def _(d):
    """The window form: the last named agent holds for the lines after it."""
    lines = robots_files(d).select("scan_id", F.posexplode(robots.directives(F.col("body"))))
    flat = lines.select("scan_id", "pos", "col.*")
    w = W.partitionBy("scan_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    agent = F.last(F.when(F.col("is_agent"), F.col("value")), ignorenulls=True).over(w)
    return flat.select("scan_id", "pos", "value", agent.alias("agent"))


@query("distinct_blocked", "SELECT bot, count(DISTINCT scan_id) AS n_sites FROM robots_hits GROUP BY bot")
def _(d):
    names = F.explode(robots.robots_blocked(F.col("body")))
    # Names are distinct within a file and a scan has one file, so counting rows counts sites.
    return robots_files(d).select(names.alias("bot")).groupBy("bot").agg(F.count("*").alias("n_sites"))


@query("jsonld_types", "SELECT scan_id, array_to_string(types, '|') AS types FROM richf")
def _(d):
    return d.facts.select("scan_id", joined(jsonld.jsonld_types(F.col("ld_items"))).alias("types"))


@query("jsonld_type_grade", f"""
SELECT CASE WHEN list_contains({o._HIGH}, t) THEN 'high_value' WHEN list_contains({o._GEN}, t) THEN 'generic' ELSE 'other' END AS grade,
  t AS type, count(*) AS n FROM (SELECT unnest(types) AS t FROM richf) GROUP BY ALL""")
def _(d):
    types = d.facts.select(F.explode(jsonld.jsonld_types(F.col("ld_items"))).alias("type"))
    counted = types.groupBy("type").agg(F.count("*").alias("n"))
    return counted.select(jsonld.type_grade(F.col("type")).alias("grade"), "type", "n")


@query("price_mentions", "SELECT scan_id, array_to_string(prices, '|') AS prices, CAST(len(prices) AS INTEGER) AS n FROM richf")
def _(d):
    return d.facts.select(
        "scan_id", joined(textrules.price_mentions(F.col("text_all_concat"))).alias("prices"), F.col("n_prices").alias("n")
    )


@query("email_mentions", "SELECT scan_id, array_to_string(emails, '|') AS emails, CAST(len(emails) AS INTEGER) AS n FROM richf")
def _(d):
    return d.facts.select(
        "scan_id", joined(textrules.email_mentions(F.col("text_all_concat"))).alias("emails"), F.col("n_emails").alias("n")
    )


@query("phone_mentions", "SELECT scan_id, array_to_string(phones, '|') AS phones, CAST(len(phones) AS INTEGER) AS n FROM richf")
def _(d):
    return d.facts.select(
        "scan_id", joined(textrules.phone_mentions(F.col("text_all_concat"))).alias("phones"), F.col("n_phones").alias("n")
    )


@query("sitemap_url_count", "SELECT scan_id, CAST(len(regexp_extract_all(body, '<url>')) AS INTEGER) AS n_urls FROM res WHERE path = '/sitemap.xml' AND status = 200")
def _(d):
    ok = d.of_path("/sitemap.xml").filter(F.col("status") == 200)
    return ok.select("scan_id", textrules.sitemap_url_count(F.col("body")).alias("n_urls"))


@query("llms_structure", """
SELECT scan_id, array_to_string(found, '|') AS found, CAST(len(found) AS INTEGER) AS n_found,
  array_to_string(list_filter(['title', 'summary', 'links'], lambda e: NOT list_contains(found, e)), '|') AS missing
FROM llms WHERE status = 200""")
def _(d):
    ok = d.of_path("/llms.txt").filter(F.col("status") == 200)
    found = ok.select("scan_id", textrules.llms_structure(F.col("body")).alias("f"))
    return found.select(
        "scan_id", joined("f").alias("found"), F.size("f").alias("n_found"),
        joined(textrules.llms_missing(F.col("f"))).alias("missing"),
    )


@query("missing_elements", """
SELECT unnest(list_filter(['title', 'summary', 'links'], lambda e: NOT list_contains(found, e))) AS element, count(*) AS n_sites
FROM llms WHERE status = 200 GROUP BY 1""")
def _(d):
    ok = d.of_path("/llms.txt").filter(F.col("status") == 200)
    missing = textrules.llms_missing(textrules.llms_structure(F.col("body")))
    return ok.select(F.explode(missing).alias("element")).groupBy("element").agg(F.count("*").alias("n_sites"))


@query("cmp_providers", "SELECT scan_id, array_to_string(providers, '|') AS providers FROM richf")
def _(d):
    return d.facts.select("scan_id", joined("providers").alias("providers"))


@query("cmp_union", f"""
SELECT DISTINCT scan_id, unnest(providers) AS provider FROM richf""")
def _(d):
    """Providers by both detection methods, united within the row and exploded once: pages are parsed once."""
    none = F.array().cast("array<string>")
    by_script = textrules.cmp_providers(F.col("script_srcs"), none)
    by_element = textrules.cmp_providers(none, F.col("consent_elements"))
    return d.facts.select("scan_id", F.explode(F.array_union(by_script, by_element)).alias("provider"))


# --- probes ---------------------------------------------------------------------------------


def _hits_sql(paths, found: str, cors: bool) -> str:
    extra = ", coalesce(cors, false) AS cors" if cors else ""
    return (
        f"SELECT r.scan_id, coalesce(found, '') AS found{extra} FROM (SELECT DISTINCT scan_id FROM res "
        f"WHERE path IN {o.in_list(o.PROBE_PATHS)}) r LEFT JOIN {found} USING (scan_id)"
    )


def probes(d):
    merged = audit.probe_rows(d.resources).groupBy("scan_id").agg(*audit.probe_aggs())
    return merged.select("scan_id", *audit._probe_arrays())


@query("api_endpoints", _hits_sql(API_PATHS, "api_found", True))
def _(d):
    found = F.array_join(named_hits(F.col("api"), API_PATHS), ", ")
    return probes(d).select("scan_id", found.alias("found"), F.exists("api", lambda c: c >= 2).alias("cors"))


@query("gated_paths", _hits_sql(KEY_PATHS, "gated_found", False))
def _(d):
    return probes(d).select("scan_id", F.array_join(named_hits(F.col("gated"), KEY_PATHS), ", ").alias("found"))


@query("mcp_manifests", _hits_sql(MCP_PATHS, "mcp_found", False))
def _(d):
    return probes(d).select("scan_id", F.array_join(named_hits(F.col("mcp"), MCP_PATHS), ", ").alias("found"))


# --- links ----------------------------------------------------------------------------------


def links(d):
    """Fetched homepages with anchors and site root."""
    return H.with_signals(fetched(d)).select("scan_id", "anchors", urls.base_url(F.col("url")).alias("base"))


@query("same_site_links", "SELECT scan_id, pos, abs_url FROM site_links WHERE same_site")
def _(d):
    kept = links(d).select("scan_id", F.inline(resolve_links(F.col("anchors"), F.col("base"))))
    return kept.select("scan_id", "pos", "abs_url")


@query("keyword_match", "SELECT scan_id, pos, pricing, contact, docs_hit AS docs FROM keyword_rows")
def _(d):
    kept = links(d).select("scan_id", F.inline(resolve_links(F.col("anchors"), F.col("base"))))
    hit = {t: keyword_hit(F.col("text"), F.lower("abs_url"), t).alias(t) for t in ("pricing", "contact", "docs")}
    return kept.select("scan_id", "pos", *hit.values())


# --- registry -------------------------------------------------------------------------------


@query("result_enrich", """
SELECT scan_id, CAST(check_idx AS INTEGER) AS check_idx, key, label, status, CAST(points_max AS INTEGER) AS points_max, effort_level, effort_time FROM results""")
def _(d):
    bare = d.results.select("scan_id", "key", "status")
    return dim_join(bare)


@query("register_check", """
SELECT s.scan_id, CAST(CASE WHEN len_all >= 1000 THEN 12 ELSE 0 END AS INTEGER) AS extra_points,
  CAST(max_points + 12 AS INTEGER) AS max_points,
  CAST(round_even((raw_points + CASE WHEN len_all >= 1000 THEN 12 ELSE 0 END) * 100.0 / (max_points + 12), 0) AS INTEGER) AS score
FROM scores s JOIN facts f ON f.scan_id = s.scan_id AND f.path = '/'""")
def _(d):
    """A thirteenth check added by a user of the library."""
    long_enough = Check(
        "long_text", "Long Text", 12, "Easy", "1 day", "home",
        {"long": Reason("pass", "{0} characters."), "short": Reason("fail", "{0} characters.", "Write more.")},
        lambda: F.struct(
            F.when(F.col("text_len_all") >= 1000, "long").otherwise("short").alias("reason"),
            F.array(F.col("text_len_all").cast("string")).alias("args"),
        ),
    )
    checks = register_check(BUILTIN, long_enough)
    scored = scoring.with_score(audit.audit(d.resources, checks))
    added = F.try_element_at("checks", F.lit(-1))["points_earned"]
    return scored.select("scan_id", added.alias("extra_points"), "max_points", "score")
