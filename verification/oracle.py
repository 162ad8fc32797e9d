"""The same derivations and audit rules in DuckDB SQL, as a library of named CTEs.

Written apart from the Spark code: it shares only the fixture texts and the
registry's words and points.
"""

from __future__ import annotations

import re

from crawlgauge.functions import jsonld, robots, textrules
from crawlgauge.functions.html import CONSENT_ELEMENT_IDS, CSR_ROOT_IDS
from crawlgauge.functions.outcomes import API_PATHS, KEY_PATHS, MCP_PATHS
from crawlgauge.operators.links import SUBPAGE_KEYWORDS
from crawlgauge.operators.subpages import CHECK_LABELS, PAGE_LABELS, SUBPAGE_CHECKS
from crawlgauge.registry import BUILTIN
from crawlgauge.sources.tables import PROBE_PATHS, TEXT_PATHS, TIMEOUTS
from verification import fixtures as fx


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def case(i: str, modulus: int, texts: dict[int, str], default: str) -> str:
    whens = " ".join(f"WHEN {v} THEN {lit(t)}" for v, t in texts.items())
    return f"CASE ({i}) % {modulus} {whens} ELSE {default} END"


def page_html(html: str, i: str) -> str:
    snippets = " || ".join(case(i, m, texts, "''") for m, texts in fx.SNIPPETS)
    return f"replace({case(i, 6, fx.BASE_PAGES, html)}, '<footer>', {snippets} || '<footer>')"


def values(rows: list[tuple], columns: str, name: str) -> str:
    def cell(v) -> str:
        return str(v) if isinstance(v, int) else lit(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) {name}({columns})"


def probe_pos(paths: list[str]) -> str:
    return f"(list_position({str_list(paths)}, path) - 1)"


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
TAG = "[^>]*"
_OPAQUE = (
    r"(?is)<!--.*?(?:-->|\z)|<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)"
)
_NOT_TEXT = r"(?is)</?[a-z][^>]*>|<[!?/][^>]*>"


def decode(expr: str) -> str:
    for name, char in [("nbsp", "\xa0"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·")]:
        expr = f"replace({expr}, '&{name};', {lit(char)})"
    return f"replace({expr}, '&amp;', '&')"


def attr(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, '(?i)\\s{name}=\"([^\"]*)\"', 1)"


def joined(runs: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform({runs}, lambda r: trim(r, {WS})), lambda r: r <> ''), ' ')"
    )


SITEMAP_CASE = (
    "CASE CASE WHEN i % 5 = 0 THEN 10 * (i % 4) ELSE i % 5 END "
    + " ".join(f"WHEN {k} THEN {lit(t)}" for k, t in fx.SITEMAP.items())
    + " ELSE NULL END"
)

_SUB = (
    "((i % 10 = 0 AND path IN ('/pricing', '/contact-us', '/docs')) "
    "OR (i % 10 = 1 AND path IN ('/docs/pricing', '/x')))"
)
_PATHS = [(p, n) for p, n in fx.PATH_IDX.items()]

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(final: str) -> str:
    """``final`` preceded by the CTEs it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [f"{n} AS ({b})" for n, b in CTES.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


cte("pg", "SELECT page_id AS i, url, html, "
    r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) AS base FROM pages")

cte("res_home", f"""
SELECT i, url, base, '/' AS path, 0 AS idx,
  CASE WHEN i % 25 = 24 THEN 503 ELSE 200 END AS status,
  CASE WHEN i % 8 = 2 THEN base || '/login' ELSE url END AS final_url,
  {page_html('html', 'i')} AS body,
  CASE WHEN i % 25 = 23 THEN 'dns' END AS error,
  CASE WHEN i % 4 IN (0, 1) THEN {lit(fx.LAST_MODIFIED)} END AS lm,
  CASE WHEN i % 4 IN (0, 2) THEN {lit(fx.ETAG)} END AS etag,
  CASE WHEN i % 12 = 3 THEN {lit(fx.ETAG)} END AS etag_odd,
  CAST(NULL AS VARCHAR) AS acao, CAST(NULL AS VARCHAR) AS ctype
FROM pg""")

cte("res_known", f"""
SELECT i, url, base, path, idx,
  CASE WHEN path = '/robots.txt' THEN CASE WHEN i % 7 = 0 THEN 404 ELSE 200 END
       WHEN path = '/llms.txt' THEN CASE WHEN i % 8 = 0 THEN 404 ELSE 200 END
       WHEN path = '/sitemap.xml' THEN CASE WHEN i % 5 = 2 THEN 404 ELSE 200 END
       WHEN path IN {in_list(API_PATHS)} THEN CASE WHEN (i + 2 * {probe_pos(API_PATHS)}) % 13 = 0 THEN 200 ELSE 404 END
       WHEN path IN {in_list(MCP_PATHS)} THEN CASE WHEN (i + {probe_pos(MCP_PATHS)}) % 6 = 0 THEN 200 ELSE 404 END
       WHEN path = '/pricing' AND i % 8 = 3 THEN 403
       WHEN path IN ('/pricing', '/docs') THEN 200 ELSE 404 END AS status,
  base || CASE WHEN path = '/docs' AND i % 8 = 4 THEN '/auth/start' ELSE path END AS final_url,
  CASE path WHEN '/robots.txt' THEN {case('i', 7, fx.ROBOTS, 'NULL')}
            WHEN '/llms.txt' THEN {case('i', 8, fx.LLMS, 'NULL')}
            WHEN '/sitemap.xml' THEN {SITEMAP_CASE} END AS body,
  CASE WHEN (path = '/robots.txt' AND i % 7 = 5) OR (path = '/llms.txt' AND i % 8 = 6)
         OR (path = '/sitemap.xml' AND i % 5 = 3) THEN 'timeout' END AS error,
  CAST(NULL AS VARCHAR) AS lm, CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS VARCHAR) AS etag_odd,
  CASE WHEN path IN {in_list(API_PATHS)} AND i % 2 = 0 THEN '*' END AS acao,
  CASE WHEN path IN {in_list(MCP_PATHS)} THEN
       CASE WHEN i % 4 = 1 THEN 'text/html' ELSE 'application/json' END END AS ctype
FROM pg, ({values(_PATHS, 'path, idx', 't')}) paths
WHERE path IN {in_list(TEXT_PATHS + PROBE_PATHS)} AND NOT {_SUB}""")

cte("res_sub", f"""
SELECT i, url, base, path, idx,
  CASE WHEN i % 20 = 10 AND path = '/contact-us' THEN 404 ELSE 200 END AS status,
  base || CASE WHEN path = '/docs' AND i % 8 = 4 THEN '/auth/start' ELSE path END AS final_url,
  {page_html('html', 'i + 1')} AS body, CAST(NULL AS VARCHAR) AS error,
  CAST(NULL AS VARCHAR) AS lm, CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS VARCHAR) AS etag_odd,
  CAST(NULL AS VARCHAR) AS acao, CAST(NULL AS VARCHAR) AS ctype
FROM pg, ({values(_PATHS, 'path, idx', 't')}) paths WHERE {_SUB}""")

cte("res", """
SELECT i AS scan_id, url, base, path, idx, error,
  CASE WHEN error IS NULL THEN status END AS status,
  CASE WHEN error IS NULL THEN final_url END AS final_url,
  CASE WHEN error IS NULL THEN body END AS body,
  CASE WHEN error IS NULL THEN lm END AS lm, CASE WHEN error IS NULL THEN etag END AS etag,
  CASE WHEN error IS NULL THEN etag_odd END AS etag_odd,
  CASE WHEN error IS NULL THEN acao END AS acao, CASE WHEN error IS NULL THEN ctype END AS ctype
FROM (SELECT * FROM res_home UNION ALL SELECT * FROM res_known UNION ALL SELECT * FROM res_sub)""")

# --- pages to facts -------------------------------------------------------------------------

cte("docs", """
SELECT scan_id, url, base, path, status, final_url, lm, etag, body AS html FROM res
WHERE error IS NULL AND (path = '/' OR (status = 200 AND path IN ('/pricing', '/docs', '/contact-us', '/docs/pricing', '/x')))""")
cte("raw_docs", "SELECT i AS scan_id, url, base, '/' AS path, 200 AS status, url AS final_url, "
    "'' AS lm, '' AS etag, html FROM pg")
cte("enriched_docs", f"SELECT i AS scan_id, url, base, '/' AS path, 200 AS status, url AS final_url, "
    f"'' AS lm, '' AS etag, {page_html('html', 'i')} AS html FROM pg")


def facts_ctes(prefix: str, source: str) -> None:
    cte(f"{prefix}_markup", f"""
SELECT *, list_filter(regexp_extract_all(html, {lit(_OPAQUE)}), lambda b: regexp_matches(b, '(?i)^<script')) AS scripts,
  regexp_replace(html, {lit(_OPAQUE)}, chr(1), 'g') AS markup FROM {source}""")
    cte(f"{prefix}_cut", f"""
SELECT *, {decode(f"regexp_replace(regexp_replace(regexp_replace(markup, '(?i)<body[^>]*>', chr(2), 'g'), '(?i)</(?:body|html)>', chr(3), 'g'), {lit(_NOT_TEXT)}, chr(1), 'g')")} AS cut,
  list_transform(list_filter(scripts, lambda s: {attr('s', 'src')} <> ''), lambda s: lower({attr('s', 'src')})) AS srcs,
  list_transform(list_filter(scripts, lambda s: {attr('s', 'type')} = 'application/ld+json'),
    lambda s: regexp_extract(s, '(?is)^<script[^>]*>(.*?)</script>', 1)) AS ld,
  len(list_filter(regexp_extract_all(markup, '(?i)<meta[^>]*>'), lambda t: {attr('t', 'property')} = 'og:title')) > 0 AS og,
  len(list_filter(regexp_extract_all(markup, '(?i)<[a-z][^>]*>'), lambda t: {attr('t', 'itemprop')} = 'price')) > 0 AS itemprop,
  len(list_filter(regexp_extract_all(markup, '(?i)<input[^>]*>'), lambda t: {attr('t', 'type')} = 'password')) > 0 AS pw,
  list_filter(list_transform(regexp_extract_all(markup, '(?i)<div[^>]*>'), lambda t: {attr('t', 'id')}), lambda x: x <> '') AS div_ids,
  string_split_regex(markup, '(?i)<a\\s')[2:] AS a_parts
FROM {prefix}_markup""")
    cte(f"{prefix}_text", f"""
SELECT *, string_split_regex(cut, '[\\x01-\\x03]') AS runs,
  string_split_regex(CASE WHEN contains(cut, chr(2))
    THEN string_split(substr(cut, instr(cut, chr(2)) + 1), chr(3))[1] ELSE cut END, '[\\x01-\\x03]') AS body_runs
FROM {prefix}_cut""")
    cte(f"{prefix}_all", f"""
SELECT *, {joined('runs')} AS text_all, {joined('body_runs')} AS text_body,
  array_to_string(list_transform(runs, lambda r: CASE WHEN regexp_full_match(r, '[ \\t\\n\\r\\f\\v]+')
    THEN CASE WHEN contains(r, chr(10)) THEN chr(10) ELSE ' ' END ELSE r END), '') AS text_concat
FROM {prefix}_text""")
    cte(prefix, f"""
SELECT *, length(text_all) AS len_all, length(text_body) AS len_body, len(scripts) AS n_scripts,
  list_filter({str_list(CSR_ROOT_IDS)}, lambda r: list_contains(div_ids, r))[1] AS csr_root,
  regexp_extract_all(text_concat, '[$£€¥]\\s*[\\d,]+(?:\\.\\d{{2}})?') AS prices,
  list_filter(regexp_extract_all(text_concat, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}'),
    lambda e: NOT regexp_matches(e, '(?i)\\.(png|jpg|svg|gif|css|js)$')) AS emails,
  regexp_extract_all(text_concat, '(?:\\+\\d[\\d\\s\\-\\(\\)]{{8,14}}|\\(\\d{{3}}\\)\\s?\\d{{3}}[\\-\\s]\\d{{4}})') AS phones,
  list_sort(list_distinct(list_concat(
    list_transform(list_filter(list_transform(srcs, lambda s: list_filter({str_list(textrules.CONSENT_SCRIPTS)}, lambda c: contains(s, c))[1]),
      lambda x: x IS NOT NULL), lambda c: string_split(c, '.')[1]),
    list_transform(list_filter({str_list(CONSENT_ELEMENT_IDS)}, lambda e: contains(lower(html), e)), lambda e: string_split(e, '-')[1])))) AS providers,
  flatten(list_transform(flatten(list_transform(list_filter(list_filter(ld, lambda b: json_valid(b)), lambda b: json_type(b) = 'OBJECT'),
    lambda b: CASE WHEN json_type(b, '$."@graph"') IS NULL THEN [CAST(b AS JSON)]
      WHEN json_type(b, '$."@graph"') = 'ARRAY' THEN json_extract(b, '$."@graph"[*]') ELSE CAST([] AS JSON[]) END)),
    lambda n: CASE json_type(n, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(n, '$."@type"[*]')
      WHEN 'VARCHAR' THEN [json_extract_string(n, '$."@type"')] ELSE CAST([] AS VARCHAR[]) END)) AS types
FROM {prefix}_all""")


facts_ctes("facts", "docs")
facts_ctes("rawf", "raw_docs")
facts_ctes("richf", "enriched_docs")

_HIGH, _GEN = str_list(jsonld.HIGH_VALUE_TYPES), str_list(jsonld.GENERIC_TYPES)


def page_outcomes(source: str) -> str:
    """key, reason, a0..a2 of the four page checks as a UNION over ``source``."""
    high = f"list_filter(types, lambda t: list_contains({_HIGH}, t))"
    gen = f"list_filter(types, lambda t: list_contains({_GEN}, t))"
    no = "CAST(NULL AS VARCHAR)"
    return f"""
SELECT scan_id, path, 'structured_data' AS key,
  CASE WHEN len(types) = 0 THEN CASE WHEN og THEN 'og_only' ELSE 'none' END
       WHEN len({high}) > 0 THEN 'high_value' ELSE 'generic_only' END AS reason,
  CASE WHEN len({high}) > 0 THEN array_to_string({high}, ', ')
       WHEN len({gen}) > 0 THEN array_to_string({gen}, ', ') ELSE array_to_string(types, ', ') END AS a0,
  CASE WHEN len({gen}) > 0 THEN ' Naming types too: ' || array_to_string({gen}, ', ') || '.' ELSE '' END AS a1,
  CASE WHEN og THEN ' Open Graph tags too.' ELSE '' END AS a2 FROM {source}
UNION ALL
SELECT scan_id, path, 'js_rendering',
  CASE WHEN len_body < 200 AND n_scripts > 0 THEN 'empty_csr'
       WHEN csr_root IS NOT NULL AND len_body < 600 THEN 'spa_thin' ELSE 'ssr' END,
  CAST(len_body AS VARCHAR),
  CASE WHEN len_body < 200 AND n_scripts > 0 THEN CAST(n_scripts AS VARCHAR) ELSE csr_root END, {no} FROM {source}
UNION ALL
SELECT scan_id, path, 'pricing_parsability',
  CASE WHEN itemprop THEN 'markup' WHEN len(prices) > 0 THEN 'text_only' ELSE 'none' END,
  CAST(len(prices) AS VARCHAR), {no}, {no} FROM {source}
UNION ALL
SELECT scan_id, path, 'contact_parsability',
  CASE WHEN len(emails) + len(phones) > 0 THEN 'found' ELSE 'none' END,
  array_to_string(list_filter([CASE WHEN len(emails) > 0 THEN len(emails) || ' readable mail contacts' END,
    CASE WHEN len(phones) > 0 THEN len(phones) || ' readable phone contacts' END], lambda x: x IS NOT NULL), ', '), {no}, {no} FROM {source}"""


# --- robots, probes -------------------------------------------------------------------------

cte("robots_lines", r"""
SELECT scan_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
FROM (SELECT scan_id, string_split_regex(body, '\r\n|\n') AS lines FROM res
      WHERE path = '/robots.txt' AND error IS NULL AND status = 200)""")
cte("robots_dirs", r"""
SELECT scan_id, pos, lower(line) AS low, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS val FROM robots_lines
WHERE regexp_matches(line, '(?i)^\s*(user-agent|disallow):')""")
cte("robots_carry", """
SELECT *, last_value(CASE WHEN starts_with(low, 'user-agent:') THEN val END IGNORE NULLS)
  OVER (PARTITION BY scan_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM robots_dirs""")
cte("bots", values([(b,) for b in robots.AI_BOTS], "bot", "b"))
cte("robots_hits", """
SELECT DISTINCT scan_id, bot FROM (
  SELECT scan_id, bot FROM robots_carry JOIN bots ON lower(bot) = lower(agent)
    WHERE starts_with(low, 'disallow:') AND val IN ('/', '/*')
  UNION ALL SELECT scan_id, '*' FROM robots_carry
    WHERE starts_with(low, 'disallow:') AND val IN ('/', '/*') AND agent = '*')""")
cte("robots_blocked", """
SELECT scan_id, array_to_string(list_sort(list(bot)), ', ') AS blocked FROM robots_hits GROUP BY scan_id""")

LOGIN_RE = "login|signin|sign-in|/auth/|/sso|saml"


def hits(paths: list[str], cond: str) -> str:
    return (
        f"SELECT scan_id, array_to_string(list(path ORDER BY idx), ', ') AS found, bool_or(acao IS NOT NULL) AS cors "
        f"FROM res WHERE path IN {in_list(paths)} AND error IS NULL AND {cond} GROUP BY scan_id"
    )


cte("api_found", hits(API_PATHS, "status = 200"))
cte("mcp_found", hits(MCP_PATHS, "status = 200 AND contains(ctype, 'json')"))
cte("gated_found", hits(
    KEY_PATHS, f"(status IN (401, 403) OR regexp_matches(lower(final_url), '{LOGIN_RE}'))"))

# --- outcomes to results --------------------------------------------------------------------

cte("ok_home", "SELECT scan_id, url, base FROM res WHERE path = '/' AND error IS NULL AND status < 400")
cte("home_facts", "SELECT f.* FROM facts f JOIN ok_home o USING (scan_id) WHERE f.path = '/'")
cte("llms", r"""
SELECT scan_id, error, status, content,
  list_filter([CASE WHEN regexp_matches(content, '(?m)^# ') THEN 'title' END,
    CASE WHEN regexp_matches(content, '(?m)^> ') THEN 'summary' END,
    CASE WHEN regexp_matches(content, '\[.+?\]\(https?://') THEN 'links' END], lambda x: x IS NOT NULL) AS found
FROM (SELECT scan_id, error, status, trim(coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(13)) AS content
      FROM res WHERE path = '/llms.txt')""")
cte("page_out", f"SELECT * FROM ({page_outcomes('home_facts')})")
_NO = "CAST(NULL AS VARCHAR)"
cte("outcomes", f"""
SELECT scan_id, key, reason, a0, a1, a2 FROM page_out
UNION ALL
SELECT r.scan_id, 'ai_crawler_access', CASE WHEN r.error IS NOT NULL THEN 'unreachable' WHEN status <> 200 THEN 'no_file'
    WHEN blocked IS NOT NULL THEN 'blocked' ELSE 'open' END,
  coalesce(r.error, blocked, {lit(', '.join(robots.AI_BOTS))}), {_NO}, {_NO}
FROM res r LEFT JOIN robots_blocked USING (scan_id) WHERE r.path = '/robots.txt'
UNION ALL
SELECT scan_id, 'llms_txt', CASE WHEN error IS NOT NULL THEN 'unreachable' WHEN status <> 200 THEN 'missing'
    WHEN content = '' THEN 'empty' WHEN len(found) >= 2 THEN 'structured'
    WHEN length(content) > 80 THEN 'unstructured' ELSE 'sparse' END,
  coalesce(error, array_to_string(found, ', ')),
  array_to_string(list_filter(['title', 'summary', 'links'], lambda e: NOT list_contains(found, e)), '; '), {_NO} FROM llms
UNION ALL
SELECT scan_id, 'sitemap', CASE WHEN error IS NOT NULL THEN 'unreachable' WHEN status = 200 AND contains(body, '<url>') THEN 'ok'
    WHEN status = 200 THEN 'malformed' ELSE 'missing' END,
  coalesce(error, CAST(len(regexp_extract_all(body, '<url>')) AS VARCHAR)), {_NO}, {_NO} FROM res WHERE path = '/sitemap.xml'
UNION ALL
SELECT o.scan_id, 'api_discoverability', CASE WHEN cors THEN 'found_cors' WHEN found IS NOT NULL THEN 'found_no_cors' ELSE 'none' END,
  found, {_NO}, {_NO} FROM ok_home o LEFT JOIN api_found USING (scan_id)
UNION ALL
SELECT o.scan_id, 'mcp_discoverability', CASE WHEN found IS NOT NULL THEN 'found' ELSE 'none' END, found, {_NO}, {_NO}
FROM ok_home o LEFT JOIN mcp_found USING (scan_id)
UNION ALL
SELECT scan_id, 'cookie_consent_wall', CASE WHEN len(providers) > 0 THEN 'cmp' ELSE 'none' END,
  array_to_string(providers, ', '), {_NO}, {_NO} FROM home_facts
UNION ALL
SELECT scan_id, 'content_freshness', CASE WHEN lm IS NOT NULL AND etag IS NOT NULL THEN 'both' WHEN lm IS NOT NULL THEN 'lm_only'
    WHEN etag IS NOT NULL THEN 'etag_only' ELSE 'none' END, {_NO}, {_NO}, {_NO} FROM home_facts
UNION ALL
SELECT h.scan_id, 'auth_wall', CASE WHEN regexp_matches(lower(final_url), '{LOGIN_RE}') THEN 'redirected'
    WHEN pw AND len_all < 600 THEN 'gated_home' WHEN found IS NOT NULL THEN 'gated_sub'
    WHEN pw THEN 'login_form' ELSE 'open' END,
  CASE WHEN regexp_matches(lower(final_url), '{LOGIN_RE}') THEN final_url ELSE found END, {_NO}, {_NO}
FROM home_facts h LEFT JOIN gated_found USING (scan_id)""")

cte("dim", values(
    [(n, c.key, c.label, c.points_max, c.effort_level, c.effort_time) for n, c in enumerate(BUILTIN)],
    "check_idx, key, label, points_max, effort_level, effort_time", "d"))
cte("verdicts", values(
    [(c.key, n, r.status, r.detail, r.action) for c in BUILTIN for n, r in c.reasons.items()],
    "key, reason, status, detail, action", "v"))


def fill(template: str) -> str:
    for n in range(3):
        template = f"replace({template}, '{{{n}}}', coalesce(a{n}, ''))"
    return template


cte("results", f"""
SELECT scan_id, url, check_idx, key, label, status, reason,
  CASE status WHEN 'pass' THEN points_max WHEN 'warning' THEN points_max // 2 ELSE 0 END AS points_earned, points_max,
  points_max - CASE status WHEN 'pass' THEN points_max WHEN 'warning' THEN points_max // 2 ELSE 0 END AS points_lost,
  {fill('detail')} AS detail, {fill('action')} AS action, effort_level, effort_time
FROM outcomes JOIN ok_home USING (scan_id) JOIN dim USING (key) JOIN verdicts USING (key, reason)""")

BAND = ("CASE WHEN score >= 80 THEN 'Agent-Ready' WHEN score >= 60 THEN 'Above Average' "
        "WHEN score >= 40 THEN 'Average' WHEN score >= 20 THEN 'Below Average' ELSE 'Not Ready' END")
cte("scores", f"""
SELECT *, {BAND} AS band FROM (
  SELECT scan_id, url, CAST(sum(points_earned) AS INTEGER) AS raw_points, CAST(sum(points_max) AS INTEGER) AS max_points,
    CAST(round_even(sum(points_earned) * 100.0 / sum(points_max), 0) AS INTEGER) AS score,
    CAST(count(*) FILTER (status = 'pass') AS INTEGER) AS n_pass,
    CAST(count(*) FILTER (status = 'warning') AS INTEGER) AS n_warning,
    CAST(count(*) FILTER (status = 'fail') AS INTEGER) AS n_fail
  FROM results GROUP BY scan_id, url)""")
cte("errors", """
SELECT scan_id, url, coalesce(error, 'HTTP status ' || status) AS error FROM res
WHERE path = '/' AND (error IS NOT NULL OR status >= 400)""")
cte("recs", """
SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY points_lost DESC, check_idx) AS INTEGER) AS rank
FROM results WHERE status <> 'pass'""")

# --- links and sub-pages --------------------------------------------------------------------

cte("anchor_rows", f"""
SELECT scan_id, url, base, pos,
  lower(array_to_string(list_transform(string_split(regexp_replace({decode("regexp_extract(part, '(?is)^[^>]*>(.*?)</a>', 1)")}, '(?i)</?[a-z][^>]*>', chr(1), 'g'), chr(1)), lambda r: trim(r)), '')) AS text,
  trim({decode("regexp_extract(part, '(?i)^href=\"([^\"]*)\"', 1)")}) AS href
FROM (SELECT scan_id, url, base, unnest(a_parts) AS part, CAST(generate_subscripts(a_parts, 1) - 1 AS INTEGER) AS pos
      FROM facts WHERE path = '/')""")
cte("site_links", r"""
SELECT *, regexp_extract(abs_url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)
        = regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) AS same_site
FROM (SELECT *, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN base || href
        ELSE base || '/' || href END AS abs_url
      FROM anchor_rows WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)'))""")


def keyword(page_type: str) -> str:
    return "(" + " OR ".join(
        f"contains(text, {lit(w)}) OR contains(lower(abs_url), {lit(w)})" for w in SUBPAGE_KEYWORDS[page_type]
    ) + ")"


cte("keyword_rows", f"""
SELECT scan_id, url, base, pos, text, abs_url, {keyword('pricing')} AS pricing, {keyword('contact')} AS contact,
  {keyword('docs')} AS docs FROM site_links WHERE same_site""".replace("AS docs FROM", "AS docs_hit FROM"))
cte("pick_p", "SELECT scan_id, min(pos) AS pos FROM keyword_rows WHERE pricing GROUP BY scan_id")
cte("pick_c", """SELECT k.scan_id, min(k.pos) AS pos FROM keyword_rows k LEFT JOIN pick_p p USING (scan_id)
WHERE contact AND k.pos IS DISTINCT FROM p.pos GROUP BY k.scan_id""")
cte("pick_d", """SELECT k.scan_id, min(k.pos) AS pos FROM keyword_rows k LEFT JOIN pick_p p USING (scan_id)
LEFT JOIN pick_c c USING (scan_id)
WHERE docs_hit AND k.pos IS DISTINCT FROM p.pos AND k.pos IS DISTINCT FROM c.pos GROUP BY k.scan_id""")
cte("links", """
SELECT scan_id, url, pos, page_type, abs_url AS page_url,
  CASE WHEN substr(abs_url, length(base) + 1) = '' THEN '/' ELSE substr(abs_url, length(base) + 1) END AS path
FROM (SELECT scan_id, pos, 'pricing' AS page_type FROM pick_p UNION ALL SELECT scan_id, pos, 'contact' FROM pick_c
      UNION ALL SELECT scan_id, pos, 'docs' FROM pick_d)
JOIN keyword_rows USING (scan_id, pos) JOIN (SELECT scan_id FROM ok_home) USING (scan_id)""")
cte("sub_out", f"SELECT * FROM ({page_outcomes('facts')}) WHERE path <> '/'")
cte("sub_dim", values([(t, k, n) for t, ks in SUBPAGE_CHECKS.items() for n, k in enumerate(ks)],
                      "page_type, key, ord", "s"))
_PL = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in PAGE_LABELS.items())
_CL = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CHECK_LABELS.items())
cte("subs", f"""
SELECT l.scan_id, l.url, l.pos, l.page_type, CASE l.page_type {_PL} ELSE l.page_type END AS page_label, l.page_url, s.ord,
  s.key, CASE s.key {_CL} ELSE s.key END AS check_label, v.status, o.reason,
  {fill('v.detail')} AS detail, {fill('v.action')} AS action
FROM links l JOIN sub_dim s USING (page_type) JOIN sub_out o ON o.scan_id = l.scan_id AND o.path = l.path AND o.key = s.key
JOIN verdicts v ON v.key = o.key AND v.reason = o.reason""")

# --- comparisons ----------------------------------------------------------------------------

cte("requests", """
SELECT i // 4 AS compare_id, list(url ORDER BY i) AS urls FROM pg GROUP BY i // 4""")
cte("asked", """
SELECT compare_id, CAST(generate_subscripts(picked, 1) - 1 AS INTEGER) AS ord, unnest(picked) AS url
FROM (SELECT compare_id, (CASE WHEN compare_id % 5 = 0 THEN [urls[1], urls[1]] || urls[2:] ELSE urls END)[1:3] AS picked
      FROM requests)""")
cte("compared", """
SELECT a.compare_id, a.ord, a.url, coalesce(s.scan_id, e.scan_id) AS scan_id, s.score, s.band,
  coalesce(e.error, CASE WHEN s.scan_id IS NULL THEN 'not scanned' END) AS error
FROM asked a LEFT JOIN scores s USING (url) LEFT JOIN errors e USING (url)""")
ICON = "CASE status WHEN 'pass' THEN '✓' WHEN 'warning' THEN '⚠' WHEN 'fail' THEN '✕' END"
cte("cells", f"""
SELECT c.compare_id, c.ord, d.check_idx, d.key, d.label,
  coalesce({ICON} || ' ' || points_earned || '/' || r.points_max, '—') AS cell
FROM compared c CROSS JOIN dim d LEFT JOIN results r ON r.scan_id = c.scan_id AND r.key = d.key""")
