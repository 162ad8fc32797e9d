"""One hand-made site per branch of every check: expected reason, status and points."""

import datetime as dt

import pytest

from crawlgauge.operators import audit, scoring
from crawlgauge.registry import BUILTIN
from crawlgauge.sources import schemas

AT = dt.datetime(2024, 1, 1)
LONG = "word " * 200
OPEN_HOME = f"<body><p>{LONG}</p></body>"
LD = '<script type="application/ld+json">{}</script>'


def res(path, status=200, body="", headers=None, final=None, error=None):
    return {"path": path, "status": None if error else status, "body": None if error else body,
            "headers": headers or {}, "final_url": final, "error": error}


def home(body=OPEN_HOME, **kw):
    return res("/", body=body, **kw)


ROBOTS, LLMS, MAP = "/robots.txt", "/llms.txt", "/sitemap.xml"
CASES = [
    ("ai_crawler_access", "no_file", [res(ROBOTS, 404)]),
    ("ai_crawler_access", "blocked", [res(ROBOTS, body="User-agent: GPTBot\nDisallow: /")]),
    ("ai_crawler_access", "open", [res(ROBOTS, body="User-agent: *\nDisallow: /admin")]),
    ("ai_crawler_access", "unreachable", [res(ROBOTS, error="timeout")]),
    ("ai_crawler_access", "unreachable", []),
    ("llms_txt", "missing", [res(LLMS, 404)]),
    ("llms_txt", "empty", [res(LLMS, body=" \n ")]),
    ("llms_txt", "structured", [res(LLMS, body="# A\n> b")]),
    ("llms_txt", "unstructured", [res(LLMS, body="a" * 81)]),
    ("llms_txt", "sparse", [res(LLMS, body="# " + "a" * 78)]),
    ("llms_txt", "unreachable", [res(LLMS, error="reset")]),
    ("structured_data", "none", [home()]),
    ("structured_data", "og_only", [home('<meta property="og:title" content="t">' + OPEN_HOME)]),
    ("structured_data", "high_value", [home(LD.format('{"@type":["WebSite","Product"]}') + OPEN_HOME)]),
    ("structured_data", "generic_only", [home(LD.format('{"@type":"Zoo"}') + OPEN_HOME)]),
    ("structured_data", "check_exception", [home(LD.format('{"@type":{"a":1}}') + OPEN_HOME)]),
    ("structured_data", "check_exception", [home(LD.format('{"@type":5}') + OPEN_HOME)]),
    ("structured_data", "generic_only", [home(LD.format('{"@type":["WebSite",5]}') + OPEN_HOME)]),
    ("js_rendering", "empty_csr", [home("<body>x<script></script></body>")]),
    ("js_rendering", "spa_thin", [home(f'<body><div id="nuxt">{"x" * 599}</div></body>')]),
    ("js_rendering", "ssr", [home(f'<body><div id="nuxt">{"x" * 600}</div></body>')]),
    ("js_rendering", "ssr", [home("<body>tiny page, no script</body>")]),
    ("pricing_parsability", "markup", [home('<b itemprop="price">1</b>$5' + OPEN_HOME)]),
    ("pricing_parsability", "text_only", [home("<p>$ 5</p>" + OPEN_HOME)]),
    ("pricing_parsability", "none", [home(LD.format('{"price":"$5"}') + OPEN_HOME)]),
    ("contact_parsability", "found", [home("<p>a@x.org</p>" + OPEN_HOME)]),
    ("contact_parsability", "none", [home('<a href="mailto:a@x.org">mail</a>' + OPEN_HOME)]),
    ("api_discoverability", "found_cors", [
        res("/api/docs"), res("/openapi.json", headers={"access-control-allow-origin": "*"})]),
    ("api_discoverability", "found_no_cors", [
        res("/api/docs", headers={"Access-Control-Allow-Origin": ""}),
        res("/swagger.json", 404, headers={"Access-Control-Allow-Origin": "*"})]),
    ("api_discoverability", "none", [res("/openapi.json", error="timeout"), res("/api-docs", 500)]),
    ("sitemap", "ok", [res(MAP, body="<urlset><url><url></urlset>")]),
    ("sitemap", "malformed", [res(MAP, body="<sitemapindex/>")]),
    ("sitemap", "missing", [res(MAP, 410)]),
    ("sitemap", "unreachable", [res(MAP, error="timeout")]),
    ("cookie_consent_wall", "cmp", [home("<script src='https://cdn.Didomi.io/x.js'></script>" + OPEN_HOME)]),
    ("cookie_consent_wall", "none", [home("<script>var x='didomi.io'</script>" + OPEN_HOME)]),
    ("content_freshness", "both", [home(headers={"last-modified": "x", "etag": "y"})]),
    ("content_freshness", "lm_only", [home(headers={"Last-Modified": "x", "ETag": ""})]),
    ("content_freshness", "etag_only", [home(headers={"ETag": "x"})]),
    ("content_freshness", "none", [home(headers={"Etag": "x", "LAST-MODIFIED": "y"})]),
    ("auth_wall", "redirected", [home(final="https://s.example/SSO?x")]),
    ("auth_wall", "gated_home", [home('<input type="password">short')]),
    ("auth_wall", "gated_sub", [res("/plans", 401), res("/docs", final="https://s.example/auth/start")]),
    ("auth_wall", "login_form", [home('<input type="password">' + OPEN_HOME)]),
    ("auth_wall", "open", [res("/pricing", error="timeout"), res("/docs", 500)]),
    ("mcp_discoverability", "found", [res("/mcp/manifest.json", headers={"content-type": "application/json"})]),
    ("mcp_discoverability", "none", [
        res("/mcp/manifest.json", headers={"Content-Type": "text/html"}),
        res("/.well-known/mcp.json", 404, headers={"Content-Type": "application/json"})]),
]


@pytest.fixture(scope="module")
def audited(spark):
    rows = []
    for i, (_, _, given) in enumerate(CASES):
        given = given if any(g["path"] == "/" for g in given) else [home(), *given]
        for g in given:
            rows.append((i, f"https://s{i}.example/", g["path"], g["status"], g["final_url"], g["headers"], g["body"], g["error"], AT))
    df = spark.createDataFrame(rows, schemas.RESOURCES)
    out = scoring.with_score(audit.audit(df)).collect()
    return {r.scan_id: r for r in out}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{k}-{r}-{i}" for i, (k, r, _) in enumerate(CASES)])
def test_branch(audited, i):
    key, reason, _ = CASES[i]
    check = next(c for c in BUILTIN if c.key == key)
    status = check.reasons[reason].status
    got = next(c for c in audited[i].checks if c.key == key)
    assert (got.reason, got.status) == (reason, status)
    want = {"pass": check.points_max, "warning": check.points_max // 2, "fail": 0}[status]
    assert (got.points_earned, got.points_lost) == (want, check.points_max - want)
    assert "{" not in got.detail and "%" not in got.detail


def test_every_reason_is_covered():
    wanted = {(c.key, r) for c in BUILTIN for r in c.reasons if r != "check_exception"}
    assert wanted <= {(k, r) for k, r, _ in CASES}
    assert len(wanted) == 42


def test_invariants(audited):
    for row in audited.values():
        assert [c.key for c in row.checks] == [c.key for c in BUILTIN]
        assert sum(c.points_earned for c in row.checks) == row.raw_points
        assert row.max_points == 160 and 0 <= row.score <= 100
        assert row.score == round(row.raw_points * 100 / 160)
        assert row.n_pass + row.n_warning + row.n_fail == 12


def test_details_carry_arguments(audited):
    def detail(key, reason):
        i = next(i for i, c in enumerate(CASES) if c[:2] == (key, reason))
        return next(c.detail for c in audited[i].checks if c.key == key)

    assert "GPTBot" in detail("ai_crawler_access", "blocked")
    assert "timeout" in detail("ai_crawler_access", "unreachable")
    assert "Product" in detail("structured_data", "high_value") and "WebSite" in detail("structured_data", "high_value")
    assert "/openapi.json, /api/docs" in detail("api_discoverability", "found_cors")
    assert "/plans, /docs" in detail("auth_wall", "gated_sub")
    assert "2 URL" in detail("sitemap", "ok")
