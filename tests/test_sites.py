"""Assembly, scoring, links, comparisons and skew handling."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crawlgauge.functions.html import with_signals
from crawlgauge.functions.urls import base_url
from crawlgauge.operators import audit, compare, links, reports, scoring, subpages
from crawlgauge.plans.skew import salted_join
from crawlgauge.sources import schemas
from crawlgauge.sources.tables import resource_scan, write_resources
from verification import fixtures as fx

AT = dt.datetime(2024, 1, 1)
PAGE = "<body><p>" + "word " * 200 + "</p></body>"


def row(scan, path, status=200, body=None, at=0, error=None, headers=None, url=None):
    return (scan, url or f"https://s{scan}.example/", path, status, None, headers or {}, body, error,
            AT + dt.timedelta(seconds=at))


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.RESOURCES)


def reasons(df):
    return {(r.scan_id, r.key): r.reason for r in audit.check_results(df).collect()}


def test_latest_copy_wins_in_any_order(spark):
    rows = [
        row(1, "/", body=PAGE, at=0), row(1, "/", body="<p>$5</p>" + PAGE, at=9),
        row(1, "/robots.txt", 404, at=5), row(1, "/robots.txt", body="User-agent: *\nDisallow: /", at=2),
        row(1, "/openapi.json", 200, at=1), row(1, "/openapi.json", 404, at=3),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = reasons(audit.audit(table(spark, rows)))
        assert got[1, "pricing_parsability"] == "text_only"
        assert got[1, "ai_crawler_access"] == "no_file"
        assert got[1, "api_discoverability"] == "none"


def test_hot_scan_with_many_copies(spark):
    copies = table(spark, [row(1, "/", body=PAGE), row(1, "/pricing", 403)]).crossJoin(spark.range(2000)).drop("id")
    others = table(spark, [row(i, "/", body=PAGE) for i in range(2, 30)])
    out = scoring.scan_scores(audit.audit(copies.unionByName(others))).collect()
    assert len(out) == 29


def test_errors_never_mix_with_results(spark):
    rows = [row(1, "/", body=PAGE), row(2, "/", 503, body=PAGE), row(3, "/", None, error="dns"), row(4, "/robots.txt")]
    sites = audit.assemble(table(spark, rows))
    ok = {r.scan_id for r in audit.with_checks(sites).collect()}
    bad = {r.scan_id: r.error for r in audit.scan_errors(sites).collect()}
    assert ok == {1}
    assert bad == {2: "HTTP status 503", 3: "dns", 4: "homepage not fetched"}


def test_half_even_scores(spark):
    raw = [4, 12, 20, 28, 78, 160, 0]
    df = spark.createDataFrame([(r,) for r in raw], "r int")
    got = [x[0] for x in df.select(scoring.percent_half_even(F.col("r"), F.lit(160))).collect()]
    assert got == [2, 8, 12, 18, 49, 100, 0] == [round(r * 100 / 160) for r in raw]


def test_array_and_long_forms_agree(spark, small):
    audited = audit.audit(fx.resources(fx.pages(spark, small)))
    results = audit.check_results(audited).cache()
    short = {tuple(r) for r in scoring.scan_scores(audited).collect()}
    assert short == {tuple(r) for r in scoring.score_results(results).collect()}
    cols = ["scan_id", "rank", "key", "points_lost"]
    a = {tuple(r) for r in scoring.recommendations(audited).select(*cols).collect()}
    assert a == {tuple(r) for r in scoring.rank_results(results).select(*cols).collect()}
    by_scan = {}
    for scan, rank, _, lost in sorted(a):
        assert by_scan.get(scan, (0, 99)) <= (rank, 99) and lost <= by_scan.get(scan, (0, 99))[1]
        by_scan[scan] = (rank, lost)


# Links of a page as (text, href), and the page chosen for each type.
LINKS = [
    ([("Pricing", "/pricing")], {"pricing": "/pricing"}),
    ([("docs and pricing", "/a"), ("contact docs", "/b")], {"pricing": "/a", "contact": "/b"}),
    ([("docs and pricing", "/a"), ("docs", "/b"), ("price", "/c")], {"pricing": "/a", "docs": "/b"}),
    ([("our plans", ""), ("plans", "#x"), ("plans", "mailto:a@b.co"), ("plans", "/p")], {"pricing": "/p"}),
    ([("plans", "https://other.example/pricing"), ("x", "https://s.example/Developer")], {"docs": "/Developer"}),
    ([("talk to us", "/x"), ("contact", "/contact")], {"contact": "/x"}),
    ([("", "/plans-contact"), ("", "/docs/pricing")], {"pricing": "/plans-contact", "docs": "/docs/pricing"}),
    ([("about", "/about")], {}),
]


def test_links_choose_pages(spark):
    html = ["<body>" + "".join(f'<a href="{h}">{t}</a>' for t, h in page) + "</body>" for page, _ in LINKS]
    df = spark.createDataFrame([(i, "https://s.example", h) for i, h in enumerate(html)], "i int, url string, html string")
    out = links.with_subpage_links(with_signals(df), base_url(F.col("url"))).orderBy("i").collect()
    for (_, want), row in zip(LINKS, out):
        assert {l.page_type: l.page_url.removeprefix("https://s.example") for l in row.links} == want


def test_subpages_come_from_served_pages_only(spark):
    body = '<body><a href="/pricing">Pricing</a><a href="/contact#us">Contact</a><a href="https://s1.example">docs</a></body>'
    rows = [row(1, "/", body=body), row(1, "/pricing", 404), row(1, "/contact", body="<p>a@x.org</p>"),
            row(1, "/contact", body="<p>none</p>", at=5)]
    df = table(spark, rows)
    out = subpages.audit_subpages(audit.audit(df, links=True), df).orderBy("pos", "ord").collect()
    assert [(r.page_type, r.key, r.reason) for r in out] == [
        ("contact", "contact_parsability", "none"),
        ("docs", "structured_data", "none"), ("docs", "js_rendering", "ssr")]
    assert out[0].page_url == "https://s1.example/contact#us"


def test_stored_by_kind_gives_the_same_audit(spark, small, tmp_path):
    res = fx.resources(fx.pages(spark, small)).drop("kind")
    write_resources(res, str(tmp_path / "r"))
    stored = resource_scan(spark, str(tmp_path / "r"))
    assert "kind" in stored.columns
    want = {tuple(r) for r in scoring.scan_scores(audit.audit(res)).collect()}
    assert want == {tuple(r) for r in scoring.scan_scores(audit.audit(stored)).collect()}


def test_compare_keeps_duplicates_and_failures(spark):
    rows = [row(i, "/", body=PAGE, url=f"https://s{i}.example") for i in (1, 2)] + [row(3, "/", 500, url="https://s3.example")]
    sites = audit.assemble(table(spark, rows), links=False)
    asked = spark.createDataFrame(
        [(1, ["s1.example", "https://s3.example", "s1.example", "s2.example"]), (2, ["https://nowhere.example"])],
        "compare_id int, urls array<string>")
    scored = scoring.with_score(audit.with_checks(sites))
    out = compare.compare(asked, scored, audit.scan_errors(sites)).orderBy("compare_id", "ord").collect()
    assert [(r.compare_id, r.ord, r.scan_id, r.error) for r in out] == [
        (1, 0, 1, None), (1, 1, 3, "HTTP status 500"), (1, 2, 1, None), (2, 0, None, "not scanned")]
    matrix = compare.compare_matrix(compare.compare(asked, scored, audit.scan_errors(sites)))
    total = {r.compare_id: r for r in matrix.filter("key = 'total'").collect()}
    assert total[1].site_0 == total[1].site_2 and total[1].site_1 == "—"


def test_salted_join_equals_plain_join(spark):
    left = spark.range(20000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"))
    left = left.unionByName(spark.createDataFrame([(-1, None), (-2, "absent")], "id bigint, k string"))
    right = spark.range(97).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", 7)], "k string, v bigint"))
    for how in ("left", "inner"):
        want = sorted(map(repr, left.join(right, "k", how).select("id", "k", "v").collect()))
        got = sorted(map(repr, salted_join(left, right, "k", how, rows_per_slice=500).select("id", "k", "v").collect()))
        assert got == want


def test_rank_sites_equals_window_rank(spark):
    df = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "big").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(101)).cast("int").alias("score"))
    from pyspark.sql import Window as W

    want = df.withColumn("rank", F.rank().over(W.partitionBy("g").orderBy(F.desc("score"))))
    got = compare.rank_sites(df, "g")
    assert {tuple(r) for r in got.select("id", "rank").collect()} == {tuple(r) for r in want.select("id", "rank").collect()}


def test_report_skips_empty_sections(spark):
    nested = reports.nest_results(audit.audit(table(spark, [row(1, "/", body=PAGE)])))
    text = reports.report_text(nested, "2024-02-03").first().report
    assert "as of 2024-02-03" in text and "## Further pages" not in text and "\n1. " in text


def test_no_scan_is_lost(spark):
    rows = [row(1, "/", body=PAGE), row(2, "/robots.txt", body="x"), row(3, "/.well-known/mcp.json", 404)]
    df = table(spark, rows)
    for checks in (audit.BUILTIN, ()):
        errors = audit.scan_errors(audit.assemble(df, checks, links=False)).orderBy("scan_id").collect()
        assert [(r.scan_id, r.url, r.error) for r in errors] == [
            (2, "https://s2.example/", "homepage not fetched"), (3, "https://s3.example/", "homepage not fetched")]


def test_subpages_linked_with_another_scheme(spark):
    body = '<body><a href="http://s1.example/pricing">Pricing</a><a href="HTTPS://s1.example/contact">Contact</a></body>'
    df = table(spark, [row(1, "/", body=body), row(1, "/pricing", body="<p>$5</p>"), row(1, "/contact", body="<p>a@x.org</p>")])
    out = subpages.audit_subpages(audit.audit(df, links=True), df).orderBy("pos", "ord").collect()
    assert {r.page_url for r in out} == {"http://s1.example/pricing", "https://s1.example/contact"}


def test_matrix_refuses_sites_beyond_its_limit(spark):
    checks = "array<struct<key: string, status: string, points_earned: int, points_max: int>>"
    rows = [("c", i, None, 50 + i) for i in range(5)]
    compared = spark.createDataFrame(rows, f"compare_id string, ord int, checks {checks}, score int")
    last = compare.compare_matrix(compared, limit=5).filter("key = 'total'").first()
    assert [last[f"site_{i}"] for i in range(5)] == [f"{50 + i}/100" for i in range(5)]
    with pytest.raises(Exception, match="limit of 3 sites"):
        compare.compare_matrix(compared).collect()
