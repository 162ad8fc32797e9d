"""Crawl resources derived from the ``pages`` table by arithmetic on ``page_id`` (FIXTURES.md).

The texts and rules are plain data, so that ``oracle.py`` can state the same
derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.functions.outcomes import API_PATHS, KEY_PATHS, MCP_PATHS
from crawlgauge.functions.urls import base_url
from crawlgauge.sources.tables import PROBE_PATHS, TEXT_PATHS, TIMEOUTS, page_scan, spread

PATH_IDX = {p: i for i, p in enumerate(TIMEOUTS)} | {"/contact-us": 17, "/docs/pricing": 18, "/x": 19}


def _ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


_OG = '<meta property="og:title" content="t">'
_CDN = '<script src="https://cdn.cookielaw.org/x.js"></script>'
_SDK = '<div id="onetrust-consent-sdk"></div>'
_SHELL = (
    '<html><head><title>App</title></head><body><div id="app"></div>{}'
    '<script src="/static/a.js"></script><footer></footer></body></html>'
)
# Page that replaces the original one, by i % 6.
BASE_PAGES = {
    3: _SHELL.format(""),
    4: _SHELL.format("<p>" + "word " * 60 + "</p>"),
    5: "<html><head><title>T</title></head><body><p>Hello</p><footer></footer></body></html>",
}
# (modulus, snippet by remainder), concatenated in this order before the footer.
SNIPPETS = [
    (6, {1: '<div id="root"></div>', 2: '<div id="__next"></div><div id="root"></div>'}),
    (9, {
        1: _OG,
        2: _ld('{"@type":"FAQPage"}'),
        3: _ld('{"@type":"Organization"}'),
        4: _ld('{"@graph":[{"@type":"Organization"},{"@type":"Product"}]}'),
        5: _ld('{"@type":["WebSite","HowTo"]}') + _OG,
        6: _ld('{"@type":'),
        7: _ld('[{"@type":"Product"}]'),
        8: _ld('{"@type":"LocalBusiness"}'),
    }),
    (5, {
        1: "<p>Plan $1,299.00 monthly</p>",
        2: '<span itemprop="price">49</span>',
        3: "<p>£ 49 or €1,000</p>",
        4: '<span itemprop="price priceCurrency">x</span>',
    }),
    (4, {
        1: "<p>sales@acme.example.com</p>",
        2: "<p>Call (415) 555-0134 today</p>",
        3: "<p>logo@2x.png</p>",
    }),
    (11, {
        1: _CDN,
        2: '<script src="https://consent.cookiebot.com/uc.js"></script>',
        3: _SDK,
        4: _CDN + _SDK,
    }),
    (8, {1: '<input type="password">'}),
    (10, {
        0: '<a href="/pricing">Plans</a><a href="/contact-us">Talk to us</a><a href="/docs">Docs</a>',
        1: '<a href="/docs/pricing">Docs and pricing</a><a href="/x">Contact docs</a>',
        2: '<a href="https://other.example/pricing">Pricing</a>',
        3: '<a href="mailto:a@b.co">contact</a><a href="#pricing">pricing</a>',
    }),
]
ROBOTS = {
    1: "User-agent: *\nDisallow: /admin",
    2: "User-agent: GPTBot\nDisallow: /",
    3: "User-agent: *\nDisallow: /",
    4: "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /",
    6: "user-agent: claudebot\r\nDISALLOW: /*\r\n\r\nUser-agent: PerplexityBot\r\nDisallow: / # all",
}
LLMS = {
    1: "",
    2: "# Acme\n> We sell anvils\n[Pricing](https://acme.example/pricing)",
    3: "# Acme\n> We sell anvils",
    4: "Acme sells anvils of every size, shape and weight to coyotes and road crews in many countries.",
    5: "Acme sells anvils.",
    7: " \n\t ",
}
URLSET = "<url><loc>https://a.example/</loc></url>"
SITEMAP = {
    **{10 * k: "<urlset>" + URLSET * (k + 1) + "</urlset>" for k in range(4)},
    1: "<sitemapindex><sitemap></sitemap></sitemapindex>",
    4: "",
}
LAST_MODIFIED, ETAG = "Mon, 01 Jan 2024 00:00:00 GMT", 'W/"v1"'


def _pick(i: Column, modulus: int, texts: dict[int, str], default: Column) -> Column:
    chain = default
    for value, text in texts.items():
        chain = F.when(i % modulus == value, F.lit(text)).otherwise(chain)
    return chain


def page_html(html: Column, i: Column) -> Column:
    snippets = F.concat(*[_pick(i, m, texts, F.lit("")) for m, texts in SNIPPETS])
    base = _pick(i, 6, BASE_PAGES, html)
    return F.replace(base, F.lit("<footer>"), F.concat(snippets, F.lit("<footer>")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scan(spark, f"{sf_dir}/pages.parquet")


def homes(pages: DataFrame) -> DataFrame:
    """Homepages after the snippets: page_id, url, html."""
    i = F.col("page_id")
    pages = spread(pages, "page_id")
    return pages.select("page_id", "url", page_html(F.col("html"), i).alias("html"))


def _row(
    kind: str, path: Column, status: Column, final: Column, headers: Column, body: Column,
    error: Column, idx: Column,
) -> list[Column]:
    i = F.col("page_id")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    at = F.timestamp_micros(start + (i * 60 + idx) * 1_000_000)
    failed = error.isNotNull()
    return [
        i.alias("scan_id"),
        F.col("url").alias("site_url"),
        path.alias("path"),
        F.when(~failed, status.cast("int")).alias("status"),
        F.when(~failed, final).alias("final_url"),
        F.when(~failed, headers).alias("headers"),
        F.when(~failed, body).alias("body"),
        error.alias("error"),
        at.alias("fetched_at"),
        F.lit(kind).alias("kind"),
    ]


def _null() -> Column:
    return F.lit(None).cast("string")


def _headers(**pairs: Column) -> Column:
    """Header map holding the entries whose value is not NULL."""
    entries = [F.struct(F.lit(k.replace("_", "-")), v) for k, v in pairs.items()]
    full = F.map_from_entries(F.array(*entries))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def home_resources(pages: DataFrame) -> DataFrame:
    pages = spread(pages, "page_id")
    i = F.col("page_id")
    lm, tag = F.lit(LAST_MODIFIED), F.lit(ETAG)
    headers = _headers(
        Last_Modified=F.when((i % 4).isin(0, 1), lm),
        ETag=F.when((i % 4).isin(0, 2), tag),
        Etag=F.when(i % 12 == 3, tag),
    )
    final = F.when(i % 8 == 2, F.concat(base_url(F.col("url")), F.lit("/login"))).otherwise(F.col("url"))
    return pages.select(
        *_row(
            "home",
            F.lit("/"),
            F.when(i % 25 == 24, 503).otherwise(200),
            final,
            headers,
            page_html(F.col("html"), i),
            F.when(i % 25 == 23, F.lit("dns")),
            F.lit(0),
        )
    )


def _subpage_filter(i: Column, path: Column) -> Column:
    """Rows whose body is a sub-page of the site."""
    zero = (i % 10 == 0) & path.isin("/pricing", "/contact-us", "/docs")
    one = (i % 10 == 1) & path.isin("/docs/pricing", "/x")
    return zero | one


def wellknown_resources(pages: DataFrame, kind: str, paths: list[str]) -> DataFrame:
    """Text files or probes, without the key paths that have content; reads no HTML."""
    i = F.col("page_id")
    specs = [F.struct(F.lit(p).alias("path"), F.lit(PATH_IDX[p]).alias("idx")) for p in paths]
    rows = pages.select("page_id", "url", F.inline(F.array(*specs)))
    rows = rows.filter(~_subpage_filter(i, F.col("path")))
    path, idx = F.col("path"), F.col("idx")

    def pos(paths: list[str]) -> Column:
        return F.array_position(F.array(*[F.lit(p) for p in paths]), path) - 1

    api, mcp = path.isin(API_PATHS), path.isin(MCP_PATHS)
    status = (
        F.when(path == "/robots.txt", F.when(i % 7 == 0, 404).otherwise(200))
        .when(path == "/llms.txt", F.when(i % 8 == 0, 404).otherwise(200))
        .when(path == "/sitemap.xml", F.when(i % 5 == 2, 404).otherwise(200))
        .when(api, F.when((i + 2 * pos(API_PATHS)) % 13 == 0, 200).otherwise(404))
        .when(mcp, F.when((i + pos(MCP_PATHS)) % 6 == 0, 200).otherwise(404))
        .when((path == "/pricing") & (i % 8 == 3), 403)
        .when(path.isin("/pricing", "/docs"), 200)
        .otherwise(404)
    )
    final = F.concat(
        base_url(F.col("url")),
        F.when((path == "/docs") & (i % 8 == 4), F.lit("/auth/start")).otherwise(path),
    )
    headers = _headers(
        Access_Control_Allow_Origin=F.when(api & (i % 2 == 0), F.lit("*")),
        Content_Type=F.when(
            mcp, F.when(i % 4 == 1, F.lit("text/html")).otherwise(F.lit("application/json"))
        ),
    )
    sitemap_key = F.when(i % 5 == 0, 10 * (i % 4)).otherwise(i % 5)
    sitemap = _null()
    for key, text in SITEMAP.items():
        sitemap = F.when(sitemap_key == key, F.lit(text)).otherwise(sitemap)
    body = (
        F.when(path == "/robots.txt", _pick(i, 7, ROBOTS, _null()))
        .when(path == "/llms.txt", _pick(i, 8, LLMS, _null()))
        .when(path == "/sitemap.xml", sitemap)
        .otherwise(_null())
    )
    error = F.when(
        ((path == "/robots.txt") & (i % 7 == 5))
        | ((path == "/llms.txt") & (i % 8 == 6))
        | ((path == "/sitemap.xml") & (i % 5 == 3)),
        F.lit("timeout"),
    )
    return rows.select(*_row(kind, path, status, final, headers, body, error, idx))


def subpage_resources(pages: DataFrame, kind: str, paths: list[str]) -> DataFrame:
    """Sub-pages with content, stored with the probes where their path is also probed."""
    i = F.col("page_id")
    specs = [F.struct(F.lit(p).alias("path"), F.lit(PATH_IDX[p]).alias("idx")) for p in paths]
    linked = spread(pages, "page_id").filter((i % 10).isin(0, 1))
    rows = linked.select("page_id", "url", "html", F.inline(F.array(*specs)))
    rows = rows.filter(_subpage_filter(i, F.col("path")))
    path = F.col("path")
    gone = (i % 20 == 10) & (path == "/contact-us")
    final = F.concat(
        base_url(F.col("url")),
        F.when((path == "/docs") & (i % 8 == 4), F.lit("/auth/start")).otherwise(path),
    )
    return rows.select(
        *_row(
            kind,
            path,
            F.when(gone, 404).otherwise(200),
            final,
            F.create_map().cast("map<string,string>"),
            page_html(F.col("html"), i + 1),
            _null(),
            F.col("idx"),
        )
    )


def resources(pages: DataFrame) -> DataFrame:
    """All resources, one branch per stored kind: a filter on ``kind`` drops whole branches."""
    return (
        home_resources(pages)
        .unionByName(wellknown_resources(pages, "text", TEXT_PATHS))
        .unionByName(wellknown_resources(pages, "probe", PROBE_PATHS))
        .unionByName(subpage_resources(pages, "probe", ["/pricing", "/docs"]))
        .unionByName(subpage_resources(pages, "page", ["/contact-us", "/docs/pricing", "/x"]))
    )


def raw_urls(pages: DataFrame) -> DataFrame:
    """URL spellings as typed by users: bare hosts, odd schemes, ports, userinfo, queries."""
    i, url = F.col("page_id"), F.col("url")
    bare = F.regexp_replace(url, "^https?://", "")
    typed = (
        F.when(i % 6 == 1, bare)
        .when(i % 6 == 2, F.concat(F.lit("HTTP://"), bare))
        .when(i % 6 == 3, F.concat(F.lit("https://user:pw@"), F.replace(bare, F.lit("/"), F.lit(":8443/"))))
        .when(i % 6 == 4, F.concat(url, F.lit("?next=/auth/x")))
        .when(i % 6 == 5, F.concat(F.lit("http://login."), bare))
        .otherwise(url)
    )
    return pages.select(F.col("page_id").alias("scan_id"), typed.alias("url"))


def compare_requests(pages: DataFrame) -> DataFrame:
    """Four URLs per request, the second a repeat of the first in every fifth request."""
    group = F.floor(F.col("page_id") / 4).cast("bigint")
    lists = pages.groupBy(group.alias("compare_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]
        ).alias("urls")
    )
    first = F.slice("urls", F.lit(1), F.lit(1))
    repeated = F.concat(first, first, F.slice("urls", F.lit(2), F.lit(3)))
    return lists.select(
        "compare_id", F.when(F.col("compare_id") % 5 == 0, repeated).otherwise(F.col("urls")).alias("urls")
    )
