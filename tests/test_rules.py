"""Text, URL, robots and JSON-LD rules against plain-Python statements of the same rules."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from crawlgauge.functions import jsonld, robots, text, textrules, urls


# robots.txt and the crawlers it shuts out; '*' stands for all others.
ROBOTS = [
    ("", []),
    ("User-agent: GPTBot\nDisallow: /", ["GPTBot"]),
    ("user-agent: gptbot\nDISALLOW: /*", ["GPTBot"]),
    ("User-agent: GPTBot\nDisallow: /admin", []),
    ("User-agent: *\nDisallow: /", ["*"]),
    ("Disallow: /\nUser-agent: GPTBot", []),
    ("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /", []),
    ("User-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\nDisallow: /", ["GPTBot"]),
    ("User-agent: ClaudeBot\r\nAllow: /\r\nDisallow: /", ["ClaudeBot"]),
    ("User-agent: ClaudeBot\rDisallow: /", ["ClaudeBot"]),
    ("User-agent: ClaudeBot\x0bDisallow: /", ["ClaudeBot"]),
    ("User-agent: ClaudeBot\nDisallow: / # all", []),
    ("User-agent: ClaudeBot\n  DISALLOW :/", []),
    ("User-agent: unknown\nDisallow: /", []),
    ("  User-agent:  PerplexityBot  \n\tDisallow:   /  ", ["PerplexityBot"]),
    ("User-agent: *\nDisallow: /\nUser-agent: *\nDisallow: /*", ["*"]),
    ("# c\nUser-agent: GPTBot\n\nDisallow: /\nDisallow:", ["GPTBot"]),
]


def test_robots_answers(one):
    found = one(robots.robots_blocked, [body for body, _ in ROBOTS])
    assert [sorted(f) for f in found] == [blocked for _, blocked in ROBOTS]


# Patterns of mail addresses, phone numbers and prices.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d[\d\s\-\(\)]{8,14}|\(\d{3}\)\s?\d{3}[\-\s]\d{4})"
PRICE = r"[\$£€¥]\s*[\d,]+(?:\.\d{2})?"


def test_mentions_match_python_regexes(one):
    rng = random.Random(2)
    bits = ["a@b.co", "x.y+z@m-1.example.org", "logo@2x.png", "a@b.com1x@e.fr", "@", "..", " ", "$1,299.00", "€ 5",
            "£ 49", "¥", "$", "(415) 555-0134", "(415)555 0134", "+1 (212) 555-01-99", "+49 30 123456", "text", "-", "٣", "1.5"]
    texts = ["".join(rng.choice(bits) for _ in range(10)) for _ in range(400)]
    emails = [[e for e in re.findall(EMAIL, t) if not re.search(r"\.(png|jpg|svg|gif|css|js)$", e, re.I)] for t in texts]
    assert one(textrules.email_mentions, texts) == emails
    assert one(textrules.phone_mentions, texts) == [re.findall(PHONE, t) for t in texts]
    assert one(textrules.price_mentions, texts) == [re.findall(PRICE, t) for t in texts]


def test_strip_and_lines_follow_python(one):
    values = [" a　", " b\x1c", "c", "", "\n\t", "d\x85"]
    assert one(text.strip, values) == [v.strip() for v in values]
    values = ["a\r\nb", "a\x0bb\x0cc", "x y\x85z", "one"]
    assert one(text.split_lines, values) == [v.splitlines() for v in values]


def test_latin1_clean(one):
    chars = {"–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
    values = ["a–b—c", "‘q’ “d”…", "é ÿ ł 漢 😀", "plain"]

    def want(v):
        for bad, good in chars.items():
            v = v.replace(bad, good)
        return v.encode("latin-1", "replace").decode("latin-1")

    assert one(text.latin1_clean, values) == [want(v) for v in values]


HREFS = ["/a/b", "a/b", "./a", "../a", "/a/../b", "/a/./b/", "a//b", "?q=1", "//h.example/x", "ftp://f/x", "data:x",
         "http://o.example/p", "httpx/y", "/..", "a/..", "/x?y=/../z", "b#frag", "/a/b/../../../c"]


def test_url_join_follows_python(one):
    base = "https://s.example:8443"
    got = one(lambda c: urls.url_join(F.lit(base), c), HREFS)
    want = [h if h.startswith("http") else urljoin(base, h) for h in HREFS]
    assert got == want


def test_url_shaping(one):
    given = ["a.example", "http://a.example/x", "HTTP://a.example", "https://u:p@a.example:1/x?y"]
    assert one(urls.normalize_url, given) == [
        "https://a.example", "http://a.example/x", "https://HTTP://a.example", "https://u:p@a.example:1/x?y"]
    assert one(lambda c: urls.base_url(urls.normalize_url(c)), given) == [
        "https://a.example", "http://a.example", "https://HTTP:", "https://u:p@a.example:1"]
    assert one(urls.login_url, ["https://bloginfo.com/", "https://x/SSO", "https://x/authors"]) == [True, True, False]


def items(one, blocks):
    rows = one(lambda c: jsonld.jsonld_items(F.array(c)), blocks)
    return [[(i.kind, i.name) for i in r] for r in rows]


def test_jsonld_types(one):
    S = "STRING"
    cases = {
        '{"@type":"Product"}': [(S, "Product")],
        '{"@type":["WebSite","HowTo","WebSite"]}': [(S, "WebSite"), (S, "HowTo"), (S, "WebSite")],
        '{"@graph":[{"@type":"A"},{"@type":["B"]}],"@type":"Ignored"}': [(S, "A"), (S, "B")],
        '{"@graph":[{"@type":"A"},5,{"@type":"B"}]}': [(S, "A")],
        '{"@graph":{"@type":"A"}}': [],
        '{"@graph":null,"@type":"A"}': [],
        '[{"@type":"Product"}]': [],
        '{"@type":': [],
        '"text"': [],
        '{"@type":""}': [],
        '{"@type":null}': [],
        '{"@type":0}': [],
        '{"@type":7}': [("BIGINT", "7")],
        '{"@type":{}}': [],
        '{"@type":"First","@type":"Last"}': [(S, "Last")],
        '{"name":"x"}': [],
        "": [],
    }
    assert items(one, list(cases)) == list(cases.values())


def test_jsonld_object_type_is_unhashable(one):
    got = one(lambda c: jsonld.has_unhashable(jsonld.jsonld_items(F.array(c))),
              ['{"@type":{"a":1}}', '{"@type":[["a"]]}', '{"@type":["a",1]}'])
    assert got == [True, True, False]


def test_llms_structure(one):
    got = one(textrules.llms_structure, ["# T\n> s\n[a](https://x)", "#T\n >s", "text\r# T", "[a]\n(http://x)", "[](http://x)"])
    assert got == [["title", "summary", "links"], [], ["title"], [], []]


def test_cmp_providers(spark):
    df = spark.createDataFrame(
        [(["https://x.cookielaw.org/onetrust.com.js", "/usercentrics.js"], ["onetrust-consent-sdk", "uc-main-dialog"])],
        "srcs array<string>, ids array<string>",
    )
    row = df.select(textrules.cmp_providers(F.col("srcs"), F.col("ids")).alias("p")).first()
    assert row.p == ["cookielaw", "onetrust", "uc", "usercentrics"]


def test_jsonld_documents(one):
    blocks = {
        '{"@type":"Product"}': ["Product"],
        ' {"@type":"Product"} \n': ["Product"],
        '{"@type":"Product"};': [],
        '{"@type":"Product"} trailing': [],
        '{"@type":"Product"},{"@type":"Product"}': [],
        '{"@type":"0"}': ["0"],
        '{"@type":"false"}': ["false"],
        '{"@type":"{}"}': ["{}"],
        '{"@type":0}': [],
        '{"@type":false}': [],
        '{"@type":{}}': [],
        '{"@type":""}': [],
    }
    got = one(lambda c: jsonld.jsonld_types(jsonld.jsonld_items(F.array(c))), list(blocks))
    assert got == list(blocks.values())
