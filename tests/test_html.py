"""HTML signals against a walk with the standard library's parser."""

import html as htmllib
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from crawlgauge.functions import html as H
from verification import fixtures as fx

HIDDEN = {"script", "style", "template", "rt", "rp"}


class Walk(HTMLParser):
    """Text runs, scripts, anchors and ids of a document, one event at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.runs, self.run, self.hidden, self.body = [], "", [], None
        self.scripts, self.tags, self.in_body = 0, [], False
        self.saw_body = False

    def flush(self):
        if self.run:
            self.runs.append((self.run, self.in_body))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.tags.append((tag, dict(attrs)))
        self.scripts += tag == "script"
        if tag == "body":
            self.in_body = self.saw_body = True
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.tags.append((tag, dict(attrs)))
        self.scripts += tag == "script"

    def handle_endtag(self, tag):
        self.flush()
        if tag in ("body", "html"):
            self.in_body = False
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_comment
    handle_pi = handle_comment

    def add(self, text):
        if not self.hidden:
            self.run += text

    handle_data = add

    def handle_entityref(self, name):
        self.add(htmllib.unescape(f"&{name};") if f"{name};" in htmllib.entities.html5 else f"&{name}")

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        if 128 <= code < 160:
            self.add(bytes([code]).decode("cp1252", "replace"))
        else:
            self.add(chr(code))


def walk(text):
    w = Walk()
    w.feed(text)
    w.close()
    w.flush()
    return w


def joined(w, body):
    runs = [r for r, inside in w.runs if inside or not body or not w.saw_body]
    return " ".join(s for s in (r.strip() for r in runs) if s)


@pytest.fixture(scope="module")
def read(spark):
    def run(documents):
        df = spark.createDataFrame(list(enumerate(documents)), "i int, html string")
        return H.with_signals(df).orderBy("i").collect()

    return run


DOCUMENTS = [
    "<html><body><p>Hello <b>big</b> world</p></body></html>",
    "<p>no body&nbsp;here</p>",
    "<body>a<!-- x <b>hidden</b> -->b<script>var s='</p><!--';</script>c</body>tail",
    "<body><script>document.write('<script src=x>')</script>after</body>",
    "<body><img alt='a > b' title=\"x>y\">seen</body>",
    "<body><style>p{}</style><template>gone <b>too</b></template>kept</body>",
    "<body>3 < 5 and 6 > 4</body>",
    "<body><ruby>kan<rt>hidden</rt></ruby>ji</body>",
    "<body>&amp;copy; &copy; &euro;5 &#8364;6 &#x20AC;7 &#150; &bogus; &eacute;t&eacute;</body>",
    "<BODY CLASS=x>Upper <BR/>case</BODY>",
    "<title>T</title><body><p>x</p></body>",
    "<body><script src='/a.js'></script><SCRIPT SRC=/B.js></SCRIPT>t</body>",
    "<body><textarea>in area</textarea> <a href='/x'>l<b>i</b>nk</a></body>",
    "<body>x</body></html> after the end",
    "<p>unclosed comment <!-- rest <b>of it</b>",
    "<body>tab\tand 　 wide space </body>",
    "<body><p>a</p>\n   \n<p>b</p></body>",
    "plain text only",
    "",
]


def test_text_matches_parser_walk(read):
    for doc, row in zip(DOCUMENTS, read(DOCUMENTS)):
        w = walk(doc)
        if "unclosed comment" in doc:
            assert row.text_all_joined == "unclosed comment"
            continue
        assert row.text_all_joined == joined(w, False), doc
        assert row.text_body_joined == joined(w, True), doc
        assert row.script_count == w.scripts, doc


def test_text_matches_parser_walk_on_given_pages(spark, small):
    pages = fx.homes(fx.pages(spark, small))
    texts = {r.page_id: r.html for r in pages.collect()}
    for row in H.with_signals(pages).collect():
        w = walk(texts[row.page_id])
        assert row.text_all_joined == joined(w, False)
        assert row.text_body_joined == joined(w, True)
        assert row.script_count == w.scripts
        links = [a["href"].strip() for t, a in w.tags if t == "a" and "href" in a]
        assert [a.href for a in row.anchors] == links
        assert list(row.div_ids) == [a["id"] for t, a in w.tags if t == "div" and "id" in a]


def test_random_markup_matches_parser_walk(read):
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<div id=a>", "</div>", "word ", " & ", "&amp;", "&lt;b&gt;", "<!-- c -->", "\n ",
            "<script>if(a<b){}</script>", "<style>x</style>", "<br/>", "<a href='/q?a=1&amp;b=2'>", "</a>", "é", "5 "]
    docs = ["<body>" + "".join(rng.choice(bits) for _ in range(30)) + "</body>" for _ in range(60)]
    for doc, row in zip(docs, read(docs)):
        w = walk(doc)
        assert row.text_all_joined == joined(w, False), doc
        assert row.script_count == w.scripts, doc


def test_unclosed_script_hides_the_rest(read):
    (row,) = read(["<body>before<script>var x; <p>not text"])
    assert row.text_body_joined == "before" and row.script_count == 1


def test_attribute_values(read):
    (row,) = read([
        '<meta content="t" property="og:title"><span itemprop=\'price\'>1</span><input TYPE="password">'
        '<div data-id="root" id="app"></div><!-- <div id="root"></div> -->'
    ])
    assert row.has_og_title and row.has_itemprop_price and row.has_password
    assert row.csr_root == "app"
    (row,) = read([
        '<meta property="og:title2"><span itemprop="price priceCurrency">1</span><input type="PASSWORD">'
        '<span id="root"></span><p>itemprop="price" type="password" og:title</p>'
    ])
    assert not (row.has_og_title or row.has_itemprop_price or row.has_password)
    assert row.csr_root is None


def test_csr_root_follows_list_order(read):
    (row,) = read(['<div id="__next"></div><div id="root"></div>'])
    assert row.csr_root == "root"


def test_fused_and_blank_runs(read):
    (row,) = read(["<b>a@x.com</b><i>z</i><p>(415)</p>\n     <p>555-0134</p>"])
    assert row.text_all_concat == "a@x.comz(415)\n555-0134"


def test_anchor_text_and_href(read):
    (row,) = read(['<a name=x>no link</a><a class="b" href=" /p?a=1&amp;b=2 ">Get <b>In</b> Touch</a><a href="/u">open'])
    assert [(a.text, a.href) for a in row.anchors] == [("getintouch", "/p?a=1&b=2"), ("open", "/u")]


def test_ld_json_needs_the_exact_type(read):
    (row,) = read([
        '<script type="application/ld+json">{"a":1}</script><script type="Application/LD+json">{"b":1}</script>'
        '<script type="text/x">application/ld+json</script>'
    ])
    assert row.ld_json == ['{"a":1}']


def test_deep_and_long_documents_do_not_overflow(read):
    docs = ["<body>" + "<div class='x' data-a=\"1\">" * 20000 + "deep" + "</div>" * 20000,
            "<body><p " + "a=b " * 50000 + ">long tag</p>", "<body>" + "x" * 300000 + "@"]
    rows = read(docs)
    assert [r.text_body_joined[-8:] for r in rows] == ["deep", "long tag", "xxxxxxx@"]


def test_entities_decode_once(one):
    got = one(H.decode_entities, ["&amp;lt;", "&#38;copy;", "&commat;", "&copy 2024", "&#xD800;", "AT&T", "&", "&#", "a&b;c"])
    assert got == ["&lt;", "&copy;", "@", "© 2024", "�", "AT&T", "&", "&#", "a&bc"]


def test_signals_stay_in_the_jvm(spark, small):
    plan = H.with_signals(fx.homes(fx.pages(spark, small)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert F is not None


def test_markup_inside_attribute_values_is_no_markup(spark):
    pages = [
        "<input value='<script src=\"https://cdn.cookielaw.org/x.js\"></script>'>",
        '<p title="<!-- note">visible text</p><a href="/pricing">Go</a>',
        """<div data-content="<a href='/pricing'>Pricing</a>">x</div>""",
        '<iframe srcdoc="<script>x</script><script>y</script>"></iframe>',
        "&#x100000041; &check; &#x0000000041;",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    out = H.with_signals(df).orderBy("i").collect()
    assert [r.script_count for r in out] == [0] * 5
    assert [[(a.text, a.href) for a in r.anchors] for r in out] == [[], [("go", "/pricing")], [], [], []]
    assert [r.text_all_joined for r in out] == ["", "visible text Go", "x", "", "\ufffd \u2713 A"]


def test_control_characters_change_nothing(spark):
    """The characters that mark cuts, raw or as references, in text, attributes, scripts and links."""
    from crawlgauge.functions.html import with_signals

    clean = (
        '<html><head><title>T</title><meta property="og:title" content="x"></head><body class="c"><p>a href=/ghost b</p>'
        '<a href="/docs">Docs <b>here</b></a><div id="root">x</div><span itemprop="price">9</span>'
        '<script type="application/ld+json">{"@type":"Product"}</script><input type="password"></body></html>'
    )
    rng = random.Random(7)
    pages = [clean]
    for _ in range(40):
        page = clean
        for _ in range(12):
            at = rng.randint(0, len(page))
            page = page[:at] + chr(rng.randint(1, 5)) + page[at:]
        pages.append(page)
    pages.append(clean.replace("a href=/ghost", "&#1;a &#x4;href=/ghost&#5;").replace("Docs <b>", "&#2;Docs &#3;<b>"))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    out = [tuple(r)[1:] for r in with_signals(df).orderBy("i").collect()]
    assert all(o == out[0] for o in out[1:])
    assert "/ghost" not in [a.href for a in with_signals(df).first().anchors]
