import base64
import html
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from plain import ODD, odd_frame, text_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlgauge.llm import bpe, decision_list, html_density, pii_crf, token_files, weak_labels
from crawlgauge.llm.common import table


def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark):
    docs = odd_frame(spark)
    coded = docs.select("doc_id", "text", bpe.encode(F.col("text")).alias("ids"))
    enc = library()
    for r in coded.select("text", "ids", bpe.decode(F.col("ids")).alias("raw")).collect():
        text = r.text or ""
        assert bytes(r.raw) == text.encode()
        if " " * 5000 not in text:
            assert r.ids == enc.encode_ordinary(text)
    assert docs.limit(0).select(bpe.encode(F.col("text"))).collect() == []


def test_bpe_chunks_and_long_spaces_change_nothing():
    rng, enc = random.Random(3), library()
    bits = ["don't", " ", "  ", "\n", "\t", "x1", "é", "!?", "'s", " ", "\x1c", "word", "日本", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(60))
        assert sum((enc.encode_ordinary(c) for c in bpe.chunks(text, 7)), []) == enc.encode_ordinary(text)
    for tail in ("", "x", " x", "\n", "'s"):
        for run in (" " * 4097, "\n" * 4097, " " * 4096 + "\n", "\n" * 4096 + " "):
            got = bpe.encode_text("a" + run + tail, bpe.encoding()).tolist()
            assert got == enc.encode_ordinary("a" + run + tail)


def test_counts_equal_a_plain_count(spark):
    docs = decision_list.judge(odd_frame(spark), [])
    assert {"shard", "score"} <= set(docs.columns)
    for r in docs.collect():
        want = text_counts(r.text)
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert decision_list.judge(odd_frame(spark, []), []).count() == 0


def test_rules_are_learned_in_order_and_become_one_expression(spark):
    rng = np.random.default_rng(1)
    n = 3000
    columns = {k: rng.random(n) for k in decision_list.features()}
    bad = (columns["upper_share"] > 0.8) | ((columns["digit_share"] > 0.7) & (columns["repeat_share"] <= 0.3))
    rules = decision_list.learn(columns, bad)
    caught = np.any([decision_list.covered(r, columns, n) for r in rules], axis=0)
    assert 2 <= len(rules) <= 6 and (caught == bad).mean() > 0.98
    assert "CASE WHEN" in str(decision_list.verdict(rules)._jc.toString()) and decision_list.learn(columns, ~bad & bad) == []
    docs = odd_frame(spark)
    none = spark.createDataFrame([(0, None)], "doc_id long, quality int")
    assert decision_list.learn_from(docs, none) == []


def test_rules_on_the_given_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    judged = decision_list.judge(docs, decision_list.learn_from(docs, labels)).filter("not base_failed")
    rows = judged.join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.97 * len(rows)


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.85
    hit, wrong = np.array([0.9, 0.5, 0.4, 0.6]), 0.001
    votes = np.where(truth[:, None], rng.random((20000, 4)) < wrong, rng.random((20000, 4)) < hit)
    patterns, counts = np.unique(np.where(votes, weak_labels.BAD, weak_labels.GOOD), axis=0, return_counts=True)
    model = weak_labels.expectation_maximisation(patterns, counts.astype(float))
    found = np.exp(model.tables[:, weak_labels.BAD, weak_labels.BAD + 1])
    assert np.abs(found - hit).max() < 0.05
    assert abs(np.exp(model.prior[weak_labels.GOOD]) - 0.85) < 0.02


def test_expectation_maximisation_equals_enumeration():
    """One round over counted patterns is that over the documents themselves."""
    rng = np.random.default_rng(8)
    rows = rng.choice([weak_labels.NONE, weak_labels.BAD, weak_labels.GOOD], (400, 3), p=[0.3, 0.2, 0.5])
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    for rounds in (1, 2, 7):
        a = weak_labels.expectation_maximisation(patterns, counts.astype(float), rounds)
        b = weak_labels.expectation_maximisation(rows, np.ones(400), rounds)
        assert np.allclose(a.tables, b.tables) and np.allclose(a.prior, b.prior)
    # Posterior of a pattern by Bayes' rule, vote by vote.
    for row in patterns:
        odds = np.exp(a.prior[weak_labels.GOOD] - a.prior[weak_labels.BAD])
        for j, vote in enumerate(row):
            odds *= np.exp(a.tables[j, weak_labels.GOOD, vote + 1] - a.tables[j, weak_labels.BAD, vote + 1])
        assert np.isclose(a.posterior(row[None])[0], odds / (1 + odds))


def test_weak_labels_on_copies(spark):
    """Thousands of copies of few texts: all of them are drawn and junk is not kept."""
    rng = random.Random(4)
    good = [" ".join("".join(rng.choices("aeioustrnl", k=rng.randint(2, 8))) for _ in range(80)) + "." for _ in range(8)]
    junk = ["$$$ ### !!! %%% $$$ " * 12, "1234 5678 #### $$ " * 20]
    texts = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    copies = texts.crossJoin(spark.range(3000).select(F.col("id").alias("copy")))
    judged = weak_labels.classify(copies).groupBy("doc_id").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).collect()
    assert len(judged) == 10
    for r in judged:
        assert r.a == r.b == (r.doc_id < len(good))


def test_weak_labels_classify(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = weak_labels.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.95 * len(rows)
    odd = {r.doc_id: r for r in weak_labels.classify(odd_frame(spark)).collect()}
    assert odd[1].score == odd[2].score == odd[3].score == 0.0 and not odd[1].kept and odd[0].score == odd[4].score
    assert weak_labels.classify(odd_frame(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header class="site-header"><h1>Site</h1><nav><a href=1>Home</a></nav>
</header><div id="cookie-notice">We use cookies.</div><div class="wrap"><div class="content"><h1>Title &amp; more</h1>
<p>First with <a href=x>link</a> and <b>bold</b>   text that is long enough.</p><p>Short.</p><ul><li>One<li>Two</ul>
<form><input><label>Mail</label></form><div class="ad-slot">Buy</div><script>var t = "</p>";</script></div>
<div class="sidebar"><p>Side text</p></div><div class="comments"><p>A long reader comment that must be left out</p></div>
</div><footer>&copy; me</footer></body></html>"""


def test_html_articles():
    assert html_density.main_text(PAGE) == (
        "Title & more\n\nFirst with link and bold text that is long enough.\n\nShort.\n\nOne\n\nTwo"
    )
    links = "<ul><li><a href=1>Home</a><li><a href=2>About us</a></ul>"
    assert html_density.main_text(links + "<h1>T</h1><p>Some words.</p><p>More words.</p>") == "T\n\nSome words.\n\nMore words."
    cases = {None: "", "": "", "<div>": "", "plain &eacute; <": "plain é <", "<p>a<p>b<br>c": "a\n\nb c"}
    assert {k: html_density.main_text(k) for k in cases} == cases
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert html_density.main_text(deep) == "deep text"


ARTICLE = "<h1>Title</h1><p>" + "First words of the article here. " * 5 + "</p><p>" + "Second part with more words. " * 6 + "</p>"
SIDE = "<p>" + "Side text. " * 5 + "</p>"


def test_html_names_of_a_layout():
    whole = html_density.main_text(f"<article>{ARTICLE}</article>")
    pages = [
        f'<div id="content-sidebar-wrap"><div id="content">{ARTICLE}</div><div class="sidebar">{SIDE}</div></div>',
        f'<div class="layout with-sidebar"><div>{ARTICLE}</div><div id="sidebar">{SIDE}</div></div>',
        f'<div class="post share-enabled">{ARTICLE}</div><div class="share">{SIDE}</div>',
        f'<article><div class="post share-enabled">{ARTICLE}</div><div class="share-buttons">{SIDE}</div></article>',
        f'<div class="social-page">{ARTICLE}</div>',
        f'<div class="widget">{ARTICLE}</div>',
        f'<div id="top">{ARTICLE}</div>',
        # Names still take what surrounds an article, however long the comments are.
        f'<div id="content">{ARTICLE}</div><div id="comments">{SIDE * 20}</div>',
        f'<div id="content">{ARTICLE}</div><div class="post-comments">{SIDE}</div>',
    ]
    for page in pages:
        assert html_density.main_text(page) == whole, page


def test_html_parts_beside_the_core():
    one, two, three = (f"<p>{w} words of a part. {w} more of them here.</p>" * n for w, n in (("One", 4), ("Two", 5), ("Third", 3)))
    texts = {t: html_density.main_text(f"<main>{t}</main>") for t in (one, two, three)}
    whole = "\n\n".join(texts.values())
    link = "<p><a href=x>Permalink</a></p>"
    for tag in ("section", "div", "article"):
        parts = "".join(f"<{tag}>{t}</{tag}>" for t in (one, two, three))
        for page in (f"{parts}{link}", f"<div>{parts}{link}</div>", f"<div>{link}<div>{parts}</div></div>{link}"):
            assert html_density.main_text(page) == whole, page
    page = f"<div><h2>Head</h2><section>{one}</section><p>Short.</p><section>{two}</section>{link}</div><div>Made in 2020</div>"
    assert html_density.main_text(page) == f"Head\n\n{texts[one]}\n\nShort.\n\n{texts[two]}"


def test_html_on_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    for r in pages.select("html", html_density.extract(F.col("html")).alias("text")).collect():
        inner = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", p))) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(" ".join(p.split()) for p in parts if p.strip())


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii_crf.KINDS.index(s[0])))


def test_patterns_equal_plain_regexes():
    rng = random.Random(5)
    bits = ["a@b.co", "x.y+z@m-1.example.org", "@", ".", "..", " ", "-", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111", "1111",
            "4111111111111111", "+1 (415) 555-0134", "+", "(", ")", "_", "é", "12", "7", "a.b", "+49 30 123456"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(9))
        assert pii_crf.pattern_spans(text) == plain_pii(text), text


def test_crf_on_held_out_rows():
    model = pii_crf.default_model()
    rows = pii_crf.labelled_table(500, seed=99)
    found = pii_crf.crf_spans([t for t, _ in rows], model)
    right = sum(f == s for f, (_, s) in zip(found, rows, strict=True))
    assert right > 0.97 * len(rows)
    for text in ("9" * 50_000, "a" * 200_000, "a@" * 20_000, "= " * 20_000, "+" + "1 " * 20_000):
        pii_crf.all_spans([text], model)


def test_lists_of_numbered_words_are_no_personal_data():
    model = pii_crf.default_model()
    rng = random.Random(7)
    texts = [
        " ".join(f"word{i}" for i in range(40_000)), " ".join(f"w{rng.randrange(999)}" for _ in range(300)),
        " ".join(f"item{i}," for i in range(200)), " ".join(f"{rng.randrange(10)}x{rng.randrange(99)}" for _ in range(200)),
        " ".join(f"col_{i}={i}" for i in range(200)), " ".join(str(y) for y in range(1900, 2030)),
    ]
    assert pii_crf.all_spans(texts, model) == [[]] * len(texts)
    # Values between numbered words are still found.
    text = " ".join(f"row{i}" for i in range(20)) + " (415) 555-0134 " + " ".join(f"row{i}" for i in range(20))
    assert [(k, text[a:b]) for k, a, b, _ in pii_crf.all_spans([text], model)[0]] == [("phone", "(415) 555-0134")]


def test_viterbi_and_training_equal_enumeration():
    rng = np.random.default_rng(6)
    size = len(pii_crf.LABELS)
    hard_moves, hard_first = pii_crf._constraints()
    moves, first = rng.normal(size=(size, size)) + hard_moves, rng.normal(size=size) + hard_first
    model = pii_crf.Crf({}, np.zeros((1, size)), moves, first)
    for n in (1, 2, 3):
        scores = rng.normal(size=(5, n, size)) * 2
        got = pii_crf.viterbi(scores, model)
        for run in range(5):
            paths = list(itertools.product(range(size), repeat=n))
            value = [
                first[p[0]] + sum(scores[run, t, p[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
                for p in paths
            ]
            assert tuple(got[run]) == paths[int(np.argmax(value))]


def test_base_spans_and_added_spans_never_touch():
    model = pii_crf.default_model()
    text = " ".join(f"a{i}@b.org 10.0.0.{i % 256} (415) 555-{i:04} 4111 1111 1111 1111" for i in range(3000))
    spans = pii_crf.all_spans([text], model)[0]
    base = [s for s in spans if s[3]]
    added = [s for s in spans if not s[3]]
    assert [s[:3] for s in base] == pii_crf.pattern_spans(text)
    covered = np.zeros(len(text), bool)
    for _, a, b, _ in base:
        covered[a:b] = True
    assert not any(covered[a:b].any() for _, a, b, _ in added)


def test_secrets_of_letters_only():
    model = pii_crf.default_model()
    held = {
        "password: correcthorsebattery": "correcthorsebattery",
        "token QwErTyUiOpAsDfGhJkLz": "QwErTyUiOpAsDfGhJkLz",
        "so the secret: hGqLwZkTbNvRxYpMdSfJ ok": "hGqLwZkTbNvRxYpMdSfJ",
        '{"token":"QwErTyUiOpAsDfGhJkLz"}': "QwErTyUiOpAsDfGhJkLz",
        "see kTbNvRxYpMdSfJhGqLwZ there": "kTbNvRxYpMdSfJhGqLwZ",
    }
    for text, value in held.items():
        assert [(k, text[a:b]) for k, a, b, _ in pii_crf.all_spans([text], model)[0]] == [("secret", value)], text
    others = [
        "the key characteristics of administration", "key findings: responsibilities", "Key: value. The token is short",
        "getUserAccountNameById(x) AbstractSingletonProxyFactoryBean", "https://example.com/some/path/thing",
        "state-of-the-art internationalization ____________________", "The password is required. Token authentication",
    ]
    assert pii_crf.all_spans(others, model) == [[]] * len(others)
    for text in ("key: " * 20_000, "key:" * 20_000, "Aa" * 100_000, "key " + "x" * 200_000):
        pii_crf.all_spans([text], model)


def test_pii_columns(spark):
    text = 'mail é.b@c.org, 10.0.0.1 and token = "0123456789abcdef0123456789abcdef01234567" end'
    rows = [*ODD, (20, text)]
    docs = odd_frame(spark, rows)
    by_id = {r.doc_id: r for r in docs.select("doc_id", pii_crf.find(F.col("text")).alias("s")).collect()}
    assert [(s.kind, text[s.start : s.end], s.base) for s in by_id[20].s] == [
        ("email", ".b@c.org", True), ("ip", "10.0.0.1", True), ("secret", text[38:78], False)
    ]
    assert by_id[1].s == by_id[2].s == by_id[0].s == []
    clean = {r.doc_id: r.t for r in docs.select("doc_id", pii_crf.redact(F.col("text")).alias("t")).collect()}
    assert clean[20] == 'mail é[EMAIL], [IP] and token = "[SECRET]" end' and clean[1] is None and clean[0] == ODD[0][1]


def test_token_files_round_trip(spark, tmp_path):
    rows = [*ODD, (11, "<|endoftext|> a <|ENDOFTEXT|>"), (12, "x'll don't ''s 12,5% ½ foo_bar"), (13, "ẖ ẖ ẞ İ")]
    token_files.write_files(odd_frame(spark, rows), str(tmp_path / "f"), block_ids=500, part_bytes=100_000)
    got = token_files.read_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    tool = Tokenizer.from_file(token_files.VOCABULARY)
    want = [[*tool.encode(t or "", add_special_tokens=False).ids, 1] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    assert [r.ids for r in got] == want and [r.doc_id for r in got][0] is None
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    token_files.write_files(odd_frame(spark, []), str(tmp_path / "e"))
    assert token_files.read_files(spark, str(tmp_path / "e")).count() == 0


def test_variable_length_numbers():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = (rng.random(n) * 2.0 ** rng.integers(1, 32, n)).astype(np.uint32)
        control, data = token_files.encode_numbers(numbers)
        assert len(control) == -(-n // 4) and (token_files.decode_numbers(control, data, n) == numbers).all()


def test_words_are_encoded_as_the_library_would():
    texts = ["ΟΔΟΣ ÉÀ ß ẞ İ", "a b\x1cc\x85d", "naïve.,é.É!é", "日本語 テスト。x", "Å á ́b", None, "'90s '' ',", "x<|y"]
    tool = token_files.encoder()
    flat, counts = tool.batch(pa.array(texts, pa.string()))
    assert [list(p) for p in np.split(flat, np.cumsum(counts)[:-1])] == tool.whole([t or "" for t in texts])
