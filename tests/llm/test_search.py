import math
from collections import Counter

import duckdb
import pytest
from plain import odd_frame

from crawlgauge.llm import queries, search
from crawlgauge.llm.common import table


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z" or "A" <= c <= "Z":
            word += c.lower() if c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_search(docs, items, best=10):
    words = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in words if c)
    total = sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in words:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(1, total)
            score = 0
            for term in plain_terms(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_query_equals_a_plain_search_and_its_sql(spark, small):
    docs, items = (rows_of(table(spark, small, t), i, "text") for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted(rows_of(queries.op12_term_owners(spark, small), "item_id", "rank", "doc_id", "score"))
    assert got == plain_search(docs, items) and len(got) > 5 * len(items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.execute(queries.ORACLE["op12_term_owners"]).fetchall()
    assert sorted(want) == got


@pytest.mark.parametrize("owners", [(1.0,), (0.02, 1.0), (0.01, 0.05, 0.2, 1.0)])
def test_owners_blocks_and_sets_change_nothing(spark, small, owners):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    want = plain_search(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"), 3)
    found = search.search(docs, items, best=3, owners=owners, block_docs=17, vocabulary=100 if len(owners) == 2 else 10**6)
    assert sorted(rows_of(found, "item_id", "rank", "doc_id", "score")) == want


def test_copies_tie_in_order_of_their_ids(spark):
    text = "rare words of a common text with many copies"
    docs = [(i, text) for i in range(300, 0, -1)] + [(1000 + i, f"filler {i} text") for i in range(200)]
    items = [("a", "rare copies"), ("b", "filler text"), ("c", "rare"), ("c", "rare rare filler")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id string, text string")
    for block in (7, 8192):
        got = sorted(rows_of(search.search(d, i, block_docs=block), "item_id", "rank", "doc_id", "score"))
        assert got == plain_search(docs, items)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_frame(spark).filter("doc_id IS NOT NULL")
    items = spark.createDataFrame(
        [("q", "The LAZY dog; été naïve STRASSE Straße", "x"), (None, "lorem", "x"), ("n", None, "x"), ("e", " .,;", "x"), ("z", "absent", "x")],
        "item_id string, text string, score string")
    rows = rows_of(docs, "doc_id", "text")
    got = rows_of(search.search(docs, items), "item_id", "rank", "doc_id", "score")
    want = plain_search(rows, [(r.item_id, r.text) for r in items.collect() if r.item_id]) + plain_search(rows, [(None, "lorem")])
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) >= 5
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    with_null = search.search(odd_frame(spark), spark.createDataFrame([("q", "row without id")], "item_id string, text string"))
    assert [r.doc_id for r in with_null.collect()] == [None]
