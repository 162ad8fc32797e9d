import random

import duckdb
import numpy as np
import pyarrow as pa
from plain import ODD, components, contamination, lm_scores, odd_frame, shingles
from pyspark.sql import functions as F

from crawlgauge.llm import decontaminate, jaccard_join, lm, sharding
from crawlgauge.llm.common import _values, table
from crawlgauge.llm.queries import ORACLE, QUERIES
from verification.check import canonical


def test_lm_equals_a_plain_model(spark):
    given = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()]
    rows = [*((1000 + i, t) for i, t in given), *ODD]
    for order, mass in ((2, 300.0), (3, 7.0)):
        got = lm.score_documents(odd_frame(spark, rows), order=order, mass=mass, block_bytes=100_000, part_bytes=30_000).collect()
        want = sorted((i is not None, i or 0, *s) for (i, _), s in zip(rows, lm_scores(rows, order, mass), strict=True))
        have = sorted(
            (r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got
        )
        for a, b in zip(have, want, strict=True):
            assert a[:5] == b[:5]
            assert all(abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in zip(a[5:], b[5:], strict=True))
    assert lm.score_documents(odd_frame(spark, [])).count() == 0


def test_scores_use_two_words_of_context(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "x b d", "a b c", "x b d", "x b c"] * 6)]
    got = {r.doc_id: r.score for r in lm.score_documents(odd_frame(spark, rows)).collect()}
    want = lm_scores(rows, 3, lm.MASS)
    assert all(abs(got[i] - s[-1]) < 1e-6 for (i, _), s in zip(rows, want, strict=True))


def test_hashes_pack_and_unpack():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm.unpack(lm.pack(keys)) == keys).all() and len(lm.unpack(lm.pack(keys[:0]))) == 0
    for counts in ([], [0, 1, 254, 255, 256, 0, 1 << 40], [1] * 1000):
        assert lm.unpack_counts(lm.pack_counts(np.array(counts, np.int64))).tolist() == counts


def test_language_model_finds_ngrams_without_searching_all():
    texts = pa.array(["a b a b c", None, "", "c a b a b", "x " * 40])
    block = lm.read_block(texts, np.array([True, True, False, True, False]), 3)
    for k in range(3):
        found = lm.places(block, k)
        assert (found.keys == lm.distinct_grams(block, k)[0]).all()
        here = found.at >= 0
        assert (here == (block.real & (block.grams[k] != 0))).all()
        assert (found.keys[found.at[here]] == block.grams[k][here]).all()
        assert (block.grams[k][found.sample] == found.keys).all()
    counts = [lm.distinct_grams(block, k)[1] for k in range(3)]
    automaton = lm.build(block, [lm.places(block, k) for k in range(3)], counts, 9, 4, 300.0)
    asked = np.concatenate([automaton.arcs, np.arange(0, 1 << 63, 1 << 55, np.uint64), [np.uint64(2**64 - 1)]])
    at, known = automaton.find(asked)
    assert (known == np.isin(asked, automaton.arcs)).all() and known.any() and not known.all()
    assert (at[known] == np.searchsorted(automaton.arcs, asked[known])).all()


def test_distinct_words_of_a_slice():
    words = pa.array(["é", "", "bb", "c"], pa.large_binary())
    assert _values(words) == words.to_pylist() and _values(words[1:3]) == words[1:3].to_pylist()
    assert _values(words[:0]) == [] and _values(words[1:2]) == [b""]


ITEMS = [
    (1, " ".join(f"alpha{i}" for i in range(30))),
    (2, "Short item of Six words"),
    (3, "one"),
    (4, None),
    (5, "..."),
    (6, "a b a b a b a b a b a b a b a b"),
    (2, "another text with the same id as one before it here now"),
    (None, "an item without any id at all but with very many words in it to match"),
]


def test_winnowing_equals_a_plain_search(spark):
    rng = random.Random(7)
    pool = [w for _, t in ITEMS if t for w in t.split()] + ["x", "y", "é", "ÀB"]
    rows = [*ODD, (30, "ALPHA0," + ITEMS[0][1][6:]), (31, "a b " * 40)]
    for i in range(60):
        words = []
        while len(words) < 120:
            item = rng.choice([t for _, t in ITEMS if t]).split()
            a = rng.randrange(len(item))
            words += item[a : a + rng.randrange(1, 26)] + rng.choices(pool, k=rng.randrange(4))
        rows.append((100 + i, " ".join(words)))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(odd_frame(spark, rows), bench)
    assert "shard" in got.columns
    want = {(i, t or ""): contamination(t, ITEMS) for i, t in rows}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        n, hit, items = want[(r.doc_id, r.text or "")]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, items, hit > 0 and 20 * hit >= n)
    clean = decontaminate.contamination(odd_frame(spark), bench.limit(0))
    assert clean.filter("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(ODD)
    assert decontaminate.contamination(odd_frame(spark, []), bench).count() == 0


def test_winnowing_equals_its_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    got = QUERIES["op6_winnowing"](spark, small)
    want = con.execute(ORACLE["op6_winnowing"])
    columns = [c[0] for c in want.description]
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def near_copies(seed, n_bases=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(n_bases):
        base = rng.choices(vocabulary, k=rng.choice((3, 8, 20, 60, 200, 900)))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows, 50))


def test_jaccard_components_equal_a_plain_join(spark):
    for num, den, size in ((90, 100, 3), (80, 100, 5)):
        rows = [r for r in ODD if r[0] is not None] + near_copies(num)
        first = components([t for _, t in rows], num, den, size)
        smallest = {}
        for (i, _), c in zip(rows, first, strict=True):
            smallest[c] = min(i, smallest.get(c, i))
        want = sorted((i, len(shingles(t, size)), smallest[c]) for (i, t), c in zip(rows, first, strict=True))
        found = jaccard_join.near_duplicates(odd_frame(spark, rows), num, den, size, group=16)
        assert sorted(tuple(r)[:3] for r in found.collect()) == want
        kept = jaccard_join.one_of_each(odd_frame(spark, rows), num, den, size)
        empty = {i for i, t in rows if not shingles(t, size)}
        assert sorted(r.doc_id for r in kept.collect()) == sorted({s for i, _, s in want} | empty)
        assert kept.columns == odd_frame(spark, rows).columns


def test_linked_sets_share_the_tokens_they_need():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        for n in [*range(1, 60), *rng.integers(60, 1500, 60).tolist()]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for gone in {0, len(a) * (den - num) // den, int(rng.integers(0, len(a) // 8 + 1))}:
                rest = len(a) - gone
                # As many new shingles as the threshold allows.
                new = max(0, rest * den // num - len(a))
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
                shared = np.intersect1d(a, b).size
                if den * shared < num * (len(a) + len(b) - shared):
                    continue
                common = np.intersect1d(jaccard_join.tokens_of(a, num, den), jaccard_join.tokens_of(b, num, den)).size
                assert common >= max(jaccard_join.tokens_needed(len(x), num, den) for x in (a, b))


def test_a_family_gives_fewer_pairs_than_it_has_members():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i:], rng.integers(0, 1 << 63, i).astype(np.uint64)])) for i in range(40)]
    rows = [{"cls": i, "comp": i // 2, "n": len(s), "sketch": jaccard_join.sketch_of(s, 80, 100)} for i, s in enumerate(sets)]
    found = {}
    for nearest in (True, False):
        batch = pa.RecordBatch.from_pylist([{"left": rows, "right": rows}, {"left": rows[:3], "right": rows[:1]}])
        out = list(jaccard_join._open_groups(80, 100, nearest)([batch]))
        found[nearest] = [tuple(x.values()) for b in out for x in b.to_pylist()]
    assert len(found[False]) > 500 and set(found[True]) <= set(found[False])
    # The closest pairs connect the twenty components, and no pair is one too many.
    assert len(found[True]) == 19
    reached = {0}
    for _ in found[True]:
        reached |= {c for a, b in found[True] if {a // 2, b // 2} & reached for c in (a // 2, b // 2)}
    assert reached == set(range(20))


def test_jaccard_families_beyond_a_group_equal_a_plain_join(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(3):
        text = [f"w{rng.randrange(300)}" for _ in range(120)]
        for _ in range(14):
            rows.append(" ".join(text))
            # A chain: neighbours link, members further apart mostly do not.
            for _ in range(2):
                text[rng.randrange(len(text))] = f"w{rng.randrange(300)}"
    rng.shuffle(rows)
    first = components(rows, 80, 100, 5)
    assert 3 <= len(set(first)) < len(rows)
    found = jaccard_join.near_duplicates(odd_frame(spark, list(enumerate(rows))), 80, 100, 5, group=4)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == list(enumerate(first))


def test_jaccard_without_documents_and_without_ids(spark):
    assert jaccard_join.near_duplicates(odd_frame(spark, [])).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "q r s")]
    found = jaccard_join.near_duplicates(odd_frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 7), (0, 7), (7, 7)]
    assert jaccard_join.one_of_each(odd_frame(spark, rows)).count() == 2


def test_shards_are_balanced_and_positions_gapless(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    rows = sharding.shard_documents(docs).collect()
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= max(r["size"] for r in rows) and sum(load) == sum(len((r.text or "").encode()) + 1 for r in rows)
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    again = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def test_sharding_odd_rows(spark):
    rows = sharding.shard_documents(odd_frame(spark)).collect()
    assert len(rows) == len(ODD) and all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    assert {r.score for r in rows} == {"own"}
    assert sharding.shard_documents(odd_frame(spark, [])).count() == 0


def test_rebalancing_edits_the_map():
    rng = random.Random(1)
    stats = {s: (rng.randrange(1, 1000), 1) for s in range(512)}
    first = sharding.initial_map(stats, 8, 512)
    assert set(first) == set(range(512))
    grown = sharding.rebalance(first, stats, 9, slack=0.05)
    moved = [s for s in first if first[s] != grown[s]]
    assert all(grown[s] == 8 for s in moved) and len(moved) < 512 / 9 * 1.5
    for n, placed in ((9, grown), (8, sharding.rebalance(grown, stats, 8)), (8, sharding.rebalance(first, stats, 8))):
        load = [sum(stats[s][0] for s in placed if placed[s] == k) for k in range(n)]
        assert max(load) - min(load) < 0.06 * sum(load) / n
    assert sharding.rebalance(first, stats, 8) == first
