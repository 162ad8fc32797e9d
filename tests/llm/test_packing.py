import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plain import odd_frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlgauge.llm import packing
from crawlgauge.llm.common import table


def least_bins(sizes, capacity):
    """The least number of bins by trying all assignments."""
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for w, s in zip(where, sizes):
                fill[w] += s
            if max(fill) <= capacity:
                return n
    return 0


def test_swaps_reach_the_least_number_of_bins():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 10, 16])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 6))]
        bin_, offset, fill = packing.pack(np.array(sizes), capacity)
        assert len(set(bin_)) == least_bins(sizes, capacity)
        for b in set(bin_):
            spans = sorted((o, o + s) for o, s, x in zip(offset, sizes, bin_) if x == b)
            assert spans[0][0] == 0 and all(a[1] == c[0] for a, c in zip(spans, spans[1:])) and spans[-1][1] <= capacity
            assert {f for f, x in zip(fill, bin_) if x == b} == {spans[-1][1]}


@pytest.mark.parametrize(
    "poor, rich, after",
    [
        ([4], [6], ([], [4, 6])),
        ([6], [4, 4], ([4], [4, 6])),
        ([3, 3], [4, 4], ([4], [3, 3, 4])),
        ([7], [3, 2, 3], ([2, 3], [3, 7])),
        ([2, 2], [9], None),
    ],
)
def test_exchanges(poor, rich, after):
    """A move, one for one, two for one, one for two, and nothing that helps."""
    lengths = np.array(poor + rich)
    a = packing._Bin(list(range(len(poor))), lengths)
    b = packing._Bin(list(range(len(poor), len(lengths))), lengths)
    assert packing._exchange(a, b, 10) == (after is not None)
    left = [sorted(lengths[i] for items in x.by_length.values() for i in items) for x in (a, b)]
    assert left == list(after or (poor, rich))


def test_swaps_improve_on_best_fit():
    sizes = np.random.default_rng(3).integers(1300, 2100, 400)
    first = packing.best_fit(sizes, 4096)
    better = packing.swap_search(first, sizes, 4096)
    assert len(better) < len(first)
    assert all(sizes[b].sum() <= 4096 for b in better) and sorted(i for b in better for i in b) == list(range(400))


def check_whole(rows, placed, capacity):
    """Every document in pieces, every sequence gapless and within the capacity."""
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), capacity):
            own = ids[p : p + capacity]
            want.append((doc_id, p // capacity, p, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    used = {}
    for r in placed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length, r.fill))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert {s[2] for s in spans} == {spans[-1][1]} and spans[-1][1] <= capacity
    return len(used), sum(r.length for r in placed)


def test_odd_rows_are_packed_whole(spark):
    docs = odd_frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for capacity, group in ((16, 3), (4096, 40_000)):
        placed = packing.pack_documents(docs, capacity=capacity, group_pieces=group).collect()
        n, total = check_whole(rows, placed, capacity)
        assert n <= -(-total // capacity) + 2
    assert packing.pack_documents(odd_frame(spark, [])).count() == 0


def test_given_documents_fill_the_least_sequences(spark, small):
    docs = table(spark, small, "documents")
    placed = packing.pack_documents(docs).collect()
    n, total = check_whole([(r.doc_id, r.text) for r in docs.collect()], placed, 4096)
    assert n == -(-total // 4096)


def test_sequences_hold_the_ids_of_their_pieces(spark, small):
    docs = table(spark, small, "documents").limit(40)
    placed = packing.pack_documents(docs, keep_ids=True).cache()
    checksums = {(r.sequence_id, r.offset): (r.length, bytes(r.ids)) for r in placed.collect()}
    for r in packing.sequences(placed).collect():
        assert r.n_tokens <= 4096 and len(r.ids) == 4 * r.n_tokens
        own = {o: v for (s, o), v in checksums.items() if s == r.sequence_id}
        assert len(own) == len(r.doc_ids)
        assert all(bytes(r.ids)[4 * o : 4 * (o + n)] == raw for o, (n, raw) in own.items())
    assert placed.agg(F.countDistinct("sequence_id")).first()[0] == packing.sequences(placed).count()
