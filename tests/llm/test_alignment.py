import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from plain import odd_frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlgauge.llm import alignment, queries
from crawlgauge.llm.common import materialize, table


@lru_cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache
def byte_of():
    """Byte of each character of a byte-level vocabulary, read off single-byte tokens: A encodes all bytes apart."""
    from tokenizers.pre_tokenizers import ByteLevel

    known = {}
    for b in range(0x110000):
        if b < 0x80 or b in range(0x80, 0x800):
            text = chr(b)
            for char, raw in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0], text.encode()):
                known[char] = raw
    # Bytes of longer characters.
    for b in range(0x800, 0x110000, 0x3F):
        if not 0xD800 <= b < 0xE000:
            text = chr(b)
            for char, raw in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0], text.encode()):
                known[char] = raw
    return known


def plain_groups(text):
    """Groups as lists of id lists, by walking over all offsets; None if there are no tokens."""
    if not text:
        return None
    a, b = libraries()
    whole = " " + text
    ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte_of()[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        raw_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(raw_a) != whole.encode() or b"".join(raw_b) != whole.encode():
        return None
    ends_a, ends_b = (np.cumsum([len(r) for r in raw]).tolist() for raw in (raw_a, raw_b))
    both = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for end in both:
        own = ([], [])
        while i < len(ids_a) and ends_a[i] <= end:
            own[0].append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= end:
            own[1].append(ids_b[j])
            j += 1
        groups.append(own)
    return groups


def plain_rows(rows):
    aligned = [(doc_id, plain_groups(text)) for doc_id, text in rows]
    held = Counter()
    for _, groups in aligned:
        held.update({(a, b) for g in groups or [] for a in g[0] for b in g[1]})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for doc_id, groups in aligned:
        if groups is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(line.encode()).hexdigest(),
        )


def test_query_equals_a_plain_alignment(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = [tuple(r) for r in queries.op11_diagonal_runs(spark, small).collect()]
    assert sorted(got) == sorted(plain_rows(rows)) and any(r[3] != r[1] for r in got)


def test_odd_rows_and_both_joins(spark):
    docs = odd_frame(spark)
    extra = [(20, "a▁b"), (21, "<s> <unk> <|endoftext|> <0x0A>"), (22, "x" * 3000 + " " * 70 + "\n\n\n"), (23, "日本語テキスト 🙂🙂\t;\r\n\r\n")]
    docs = docs.unionByName(odd_frame(spark, extra))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    aligned = alignment.align_documents(docs)
    stored = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned-test")
    want = sorted(map(repr, plain_rows(rows)))
    for limit in (alignment.BROADCAST_PAIRS, 0):
        out = alignment.with_link_counts(stored, broadcast_pairs=limit)
        line = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", line.alias("sha"))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert sum(r.n_a == 0 for r in aligned.filter("doc_id >= 20").collect()) == 1
    assert alignment.align_documents(odd_frame(spark, [])).count() == 0


def test_stretches_are_encoded_as_in_the_text():
    rng = random.Random(1)
    bits = ["don't", " ", "  ", "\n", "\n\n", "\t", "x1", "é", "!?", "'s", "\x1c", "word", "日本", "\r\n", ";\r", "\x00", "　", "🙂", "</s>", "▁▁", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    ids_a, ids_b, n_a, n_b = alignment.encoders().batch(pa.array(texts, pa.string()))
    got_a, got_b = np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1])
    for text, a, b in zip(texts, got_a, got_b):
        groups = plain_groups(text)
        assert a.tolist() == [i for g in groups or [] for i in g[0]]
        assert b.tolist() == [i for g in groups or [] for i in g[1]]
    assert 50 < sum(plain_groups(t) is not None for t in texts) < 400


def test_forgetting_changes_nothing(monkeypatch):
    tool = alignment.Encoders()
    texts = pa.array([f"word{i % 7} other{i}\nline {i}" for i in range(50)])
    want = [a.tolist() for a in tool.batch(texts)]
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    assert [a.tolist() for a in tool.batch(texts)] == want
    assert [a.tolist() for a in tool.batch(texts)] == want


def test_common_ends_on_random_cuts():
    rng = random.Random(2)
    for share in (0.02, 0.3, 0.7, 0.98):
        for n in (1, 2, 5, 400):
            a = sorted({n, *(i for i in range(1, n) if rng.random() < share)})
            b = sorted({n, *(i if rng.random() < 0.8 else max(1, i - 1) for i in a[:-1])})
            both = sorted(set(a) & set(b))
            cuts = alignment.common_ends(a, b)
            assert [c.tolist() for c in cuts] == [[a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both]]
    assert [len(c) for c in alignment.common_ends([], [])] == [0, 0]


def test_long_groups_are_counted_from_distinct_ids(monkeypatch):
    rng = np.random.default_rng(4)
    ids_a, ids_b = rng.integers(0, 9, 300).astype(np.int32), rng.integers(0, 5, 260).astype(np.int32)
    cuts_a, cuts_b, owner = np.array([2, 250, 251, 300]), np.array([1, 200, 203, 260]), np.array([0, 0, 0, 2])
    want = Counter()
    for o, a0, a1, b0, b1 in zip(owner, [0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b):
        want.update((int(o), int(a) * 10 + int(b)) for a in ids_a[a0:a1] for b in ids_b[b0:b1])
    for limit in (1 << 21, 3000, 7):
        monkeypatch.setattr(alignment, "_EXPANDED", limit)
        owners, pairs, times = alignment.linked_pairs(ids_a, ids_b, cuts_a, cuts_b, owner, 10)
        assert list(zip(zip(owners.tolist(), pairs.tolist()), times.tolist())) == sorted(want.items())
