"""Plain statements of what the operators compute, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    (0, "The quick brown fox jumps over the lazy dog. " * 9),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "The quick brown fox jumps over the lazy dog. " * 9),
    (4, "The quick brown fox jumps over the lazy dog. " * 9),
    (5, "ÉTÉ été   x\x1cy naïve Straße 日本語 " * 3),
    (6, "one"),
    (7, "one two"),
    (8, "x" * 70_000),
    (9, " " * 9_000 + "end" + "\n" * 9_000),
    (10, ("lorem ipsum dolor " * 4 + "\n") * 3_000),
    (None, "a row without an id"),
]
# Names that operators use for columns of their own.
CLASHING = ("n_words", "score", "kept", "shard", "slot", "size", "items", "_k1", "cls", "component", "held_out", "block")


def odd_frame(spark, rows=ODD):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *["own"] * len(CLASHING)) for i, t in rows], schema)


def words(text, pattern=rb"[^\x20\x09-\x0D]+", lower=True):
    raw = (text or "").translate(ASCII_LOWER if lower else {}).encode()
    return re.findall(pattern, raw)


def lm_scores(rows, order, mass):
    """(n_tokens, n_known, N, base, score) per row."""
    counts = [Counter() for _ in range(order)]
    texts = [[b"<s>", *words(t), b"</s>"] for _, t in rows]
    for (i, _), w in zip(rows, texts):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            for p in range(1, len(w)):
                for k in range(min(order, p + 1)):
                    counts[k][tuple(w[p - k : p + 1])] += 1
    n, v, starts = sum(counts[0].values()), len(counts[0]), counts[0][(b"</s>",)]

    def p_of(context, word):
        if not context:
            return (counts[0][(word,)] + 0.5) / (n + 0.5 * (v + 1))
        total = starts if context == (b"<s>",) else counts[len(context) - 1][context]
        return (counts[len(context)][(*context, word)] + mass * p_of(context[1:], word)) / (total + mass)

    return [
        (
            len(w) - 1,
            sum(counts[0][(x,)] > 0 for x in w[1:]),
            n,
            sum(math.log10(p_of((), x)) for x in w[1:]),
            sum(math.log10(p_of(tuple(w[max(0, p - order + 1) : p]), w[p])) for p in range(1, len(w))),
        )
        for w in texts
    ]


def text_counts(text):
    w = words(text, lower=False)
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return {
        "n_words": len(w),
        "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
    }


def contamination(text, items):
    """(n_words, n_hit, items) with items as (id, text)."""
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = words(text, pattern), set(), set()
    for item_id, item in items:
        v = words(item, pattern)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found)


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts, num, den, size):
    """Index of the first member of the component of every text."""
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    postings = defaultdict(list)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in postings[s]}:
            if den * len(own & sets[j]) >= num * len(own | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            postings[s].append(i)
    return [root(i) for i in range(len(sets))]
