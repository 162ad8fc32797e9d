"""Alignment of two tokenizers over the same text, and how often their tokens are linked.

A text, a space before it, is cut by a byte-level BPE (A) and by a sentencepiece BPE with byte fallback (B). Both
cut the same bytes, so a byte offset at which tokens of both end closes a group; the tokens of a group are linked.

Groups are found by diagonal run skipping. ``ends_a`` and ``ends_b`` are the offsets at which tokens end; while the
tokenizers agree, equal offsets lie on one diagonal, i.e. ends_a[i] == ends_b[i + shift]. Stretches of growing,
doubled length are compared at once along the diagonal and jumped over while they are equal; a comparison that fails
is halved until the first difference is found. The irregular group there is resolved by stepping whichever side is
behind until both meet, which gives the shift for the next stretch.

Encoding: neither tokenizer joins a character that is no white space to a space or a newline after it (checked for
B's vocabulary when it is loaded), so texts are cut there and each distinct stretch is encoded once and remembered,
up to a bound on what is remembered.

Defined cases: null and empty texts, and texts whose joined token bytes differ from the space and the text under
either tokenizer (those with U+2581, for example), have no tokens, zeros and ''. Strings of special tokens are plain
text. Repeated rows and ids count as documents of their own. An empty table gives an empty table; further columns do
not matter. Very long texts are aligned whole; links of a long irregular group are counted from its distinct ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlgauge.llm.common import materialize, per_batch
from crawlgauge.plans.skew import salted_join

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
# Stretches of text a task remembers, by number and by bytes; results do not depend on them.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
# Linked id pairs that are broadcast, some 30 bytes each; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
# New stretches encoded side by side.
_TOGETHER = 256
# Links expanded at a time; a group with more goes by its distinct ids.
_EXPANDED = 1 << 21

# --- encoding ---------------------------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Side:
    """Ids and byte lengths of remembered stretches under one tokenizer, in flat arrays."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.width = np.array(list(map(len, token_bytes)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def learn(self, chunks: list[list[str]]) -> np.ndarray:
        """Encode the stretches of chunks that may stand side by side, and keep them; tells which ones their
        tokens spell. In a chunk that is spelled as a whole, stretches end where its tokens reach their ends."""
        ids, sizes, sound = [self.ids], [], []
        for chunk, coded in zip(chunks, self.encode(["".join(c) for c in chunks]), strict=True):
            raw = [s.encode() for s in chunk]
            if self._spell(coded) == b"".join(raw):
                flat = np.array(coded, np.int32)
                ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(list(map(len, raw)))) + 1
                sizes.append(np.diff(ends, prepend=0))
                sound.append(np.ones(len(chunk), bool))
            else:
                alone = self.encode(chunk)
                flat = np.array([i for own in alone for i in own], np.int32)
                sizes.append(np.array(list(map(len, alone)), np.int64))
                sound.append(np.array([self._spell(own) == r for own, r in zip(alone, raw, strict=True)]))
            ids.append(flat)
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        return np.concatenate(sound)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches one after the other, and how many each has."""
        sizes = np.diff(self.ends)[slots]
        total = np.cumsum(sizes)
        at = np.repeat(self.ends[:-1][slots] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return self.ids[at], sizes


def _side_a(path: str) -> Side:
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    level = _byte_level()
    names = [tool.id_to_token(i) or "" for i in range(tool.get_vocab_size(with_added_tokens=True))]
    spelled = [bytes(level[c] for c in n) if all(c in level for c in n) else n.encode() for n in names]

    def encode(stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in tool.encode_batch_fast(stretches, add_special_tokens=False)]

    return Side(encode, spelled)


def _side_b(path: str) -> Side:
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [tool.id_to_piece(i) for i in range(tool.get_piece_size())]
    if any(re.search("[^▁]▁|.\n|\n.", n) for n in names):
        raise ValueError("a piece runs over a space or a newline: texts cannot be cut there")
    byte = re.compile("<0x([0-9A-F]{2})>")
    spelled = [bytes([int(byte.fullmatch(n)[1], 16)]) if tool.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    space = names.index("▁")

    def encode(stretches: list[str]) -> list[list[int]]:
        # The library puts a space before what it is given: here the one the stretch starts with, or one more,
        # which is a token of its own before a newline.
        coded = tool.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        return [(ids or [space]) if s[0] == " " else ids[1:] for ids, s in zip(coded, stretches, strict=True)]

    return Side(encode, spelled)


class Encoders:
    """Both tokenizers over the stretches of texts."""

    def __init__(self, a_path: str = A_FILE, b_path: str = B_FILE):
        self.a, self.b = _side_a(a_path), _side_b(b_path)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.sound = np.empty(0, bool)
        self.bytes = 0
        self.a.forget()
        self.b.forget()

    def _slots(self, stretches: list[str]) -> list[int]:
        new = [s for s in stretches if s not in self.slot]
        if new and (len(self.slot) + len(new) > REMEMBERED or self.bytes > REMEMBERED_BYTES):
            self.forget()
            new = stretches
        if new:
            new = list(dict.fromkeys(new))
            chunks: list[list[str]] = [[]]
            for stretch in new:
                chunks[-1].append(stretch)
                # After white space a text may not be cut.
                if len(chunks[-1]) == _TOGETHER or stretch[-1].isspace():
                    chunks.append([])
            chunks = [c for c in chunks if c]
            sound = self.a.learn(chunks) & self.b.learn(chunks)
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            self.sound = np.concatenate([self.sound, sound])
            self.bytes += sum(map(len, new))
        return [self.slot[s] for s in stretches]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B for all texts together, and how many of each belong to each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # A space before every newline makes single spaces the only separators; pieces that start with a newline
        # then lose that space again.
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        stretches = [n if n[:1] == "\n" else " " + n for n in names]
        # A stretch must end in something else than white space.
        goes_on = np.array([n == "" or n[-1].isspace() for n in names], bool)[codes]
        goes_on[offsets[1:] - 1] = False
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        head = np.concatenate([[True], ~goes_on[:-1]]) if len(codes) else goes_on
        heads = np.flatnonzero(head)
        units = codes[heads].astype(np.int64)
        ends = np.append(heads[1:], len(codes))
        known = dict(zip(stretches, range(len(stretches)), strict=True))
        for u in np.flatnonzero(ends - heads > 1).tolist():
            whole = "".join(stretches[c] for c in codes[heads[u] : ends[u]].tolist())
            units[u] = known.setdefault(whole, len(known))
        # Only what is a unit by itself is encoded.
        used, units = np.unique(units, return_inverse=True)
        every = list(known)
        slots = np.array(self._slots([every[i] for i in used.tolist()]), np.int64)[units]
        owner = text_of[heads]
        sound = pc.not_equal(texts, "").to_numpy(zero_copy_only=False).copy()
        sound[owner[~self.sound[slots]]] = False
        keep = sound[owner]
        slots, owner = slots[keep], owner[keep]
        (ids_a, n_a), (ids_b, n_b) = self.a.gather(slots), self.b.gather(slots)
        per_text = [np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64) for n in (n_a, n_b)]
        return ids_a, ids_b, *per_text


@lru_cache(maxsize=1)
def encoders(a_path: str = A_FILE, b_path: str = B_FILE) -> Encoders:
    """One pair of tokenizers per process."""
    return Encoders(a_path, b_path)


# --- alignment --------------------------------------------------------------------------------


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: numbers of tokens of A and of B up to each offset at which tokens of both end.

    Both lists rise and end with the same offset.
    """
    # Stretches of the diagonal: where they end in A and in B, and how many cuts they have.
    stop_a: list[int] = []
    stop_b: list[int] = []
    cuts: list[int] = []
    i = j = 0
    n_a = len(ends_a)
    while i < n_a:
        # An irregular group: step the side that is behind until both meet; the shift is then j - i.
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        start = i
        i, j, step = i + 1, j + 1, 1
        # Along the diagonal: one token each as long as the ends are equal.
        while i + step <= n_a and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        # The difference is within this step: halve it until nothing is left to jump.
        while step > 1:
            step >>= 1
            if i + step <= n_a and ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
        stop_a.append(i)
        stop_b.append(j)
        cuts.append(i - start)
    n = np.array(cuts, np.int64)
    total = np.cumsum(n)
    back = np.repeat(total, n) - 1 - np.arange(total[-1] if len(n) else 0)
    return np.repeat(np.array(stop_a, np.int64), n) - back, np.repeat(np.array(stop_b, np.int64), n) - back


def linked_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, owner: np.ndarray, base: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) of the links of all groups and how many links each stands for; a pair is a * base + b."""
    size_a, size_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    links = size_a * size_b
    top = base * (int(ids_a.max(initial=0)) + 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(owners: np.ndarray, pairs: np.ndarray, times: np.ndarray | None = None) -> None:
        # One number for both: pairs are below top.
        keys = owners * top + pairs
        if times is None:
            keys.sort()
        else:
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        if len(new):
            n = np.diff(new, append=len(keys)) if times is None else np.add.reduceat(times, new)
            found.append((keys[new] // top, keys[new] % top, n))

    small = links <= _EXPANDED
    numbers = np.flatnonzero(small)
    # Consecutive small groups together, as many as may be expanded at once.
    chunk = np.cumsum(links[numbers]) // _EXPANDED
    for g in np.split(numbers, np.flatnonzero(np.diff(chunk)) + 1) if len(numbers) else []:
        n = links[g]
        total = np.cumsum(n)
        inner = np.arange(total[-1]) - np.repeat(total - n, n)
        of = np.repeat(np.arange(len(g)), n)
        wide = size_b[g][of]
        a = ids_a[(cuts_a - size_a)[g][of] + inner // wide].astype(np.int64)
        b = ids_b[(cuts_b - size_b)[g][of] + inner % wide]
        add(owner[g][of], a * base + b)
    for g in np.flatnonzero(~small).tolist():
        a, times_a = np.unique(ids_a[cuts_a[g] - size_a[g] : cuts_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[cuts_b[g] - size_b[g] : cuts_b[g]], return_counts=True)
        rows = max(1, _EXPANDED // len(b))
        for k in range(0, len(a), rows):
            pairs = (a[k : k + rows, None].astype(np.int64) * base + b).ravel()
            add(np.full(len(pairs), owner[g]), pairs, np.outer(times_a[k : k + rows], times_b).ravel())
    if len(found) > 1:
        add(*map(np.concatenate, zip(*found, strict=True)))
        found = found[-1:]
    return found[0] if found else (np.empty(0, np.int64),) * 3


@lru_cache(maxsize=4)
def _all_names(size: int) -> pa.Array:
    """Every id with each sign that may follow it: a comma, a bar, a semicolon, nothing."""
    return pa.array([f"{i}{sign}" for i in range(size) for sign in (",", "|", ";", "")], pa.string())


def _names(size: int) -> pa.Array:
    return _all_names(1 << (size - 1).bit_length())


def _spelled(ids_a, ids_b, cuts_a, cuts_b, ends: np.ndarray) -> pa.Array:
    """Groups of each text as `a1,a2|b1;a3|b2,b3`; text i has the groups up to ends[i]."""
    # The place of every id in the line: the ids of A of a group, then those of B.
    before_b, before_a = np.concatenate([[0], cuts_b[:-1]]), np.concatenate([[0], cuts_a[:-1]])
    group_a = np.repeat(np.arange(len(cuts_a)), cuts_a - before_a)
    group_b = np.repeat(np.arange(len(cuts_b)), cuts_b - before_b)
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + cuts_a[group_b]
    names, signs = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
    names[place_a], names[place_b] = ids_a, ids_b
    total = cuts_a + cuts_b
    signs[cuts_a + before_b - 1] = 1
    signs[total - 1] = 2
    # No sign after the last group of a text.
    stops = np.concatenate([[0], total])[ends]
    signs[stops[stops > 0] - 1] = 3
    listed_ids = _names(int(names.max(initial=0)) + 1).take(pa.array(names * 4 + signs))
    listed = pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), listed_ids)
    return pc.binary_join(listed, "")


def _align(a_path: str, b_path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = encoders(a_path, b_path)
        ids_a, ids_b, n_a, n_b = tool.batch(batch.column("text"))
        ends_a, ends_b = np.cumsum(tool.a.width[ids_a]), np.cumsum(tool.b.width[ids_b])
        cuts_a, cuts_b = common_ends(ends_a.tolist(), ends_b.tolist())
        # A text ends with a group.
        ends = np.searchsorted(cuts_a, np.cumsum(n_a), side="right")
        owner = np.repeat(np.arange(len(n_a)), np.diff(ends, prepend=0))
        size = np.diff(cuts_a, prepend=0) * np.diff(cuts_b, prepend=0)
        owners, pairs, times = linked_pairs(ids_a, ids_b, cuts_a, cuts_b, owner, len(tool.b.width))
        offsets = pa.array(np.searchsorted(owners, np.arange(len(n_a) + 1)).astype(np.int32))
        n_links = np.diff(np.concatenate([[0], np.cumsum(size)])[ends], prepend=0)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *map(pa.array, (n_a, n_b, np.diff(ends, prepend=0), n_links)),
                _spelled(ids_a, ids_b, cuts_a, cuts_b, ends),
                pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                pa.ListArray.from_arrays(offsets, pa.array(times)),
            ],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
        )

    return run


def align_documents(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """Each text aligned: numbers of tokens, groups and links, the groups as `a1,a2|b1;a3|b2,b3`, and the distinct
    linked id pairs (``a * size of B's vocabulary + b``) with how many links each stands for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        per_batch(_align(a_path, b_path)),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>",
    )


# --- counts of links --------------------------------------------------------------------------


def pair_counts(aligned: DataFrame, b_path: str = B_FILE) -> DataFrame:
    """For every linked id pair: how many documents hold it, and whether no pair of its A id is held by more."""
    base = encoders(b_path=b_path).b.width.size
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts, "pair-counts")
    a = F.expr(f"pair div {base}")
    highest = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_top"))
    joined = counts.withColumn("_a", a).join(highest, "_a")
    return joined.select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def with_link_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS, b_path: str = B_FILE) -> DataFrame:
    """Add n_best and count_sum over the links of each document. ``aligned`` is read twice: store it, with a
    distinct number per row in the column ``row``."""
    counts = materialize(pair_counts(aligned, b_path), "pairs")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l")["pairs"].alias("pair"), F.col("l")["times"].alias("times"))
    if counts.count() <= broadcast_pairs:
        judged = links.join(F.broadcast(counts), "pair")
    else:
        # A pair that very many documents hold is split over many tasks.
        judged = salted_join(links, counts, "pair", "inner")
    sums = judged.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    out = aligned.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return out.fillna(0, ["n_best", "count_sum"])
