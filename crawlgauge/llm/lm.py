"""Language-model scores from a weighted backoff automaton.

Model. Probabilities of n-grams up to ``order`` words are smoothed into those of the shorter n-grams:
P(w | context) = (c(context, w) + mass * P(w | shorter context)) / (c(context) + mass), and
P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). As an automaton, every counted context is a state; a counted
n-gram is an arc with its probability; without such an arc the failure arc leads to the state of the shorter
context at the price mass / (c(context) + mass). One traversal from left to right carries the state.

Distribution. Each scan task cuts its documents into blocks of bounded size, stored compressed, one row each. Each
block sends its distinct n-grams, hashed, sorted and cut into slices of the hash range, to the tasks of the slices;
these add up the counts of all blocks and send back, in the same order and without the hashes, what the other blocks
counted. A block thereby knows every count it can meet; its parts, one after the other, build the piece of the
automaton that their documents can reach. No task holds the whole model, and what is shuffled grows with the corpus.
The number of slices grows with the square root of that of the blocks, so the rows sent grow with its power of 1.5.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; each text ends with one end token. Defined cases: null and
empty texts are one end token; unknown words cost the root's default; repeated rows count as often as
they occur; a null id is learned from; an empty table gives no rows; with nothing to learn from, every
token has the same probability. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import materialize, word_codes

ORDER = 3
# Weight of the shorter context, in tokens.
MASS = 300.0
# Bytes of text in a block, and in each of its parts; a longer text is a part of its own.
BLOCK_BYTES, PART_BYTES = 16 << 20, 2 << 20
# Slices of the hash range for one block.
SLICES = 16
# Tokens of one lane of the traversal; results do not depend on it.
LANE = 512

_ROOT, _FACTOR = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)
_START, _END = np.uint64(1), np.uint64(2)


def held_out(doc_id: Column) -> Column:
    """Documents that are scored only: one in five, by the checksum of the id."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


# --- n-grams of a block -----------------------------------------------------------------------


def _extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context followed by a word."""
    x = (context ^ (context >> np.uint64(29))) * _FACTOR + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Block:
    """Token hashes of all texts, each led by a start token, and the n-grams that end at each token."""

    words: np.ndarray
    first: np.ndarray  # where each text's start token is; one more entry for the end
    grams: list[np.ndarray]  # grams[k]: hash of the k + 1 tokens up to here, 0 where there are not as many
    trained: np.ndarray  # whether each token counts

    @property
    def real(self) -> np.ndarray:
        """Tokens that are not start tokens."""
        mask = np.ones(len(self.words), bool)
        mask[self.first[:-1]] = False
        return mask


def read_block(texts: pa.Array, trained: np.ndarray, order: int) -> Block:
    codes, ends, words = word_codes(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) | 4 for w in words], np.uint64)
    n = len(ends) - 1
    lengths = np.diff(ends)
    first = np.concatenate([[0], np.cumsum(lengths + 2)]).astype(np.int64)
    flat = np.empty(first[-1], np.uint64)
    flat[first[:-1]] = _START
    flat[first[1:] - 1] = _END
    inner = np.ones(len(flat), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    flat[inner] = hashes[codes] if len(words) else np.empty(0, np.uint64)
    at = np.arange(len(flat)) - np.repeat(first[:-1], np.diff(first))  # place in the text
    grams = []
    for k in range(order):
        gram = np.full(len(flat), _ROOT)
        for back in range(k, -1, -1):
            gram = _extend(gram, np.concatenate([np.zeros(min(back, len(flat)), np.uint64), flat[: len(flat) - back]]))
        grams.append(np.where(at >= k, gram, np.uint64(0)))
    return Block(flat, first, grams, np.repeat(np.asarray(trained, bool), np.diff(first)) if n else np.empty(0, bool))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting: np.unique hashes, which takes many times as long on large arrays."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def distinct_grams(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of (k + 1)-grams that end at real tokens, and their training counts here."""
    mask = block.real & (block.grams[k] != 0)
    keys = _distinct(block.grams[k][mask])
    counts = np.zeros(len(keys), np.int32)
    trained, times = np.unique(block.grams[k][mask & block.trained], return_counts=True)
    counts[np.searchsorted(keys, trained)] = times
    return keys, counts


@dataclass(frozen=True)
class Places:
    """Distinct n-grams of one length that end at real tokens, and where they are."""

    keys: np.ndarray  # sorted hashes
    sample: np.ndarray  # a token at which each ends
    at: np.ndarray  # which of them ends at each token, -1 where none does


def places(block: Block, k: int) -> Places:
    """All (k + 1)-grams of a block from one sort, so that nothing has to be searched for its hash again."""
    mask = np.flatnonzero(block.real & (block.grams[k] != 0))
    grams = block.grams[k][mask]
    sort = np.argsort(grams)
    grams = grams[sort]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    at = np.full(len(block.words), -1)
    at[mask[sort]] = np.cumsum(new) - 1
    return Places(grams[new], mask[sort[new]], at)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of several parts, and the sums of their counts."""
    keys = _distinct(np.concatenate([k for k, _ in parts]))
    counts = np.zeros(len(keys), np.int32)
    for own, times in parts:
        counts[np.searchsorted(keys, own)] += times
    return keys, counts


def pack(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, in as many bytes each as the largest needs, byte by byte and compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(keys) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(keys).to_bytes(8, "little") + bytes([width]) + _ZSTD.compress(planes, asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), packed[8]
    planes = np.frombuffer(_ZSTD.decompress(packed[9:], n * width, asbytes=True), np.uint8).reshape(width, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full. Nearly all are 0 or 1, which compression uses."""
    large = counts[counts >= 255].astype("<i8")
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()
    return len(counts).to_bytes(8, "little") + len(large).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack_counts(packed: bytes) -> np.ndarray:
    n, large = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    raw = _ZSTD.decompress(packed[16:], n + 8 * large, asbytes=True)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", large, n)
    return counts


_ZSTD = pa.Codec("zstd")
_BLOCKS = "block long, parts array<binary>"
_COUNTS = "ord int, slice long, block long, keys binary, counts binary"
_TOTALS = "ord int, slice long, block long, others binary, n_distinct long, n_total long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
_TYPES["array<binary>"] = pa.list_(pa.binary())


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _stored(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def _part(stored: bytes, order: int) -> tuple[pa.Table, Block]:
    docs = pa.ipc.open_stream(stored).read_all().combine_chunks()
    text = docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string())
    return docs, read_block(text, ~docs["held_out"].to_numpy(), order)


def _cut_into_blocks(block_bytes: int, part_bytes: int):
    """(block, parts) of the documents of a scan task, in their order; a block's number holds that of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts, rows, held = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": [number], "parts": [parts]}, schema=_arrow(_BLOCKS))

        for batch in batches:
            if not batch.num_rows:
                continue
            # At most 2^31 tasks and as many blocks of each.
            number = number or int(batch.column("task")[0].as_py()) << 32
            docs = pa.Table.from_batches([batch.select(["doc_id", "held_out", "text"])])
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at, before = 0, 0
            while at < batch.num_rows:
                # One row at least, then as many as fit.
                end = max(at + 1, int(np.searchsorted(ends, before + part_bytes - held, side="right")))
                rows.append(docs.slice(at, end - at))
                held += int(ends[end - 1]) - before
                at, before = end, int(ends[end - 1])
                if at < batch.num_rows or held >= part_bytes:
                    parts.append(_stored(pa.concat_tables(rows)))
                    size, rows, held = size + held, [], 0
                    if size >= block_bytes:
                        yield block()
                        number, size, parts = number + 1, 0, []
        if rows:
            parts.append(_stored(pa.concat_tables(rows)))
        if parts:
            yield block()

    return run


def _grams_of_parts(parts: Iterable[bytes], order: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct n-grams and counts of every part, by order; one part's text is held at a time."""
    found: list[list] = [[] for _ in range(order)]
    for stored in parts:
        _, part = _part(stored, order)
        for k in range(order):
            found[k].append(distinct_grams(part, k))
    return found


def _counts_of_blocks(order: int, slice_bits: int):
    """(ord, slice, block, keys, counts) of every block: a row per slice that its n-grams fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, parts in zip(batch.column("block").to_pylist(), batch.column("parts"), strict=True):
                found = _grams_of_parts((p.as_py() for p in parts), order)
                for k in range(order):
                    yield _sliced(k, number, *merged(found[k]), slice_bits)
                    found[k] = []

    return run


def _sliced(k: int, number: int, keys: np.ndarray, counts: np.ndarray, slice_bits: int) -> pa.RecordBatch:
    rows: dict[str, list] = {"ord": [], "slice": [], "block": [], "keys": [], "counts": []}
    slices = (keys >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(keys), int)
    numbers, starts = np.unique(slices, return_index=True)
    for s, a, b in zip(numbers, starts, [*starts[1:], len(keys)], strict=True):
        rows["ord"].append(k)
        rows["slice"].append(int(s))
        rows["block"].append(number)
        # The slice number stands for the upper bits.
        rows["keys"].append(pack(keys[a:b] - (np.uint64(s) << np.uint64(64 - slice_bits) if slice_bits else 0)))
        rows["counts"].append(pack_counts(counts[a:b]))
    return pa.RecordBatch.from_pydict(rows, schema=_arrow(_COUNTS))


def _totals_of_slice(group: pa.Table) -> pa.Table:
    """What the other blocks counted, aligned with the keys of each block; how many keys of the slice were trained."""
    keys = [unpack(k) for k in group["keys"].to_pylist()]
    distinct = _distinct(np.concatenate(keys))
    places = [np.searchsorted(distinct, k).astype(np.int32) for k in keys]
    del keys
    counts = group["counts"].to_pylist()
    totals = np.zeros(len(distinct), np.int64)
    for at, own in zip(places, counts, strict=True):
        totals[at] += unpack_counts(own)
    n = len(places)
    return pa.table(
        {
            "ord": group["ord"],
            "slice": group["slice"],
            "block": group["block"],
            "others": [pack_counts(totals[at] - unpack_counts(own)) for at, own in zip(places, counts, strict=True)],
            # Once per slice.
            "n_distinct": [int((totals > 0).sum())] + [0] * (n - 1),
            "n_total": [int(totals.sum())] + [0] * (n - 1),
        },
        schema=_arrow(_TOTALS),
    )


# --- the automaton ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """Arcs by the hash of state and word, sorted. State 0 is the root; state i + 1 is that of arc i."""

    arcs: np.ndarray  # hash of each counted n-gram
    weight: np.ndarray  # log10 probability of its last word in its context
    target: np.ndarray  # state after it
    name: np.ndarray  # hash of each state
    fail: np.ndarray  # state of the shorter context
    price: np.ndarray  # log10 weight of the failure arc
    start: int
    unknown: float  # log10 probability of a word without any count
    first: np.ndarray  # by the upper bits of a hash: the first arc of these or higher bits

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the arcs, and whether it is one: hashes are spread evenly, so few steps lead there."""
        at = self.first[_upper_bits(key, len(self.first))]
        if not len(self.arcs):
            return at, np.zeros(len(key), bool)
        last = len(self.arcs) - 1
        behind = np.flatnonzero(self.arcs[np.minimum(at, last)] < key)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.arcs[at[behind]] < key[behind]]
        at = np.minimum(at, last)
        return at, self.arcs[at] == key

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 weights for one word in each lane."""
        total = np.zeros(len(state))
        target = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            at, found = self.find(_extend(self.name[state[open_]], word[open_]))
            hit = open_[found]
            total[hit] += self.weight[at[found]]
            target[hit] = self.target[at[found]]
            open_ = open_[~found]
            lost = open_[state[open_] == 0]
            total[lost] += self.unknown
            open_ = open_[state[open_] != 0]
            total[open_] += self.price[state[open_]]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return target, total


def _upper_bits(key: np.ndarray, size: int) -> np.ndarray:
    """As many upper bits as number the entries of a table, whose size is a power of two and at least 2."""
    return (key >> np.uint64(65 - size.bit_length())).astype(np.int64)


def build(block: Block, found: list[Places], totals: list[np.ndarray], n: int, v: int, mass: float) -> Automaton:
    """The automaton of the n-grams of a block; totals[k]: the counts of the (k + 1)-grams found."""
    order = len(totals)
    unknown = 0.5 / (n + 0.5 * (v + 1))
    end = _extend(np.array([_ROOT]), np.array([_END]))
    texts = totals[0][np.searchsorted(found[0].keys, end)][0] if len(totals[0]) else 0
    arcs, weight, suffix, counts = [], [], [], []
    start = _extend(np.array([_ROOT]), np.array([_START]))[0]
    # lower: the number of each shorter n-gram among all counted ones.
    lower, lower_p, size = np.empty(0, np.int64), np.empty(0), 0
    for k, (places_, total) in enumerate(zip(found, totals, strict=True)):
        known = total > 0
        sample, own, count = places_.sample[known], places_.keys[known], total[known].astype(float)
        if k == 0:
            p = (count + 0.5) * (unknown / 0.5)
            back = np.full(len(own), -1)
        else:
            before = block.grams[k - 1][sample - 1]
            held = totals[k - 1][found[k - 1].at[sample - 1]]
            context = np.where(before == start, texts, held).astype(float)
            back = lower[found[k - 1].at[sample]]
            p = (count + mass * lower_p[back - (size - len(lower_p))]) / (context + mass)
        arcs.append(own)
        weight.append(np.log10(p))
        suffix.append(back)
        counts.append(count)
        lower, lower_p = np.cumsum(known) - 1 + size, p
        size += len(own)
    inner = size - len(lower_p)  # those of fewer than ``order`` words
    arcs, weight, suffix, counts = map(np.concatenate, (arcs, weight, suffix, counts))
    sort = np.argsort(arcs)
    place = np.empty(size + 1, np.int64)
    place[sort] = np.arange(1, size + 1)
    place[-1] = 0
    arcs, weight, counts = arcs[sort], weight[sort], counts[sort]
    # States: the root, every n-gram of fewer than ``order`` words, and the start of a text. N-grams of
    # ``order`` words get a number too, but no arc leads to it.
    name = np.concatenate([[_ROOT], arcs, [start]])
    back = np.concatenate([[0], place[suffix[sort]], [0]])
    target = np.where(sort < inner, np.arange(1, size + 1), back[1:-1])
    with np.errstate(divide="ignore"):
        price = np.log10(mass / (np.concatenate([[0], counts, [texts]]) + mass))
    table = 1 << max(1, size.bit_length())
    ahead = np.cumsum(np.bincount(_upper_bits(arcs, table), minlength=table))
    first = np.concatenate([[0], ahead[:-1]])
    return Automaton(arcs, weight, target, name, back, price, size + 1, float(np.log10(unknown)), first)


def traverse(block: Block, automaton: Automaton, order: int, lane: int = LANE) -> np.ndarray:
    """log10 probability of every text.

    Texts are read in lanes of bounded length, all lanes in step. A lane inside a text starts order - 1
    tokens early at the root: by its first counted token it has the state a traversal of the text has.
    """
    score = np.zeros(len(block.first) - 1)
    lengths = np.diff(block.first) - 1  # real tokens
    pieces = -(-lengths // lane)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = number * lane
    warm = np.where(number > 0, np.minimum(begin, order - 1), 0)
    size = np.minimum(lane, lengths[owner] - begin) + warm
    sort = np.argsort(-size, kind="stable")
    owner, warm, size = owner[sort], warm[sort], size[sort]
    at = block.first[owner] + 1 + begin[sort] - warm
    state = np.where(number[sort] == 0, automaton.start, 0)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))
        state, weight = automaton.step(state[:live], block.words[at[:live] + t])
        counted = warm[:live] <= t
        np.add.at(score, owner[:live][counted], weight[counted])
    return score


def _score_block(order: int, n: int, v: int, mass: float):
    def run(stored: pa.Table, others: pa.Table) -> pa.Table:
        rows = sorted(zip(*(others[c].to_pylist() for c in ("ord", "slice", "others")), strict=True))
        parts = [p for row in stored["parts"].to_pylist() for p in row]
        if not parts:
            return _arrow(_SCORES).empty_table()
        found, known = _grams_of_parts(parts, order), []
        for k in range(order):
            keys, totals = merged(found[k])
            found[k] = []
            elsewhere = [unpack_counts(o) for own, _, o in rows if own == k]
            known.append((keys, totals + np.concatenate(elsewhere) if elsewhere else totals))
        return pa.concat_tables([_score_part(*_part(p, order), known, n, v, mass) for p in parts])

    return run


def _score_part(docs: pa.Table, part: Block, known: list[tuple[np.ndarray, np.ndarray]], n: int, v: int, mass: float):
    """Scores of the documents of a part, given the corpus-wide counts of the n-grams of its block."""
    found = [places(part, k) for k in range(len(known))]
    own = [totals[np.searchsorted(keys, f.keys)] for f, (keys, totals) in zip(found, known, strict=True)]
    automaton = build(part, found, own, n, v, mass)
    count = own[0][found[0].at[part.real]].astype(float)
    starts = part.first[:-1] - np.arange(len(part.first) - 1)  # without the start tokens
    base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "held_out": docs["held_out"],
            "n_tokens": np.add.reduceat(np.ones(len(count), np.int64), starts),
            "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "train_tokens": np.full(docs.num_rows, n, np.int64),
            "base_score": np.add.reduceat(base, starts),
            "score": traverse(part, automaton, len(known)),
        },
        schema=_arrow(_SCORES),
    )


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    mass: float = MASS,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    cut = docs.withColumn("task", F.spark_partition_id() + 1)
    # Stored, so that both passes see the same blocks whatever executor is lost.
    blocks = materialize(cut.mapInArrow(_cut_into_blocks(block_bytes, part_bytes), _BLOCKS), "lm-blocks")
    slice_bits = math.ceil(math.log2(SLICES * math.sqrt(max(1, blocks.count()))))
    counts = blocks.mapInArrow(_counts_of_blocks(order, slice_bits), _COUNTS)
    totals = materialize(counts.groupBy("ord", "slice").applyInArrow(_totals_of_slice, _TOTALS), "ngram-totals")
    sums = totals.filter("ord = 0").agg(F.sum("n_total").alias("n"), F.sum("n_distinct").alias("v")).first()
    scoring = _score_block(order, sums.n or 0, sums.v or 0, mass)
    return (
        blocks.groupBy("block")
        .cogroup(totals.select("ord", "slice", "block", "others").groupBy("block"))
        .applyInArrow(scoring, _SCORES)
    )
