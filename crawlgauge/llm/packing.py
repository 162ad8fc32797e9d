"""Best-fit packing of tokenised documents into sequences, improved by swaps between underfull sequences.

A document is its ids and an end id; one that is longer than a sequence is cut into full pieces and a rest. Full
pieces are sequences of their own. The others are dealt by a hash of their number into groups of bounded size,
and each group is packed by itself:

  1. Best fit by falling length: every piece goes to the fullest sequence it still fits into.
  2. Swap search: from the emptiest sequence on, a piece moves into a fuller one, is exchanged for a shorter piece,
     for two shorter ones, or two pieces are exchanged for one. Only exchanges that raise the sum of squared fills
     are made, so length gathers in full sequences and the emptiest run out. The search ends at the least possible
     number of sequences, when no exchange helps, or after EFFORT pairs of sequences.

Sequences that are still underfull are taken apart and packed once more over larger neighbourhoods, the groups
being few by then. No document is dropped, shortened or padded.

Defined cases: null and empty texts are just the end id; null ids, repeated ids and repeated rows are packed like
others, a piece being known by a number of its own; an empty table gives no sequences; further columns of the input
do not matter. Very long texts are encoded one at a time and give many pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import materialize
from crawlgauge.llm.token_files import END, VOCABULARY, encoder, with_ends

# Tokens of a sequence.
CAPACITY = 4096
# Pieces of a group on average: what one task packs, some megabytes.
GROUP_PIECES = 40_000
# Pairs of sequences a group's swap search looks at, at most. The places of pieces depend on it, never which are kept.
EFFORT = 50_000

# --- pieces -----------------------------------------------------------------------------------


def _cut(path: str, end: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, number = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = with_ends(*tool.batch(batch.column("text")), end)
            n_pieces = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[of] - start)
            first = (np.cumsum(counts) - counts)[of] + start
            raw = flat.astype("<u4").view(np.uint8)
            spans = zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True)
            if keep_ids:
                last = pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary())
            else:
                last = pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(of))),
                    batch.column("doc_id").take(pa.array(of)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    last,
                ],
                ["key", "doc_id", "piece", "start", "length", "ids" if keep_ids else "ids_crc32"],
            )
            number += len(of)

    return run


def pieces(
    docs: DataFrame, path: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, doc_id, piece, start, length and the ids (little-endian 32-bit
    numbers) or their checksum. Keys are distinct within one evaluation: store the table before using them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "ids binary" if keep_ids else "ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(
        _cut(path, end, capacity, keep_ids), f"key long, doc_id {kind}, piece int, start long, length long, {last}"
    )


# --- packing of one group ---------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin: by falling length, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Bit r is set while some bin has room for exactly r.
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[bin_].append(item)
        else:
            room, bin_ = capacity, len(bins)
            bins.append([item])
        if room > size:
            with_room[room - size].append(bin_)
            rooms |= 1 << (room - size)
    return bins


class _Bin:
    """An underfull bin: items by length. It has few distinct lengths, as they add up to less than the capacity."""

    def __init__(self, items: list[int], lengths: np.ndarray):
        self.by_length: dict[int, list[int]] = {}
        self.fill = 0
        for item in items:
            self.put(item, int(lengths[item]))

    def put(self, item: int, size: int) -> None:
        self.by_length.setdefault(size, []).append(item)
        self.fill += size
        self.options = None

    def take(self, size: int) -> int:
        items = self.by_length[size]
        item = items.pop()
        if not items:
            del self.by_length[size]
        self.fill -= size
        self.options = None
        return item

    def choices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths that one or two items make up, by rising sum: sum, first length, second length or 0."""
        if self.options is None:
            one = np.array(sorted(self.by_length), np.int64)
            i, j = np.triu_indices(len(one))
            twice = np.array([len(self.by_length[s]) > 1 for s in one.tolist()], bool)
            real = (i != j) | twice[i]
            first = np.concatenate([one, one[i[real]]])
            second = np.concatenate([np.zeros(len(one), np.int64), one[j[real]]])
            total = first + second
            # Of equal sums the single item is enough.
            _, best = np.unique(total, return_index=True)
            self.options = total[best], first[best], second[best]
        return self.options


def _exchange(poor: _Bin, rich: _Bin, capacity: int) -> bool:
    """Make the exchange that adds most to ``rich``, one-for-one, two-for-one or a move; False if none helps."""
    room = capacity - rich.fill
    out_sum, out_1, out_2 = poor.choices()
    back_sum, back_1, back_2 = rich.choices()
    # Nothing comes back in a move.
    back_sum, back_1, back_2 = (np.concatenate([[0], a]) for a in (back_sum, back_1, back_2))
    # For each thing that may come back, the largest choice that still fits.
    at = np.searchsorted(out_sum, back_sum + room, side="right") - 1
    gain = np.where(at >= 0, out_sum[at] - back_sum, 0)
    # Two items for two are left out.
    gain[(back_2 > 0) & (out_2[at] > 0)] = 0
    best = int(np.argmax(gain))
    added = int(gain[best])
    # The sum of squares rises by 2 * added * (rich.fill + added - poor.fill).
    if added <= 0 or rich.fill + added <= poor.fill:
        return False
    moved = [int(s) for s in (out_1[at[best]], out_2[at[best]]) if s]
    returned = [int(s) for s in (back_1[best], back_2[best]) if s]
    there, here = [(poor.take(s), s) for s in moved], [(rich.take(s), s) for s in returned]
    for item, size in there:
        rich.put(item, size)
    for item, size in here:
        poor.put(item, size)
    return True


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, effort: int = EFFORT) -> list[list[int]]:
    """Empty bins by exchanges between underfull ones; returns the bins that are left."""
    fills = np.array([lengths[b].sum() for b in bins], np.int64)
    least = -(-int(fills.sum()) // capacity)
    done = [b for b, f in zip(bins, fills.tolist(), strict=True) if f == capacity]
    open_ = sorted((_Bin(b, lengths) for b, f in zip(bins, fills.tolist(), strict=True) if f < capacity), key=lambda b: b.fill)
    first = tried = 0
    while len(done) + len(open_) > least and first < len(open_) and tried < effort:
        poor, helped = open_[first], False
        for rich in reversed(open_[first + 1 :]):
            tried += 1
            while poor.fill and rich.fill < capacity and _exchange(poor, rich, capacity):
                tried, helped = tried + 1, True
            if not poor.fill or tried >= effort:
                break
        done += [[i for items in b.by_length.values() for i in items] for b in open_ if b.fill == capacity]
        open_ = sorted((b for b in open_ if 0 < b.fill < capacity), key=lambda b: b.fill)
        # The emptiest bin is tried again as long as something came of it; else the next one is.
        first = 0 if helped else first + 1
    return done + [[i for items in b.by_length.values() for i in items] for b in open_]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and fill of the bin for every length, none of which exceeds the capacity."""
    bins = swap_search(best_fit(lengths, capacity), lengths, capacity)
    bin_, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for number, items in enumerate(bins):
        after = np.cumsum(lengths[items])
        bin_[items], offset[items], fill[items] = number, after - lengths[items], after[-1]
    return bin_, offset, fill


# --- packing of a table -----------------------------------------------------------------------


def _pack_groups(placed: DataFrame, capacity: int, group_pieces: int, sequence_base: int) -> DataFrame:
    """Pack the rows of ``placed`` in groups; sets sequence_id, offset and fill."""
    n = placed.count()
    groups = max(1, -(-n // group_pieces))
    columns = placed.columns

    def run(rows: pa.Table) -> pa.Table:
        bin_, offset, fill = pack(rows.column("length").to_numpy(), capacity)
        sequence = sequence_base + (rows.column("_group").to_numpy() << 32) + bin_
        new = {"sequence_id": sequence, "offset": offset, "fill": fill}
        return pa.table({c: pa.array(new[c]) if c in new else rows.column(c) for c in columns})

    dealt = placed.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, placed.schema)


def pack_documents(
    docs: DataFrame, path: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, keep_ids: bool = False,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Every piece of every document with its place: ``pieces`` plus sequence_id, offset and fill of the sequence."""
    stored = materialize(pieces(docs, path, end, capacity, keep_ids), "pieces")
    empty = [F.lit(0).cast("long").alias(c) for c in ("offset", "fill")]
    full = stored.filter(F.col("length") == capacity).select(
        "*", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill")
    )
    rest = stored.filter(F.col("length") < capacity).select("*", F.lit(0).cast("long").alias("sequence_id"), *empty)
    first = materialize(_pack_groups(rest, capacity, group_pieces, 0), "packed")
    again = _pack_groups(first.filter(F.col("fill") < capacity), capacity, group_pieces, 1 << 61)
    return full.unionByName(first.filter(F.col("fill") == capacity)).unionByName(again)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: sequence_id, n_tokens, ids, doc_ids."""
    part = F.struct("offset", "length", "doc_id", "ids")
    ordered = F.array_sort(F.collect_list(part))
    listed = placed.groupBy("sequence_id").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return listed.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("n_tokens"),
        joined.alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )
