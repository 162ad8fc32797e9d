"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are ranked by how often they occur, so that frequent ids get small numbers. Each number takes one to four
bytes in a data stream; two bits per number in a separate control stream say how many, and decoding looks four
numbers up per control byte. A file set is a folder with two Parquet tables that any executor can reach:

  dictionary  rank, id, n                 ids by falling count, then by id
  blocks      part, seq, start, doc_ids, lengths, control, data

A block holds consecutive documents in ascending id order; ``start`` counts the ids before it in its part, and
parts are in order. Each part is written by one task, so a lost executor costs the parts it was writing.

Texts are encoded with the tokenizers library. Its pipeline drops white space and never joins what white space
separates, so each distinct word is encoded once and remembered; in texts of plain Latin letters, runs of letters
and what stands between them are encoded apart, as the pipeline keeps them apart too. Texts that hold a special
token's opening '<|' are encoded whole.

Defined cases: null and empty texts are just the end id; null ids come first; rows with one id are ordered by
their text's hash, equal rows stay next to each other; an empty table gives an empty file set; further
columns of the input are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlgauge.llm.common import scratch_path, word_codes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1
# Ids in a block, unless one document has more; text bytes of a part, on average.
BLOCK_IDS = 1 << 16
PART_BYTES = 16 << 20
# Encoded words a task remembers; results do not depend on it.
REMEMBERED = 600_000

_STAGED = "part int, seq long, start long, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCKS = "part int, seq long, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"

# --- encoding ---------------------------------------------------------------------------------

# Letters, of which a run is one piece of the library's pipeline; all have a plain lower case and stay as they
# are under normalisation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER_TEXT = f"[^\\x00-\\x7F{_LETTERS}]|'[^\\s{_LETTERS}]|[^\\s{_LETTERS}]'|<\\|"
_BETWEEN = f"([^\\s{_LETTERS}']+)"


class Encoder:
    """Ids of words and of runs of letters, remembered in one growing array."""

    def __init__(self, path: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Tokens that end a run of letters.
        closing = [(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)]
        self.closes = np.array(closing, bool)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, words: list[bytes], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def learn(self, words: list[bytes], together: int = 512) -> None:
        """Encode the words that are not remembered; runs of letters side by side, apart by spaces."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.slot]
        runs, odd = [], []
        for word in new:
            text = word.decode()
            (runs if text.isalpha() and max(text) <= "ÿ" else odd).append(word)
        for i in range(0, len(odd), 1 << 14):
            some = odd[i : i + (1 << 14)]
            ids = self.whole([w.decode() for w in some])
            sizes = np.array(list(map(len, ids)), np.int64)
            self._remember(some, [np.array([i for own in ids for i in own], np.uint32)], sizes)
        groups = [runs[i : i + together] for i in range(0, len(runs), together)]
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            ids = [np.array(own, np.uint32) for own in self.whole([b" ".join(g).decode() for g in some])]
            flat = np.concatenate(ids)
            ends = np.flatnonzero(self.closes[flat]) + 1
            names = [w for g in some for w in g]
            assert len(ends) == len(names) and ends[-1] == len(flat), "a run of letters did not end with a closing token"
            self._remember(names, [flat], np.diff(ends, prepend=0))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts without end ids, and how many each text has."""
        texts = pc.fill_null(texts, "")
        # Texts of known letters fall apart into runs of letters and what is between; others only at white space.
        simple = pc.invert(pc.match_substring_regex(texts, _OTHER_TEXT))
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), _BETWEEN, r" \1 ")
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, "", pc.if_else(simple, spaced, texts))
        codes, ends, words = word_codes(plain, lower=False)
        self.learn(words)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        size = np.diff(self.ends)[slots][codes] if len(words) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        first = self.ends[:-1][slots][codes] if len(words) else size
        flat = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        counts = total[ends[1:]] - total[ends[:-1]]
        if pc.any(special).as_py():
            pieces = np.split(flat, np.cumsum(counts)[:-1])
            rows = np.flatnonzero(special.to_numpy(zero_copy_only=False))
            for i, ids in zip(rows, self.whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
                pieces[i] = np.array(ids, np.uint32)
            flat, counts = np.concatenate(pieces), np.array(list(map(len, pieces)), np.int64)
        return flat.astype(np.uint32), counts


@lru_cache(maxsize=1)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per process."""
    return Encoder(path)


def with_ends(flat: np.ndarray, counts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every document."""
    return np.insert(flat, np.cumsum(counts), end).astype(np.uint32), counts + 1


# --- coding -----------------------------------------------------------------------------------

# Bytes of each of the four numbers of a control byte.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = numbers.astype("<u4")
    extra = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    planes = numbers.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), planes[np.arange(4) <= extra[:, None]].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers of a block: lengths come from a table with a row per control byte."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    out = raw[at]
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        out[longer] |= raw[at[longer] + byte] << np.uint32(8 * byte)
    return out


# --- writing ----------------------------------------------------------------------------------


def _stage_ids(path: str, end: int, block_ids: int):
    """Blocks with plain 32-bit ids, from one sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part = encoder(path), TaskContext.get().partitionId()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        seq = start = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = with_ends(*tool.batch(batch.column("text")), end)
            doc_ids = batch.column("doc_id").to_pylist()
            after = np.cumsum(counts)
            rows, a, used = [], 0, 0
            while a < len(counts):
                # As many documents as fit, one at least.
                b = max(a + 1, int(np.searchsorted(after, used + block_ids, side="right")))
                own = flat[used : after[b - 1]].astype("<u4")
                rows.append((part, seq, start, doc_ids[a:b], counts[a:b].tolist(), own.tobytes()))
                seq, start, used, a = seq + 1, start + len(own), int(after[b - 1]), b
            arrays = [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _STAGED.split(", ")])

    return run


def _count_ids(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                seen += np.bincount(np.frombuffer(ids.as_buffer(), "<u4"), minlength=size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["id", "n"])

    return run


def _recode(ids_by_rank: np.ndarray, size: int):
    """Blocks with ranked, variable-length numbers instead of plain ids."""
    rank = np.zeros(size, np.uint32)
    rank[ids_by_rank] = np.arange(len(ids_by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_numbers(rank[np.frombuffer(i.as_buffer(), "<u4")]) for i in batch.column("ids")]
            control, data = zip(*coded, strict=True) if coded else ((), ())
            kept = [batch.column(c) for c in ("part", "seq", "start", "doc_ids", "lengths")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                ["part", "seq", "start", "doc_ids", "lengths", "control", "data"],
            )

    return run


def write_files(
    docs: DataFrame, folder: str, path: str = VOCABULARY, end: int = END, block_ids: int = BLOCK_IDS,
    part_bytes: int = PART_BYTES,
) -> None:
    """Write the file set of all documents in ascending doc_id order. Every text is encoded once."""
    spark = docs.sparkSession
    docs, size = docs.select("doc_id", "text"), encoder(path).size
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    staged_at = scratch_path(spark, "token-ids")
    (
        docs.withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange(max(1, -(-total // part_bytes)), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_stage_ids(path, end, block_ids), _STAGED)
        .write.option("compression", "zstd")
        .parquet(staged_at)
    )
    staged = spark.read.schema(_STAGED).parquet(staged_at)
    # One row per id and task, then one per id: at most as many as the vocabulary has.
    counts = staged.select("ids").mapInArrow(_count_ids(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    rows = [(rank, r.id, r.n) for rank, r in enumerate(ranked)]
    spark.createDataFrame(rows, "rank int, id int, n long").coalesce(1).write.parquet(f"{folder}/dictionary")
    ids_by_rank = np.array([r.id for r in ranked], np.int64)
    blocks = staged.mapInArrow(_recode(ids_by_rank, size), _BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")


# --- reading ----------------------------------------------------------------------------------


def _read_blocks(ids_by_rank: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["lengths"], np.int64)
                after = np.cumsum(counts)
                ids = ids_by_rank[decode_numbers(row["control"], row["data"], int(after[-1]))].astype("<u4")
                if digest:
                    raw = ids.view(np.uint8)
                    ends = (4 * after).tolist()
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.int64())
                else:
                    offsets = pa.array(np.concatenate([[0], after]).astype(np.int32))
                    last = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.full(len(counts), row["part"], np.int32)),
                        pa.array(row["start"] + after - counts),
                        pa.array(counts),
                        last,
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (or their checksum) of every document of a file set."""
    by_rank = spark.read.parquet(f"{folder}/dictionary").orderBy("rank").select("id").collect()
    ids_by_rank = np.array([r.id for r in by_rank], np.uint32)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    # One number per part; parts hold PART_BYTES each, so this stays small beside the data.
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    known = sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())
    firsts = np.cumsum([0, *(n for _, n in known)])
    parts = spark.createDataFrame(
        [(p, int(f)) for (p, _), f in zip(known, firsts, strict=False)], "part int, first long"
    )
    last = "ids_crc32 long" if digest else "ids array<int>"
    read = blocks.mapInArrow(
        _read_blocks(ids_by_rank, digest), f"doc_id long, part int, start long, n_tokens long, {last}"
    )
    return (
        read.join(F.broadcast(parts), "part")
        .withColumn("start", F.col("start") + F.col("first"))
        .drop("part", "first")
    )
