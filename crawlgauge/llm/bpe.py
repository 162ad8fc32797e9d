"""Byte-level BPE with the tiktoken library: texts to ids, ids to raw bytes.

Texts are cut into bounded chunks at safe boundaries before the library sees them: a match of the
splitting pattern holds white space only at its start or throughout, so no match crosses a place where
white space follows something else. Chunks end just before such a place. White-space runs too long for the
library's matcher are cut by hand into the pieces the pattern would make.

Defined cases: null and empty texts give no ids, no ids decode to no bytes, and ids outside the rank
file raise KeyError. Any text round-trips to its UTF-8 bytes. A run without white space stays whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Characters per chunk, as soon as a safe boundary allows.
CHUNK = 1 << 16
# White-space runs from this length on are cut by hand.
LONG_SPACE = 1 << 12

_SPACES = regex.compile(r"\p{White_Space}{%d,}+" % LONG_SPACE)
_BOUNDARY = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, once per process."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Cut at the first safe boundary after every ``size`` characters."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def _space_pieces(run: str, at_end: bool) -> tuple[list[str], str]:
    """Pieces of a white-space run, and what of it belongs to the text behind it."""
    if at_end:
        return [run], ""
    if run[-1] == " ":
        return [run[:-1]], " "
    return [run[:-1], run[-1]], ""


def encode_text(text: str | None, enc: tiktoken.Encoding, size: int = CHUNK) -> np.ndarray:
    """Ids as the library would give them for the whole text, without special tokens."""
    if not text:
        return np.empty(0, np.uint32)
    if len(text) <= LONG_SPACE:
        return enc.encode_to_numpy(text, disallowed_special=())
    ids: list[np.ndarray] = []
    start, carried = 0, ""
    for run in _SPACES.finditer(text):
        ids += _encode_plain(carried + text[start : run.start()], enc, size)
        pieces, carried = _space_pieces(run.group(), run.end() == len(text))
        ids += [np.array(enc._encode_single_piece(p), np.uint32) for p in pieces]
        start = run.end()
    ids += _encode_plain(carried + text[start:], enc, size)
    return np.concatenate(ids) if ids else np.empty(0, np.uint32)


def _encode_plain(text: str, enc: tiktoken.Encoding, size: int) -> list[np.ndarray]:
    return [enc.encode_to_numpy(c, disallowed_special=()) for c in chunks(text, size) if c]


def encode(text: Column, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of a text column as array<int>."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        rows = [encode_text(t, enc) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return ids_of(text)


def decode(ids: Column, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Raw bytes of an id column; they need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        return pa.array([enc.decode_bytes(r.values.to_pylist()) if r.is_valid else b"" for r in rows], pa.binary())

    return bytes_of(ids)
