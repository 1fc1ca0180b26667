"""Words of UTF-8 text, hashed in whole Arrow batches with NumPy, and the same words as Spark columns.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  Its 64-bit hash is a polynomial over random byte values, taken from
prefix sums, so a batch costs a few passes over its bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SPACES = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_WORD = ~_SPACE
_BASE = np.uint64(0x9E3779B97F4A7C15)  # 5 modulo 8: powers differ in all but a few low bits
_VALUES = np.random.default_rng(20_071).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.empty(size, np.uint64)
            have[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                have[filled : filled + step] = have[:step] * (have[filled - 1] * base)
                filled += step
        if size <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Block:
    """Texts of consecutive rows: ``text i`` is ``data[starts[i]:starts[i+1]]``."""

    first: int
    starts: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut the texts of an Arrow column into blocks of at most ``limit`` bytes, or of one text."""
    at, data = utf8(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Block(row, at[row : end + 1] - at[row], data[at[row] : at[end]])
        row = end


@dataclass
class Words:
    """Words of a block: text ``i`` has words ``at[i]:at[i+1]``; ``begin`` and ``end`` are bytes of the block."""

    at: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def split(block: Block, fold: bool = True) -> Words:
    """Find and hash the words of a block; ``fold`` lower-cases A-Z first."""
    data, starts = block.data, block.starts
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(starts), np.int64), none, none, np.zeros(0, np.uint64))
    word = _WORD.take(data)
    turn = np.empty(n + 1, bool)
    turn[0], turn[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=turn[1:-1])
    edges = np.flatnonzero(turn)
    begin, end = edges[::2].copy(), edges[1::2].copy()
    inner = starts[(starts > 0) & (starts < n)]
    cuts = np.unique(inner[word[inner] & word[inner - 1]])
    if len(cuts):  # a text that ends in a word goes before one that begins with a word
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        values = (_FOLDED if fold else _VALUES).take(data)
        values *= powers(n)
        np.cumsum(values, out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * powers(n, INVERSE)[begin])
    return Words(np.searchsorted(begin, starts), begin, end, hashes)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, width):
            out = mix(out * _BASE + hashes[i : i + n])
    return out


def word_array(text: Column | str) -> Column:
    """Words of a text as a Spark array; null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    flat = F.translate(F.coalesce(column, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def folded(text: Column | str) -> Column:
    """The text with A-Z in lower case; other letters stay."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
