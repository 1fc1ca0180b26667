"""Pattern packing of token pieces into sequences by non-negative least squares.

The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) goes
to the driver.  There, patterns of up to three lengths that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded, and the pieces left over are packed best-fit, by length and count.  The plan
gives ranges of ranks per length; executors number the pieces of each length and join.

Null and empty texts are the end id alone.  Repeated rows are packed like any others; an
empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import materialize, partitions, ranked, table
from inlay.llm.words import utf8

CAPACITY = 1024
END = 2
SWEEPS = 400
ROWS_PER_PART = 200_000
BROADCAST_SEGMENTS = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to uint32 ids of the byte-level vocabulary in ``path``.

    The pairs of this vocabulary are merged in the order of their ids, so the encoder for
    ranked vocabularies gives the ids of the file's own library at several times its
    speed; a text it refuses goes to that library.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in content["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # a text beyond the limits of its pattern engine
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: full ones, and a shorter one in front."""
    first = n - (math.ceil(n / capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``with_ids`` adds their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, data = utf8(batch.column(1))
            rows, ids_out = [], []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = np.append(encode(data[at[i] : at[i + 1]].tobytes().decode("utf-8")), np.uint32(end)).astype("<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc_id, p, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence and whose lengths occur."""
    have = histogram > 0
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    lengths = np.flatnonzero(have[:capacity])
    for a in lengths[lengths <= capacity // 2]:
        if have[capacity - a]:
            rows.append(np.array([[a, capacity - a, 0]]))
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        c = capacity - a - b
        good = have[c] & (b > 0)
        rows.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit(histogram: np.ndarray, rows: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts ``x >= 0`` that bring the lengths used by ``rows`` close to the histogram.

    Block coordinate descent: a sweep takes the patterns of the largest decrease that
    share no length and moves each to its exact minimum, clipped at zero.
    """
    x = np.zeros(len(rows))
    rest = histogram.astype(float)
    rest[0] = 0.0
    a, b, c = rows.T
    norm = 1.0 + (b > 0) + (c > 0) + 2.0 * (a == b) + 2.0 * ((b == c) & (c > 0)) + 2.0 * ((a == c) & (c > 0))
    for _ in range(sweeps):
        slope = rest[a] + rest[b] + rest[c]
        step = np.maximum(slope / norm, -x)
        gain = step * slope - step * step * norm / 2
        best = np.argpartition(gain, -min(len(gain), 4096))[-min(len(gain), 4096) :]
        best = best[np.argsort(-gain[best])]
        used: set[int] = set()
        moved = 0.0
        for p in best:
            if gain[p] <= 1e-3:
                break
            lengths = {int(v) for v in rows[p] if v}
            if not used & lengths:
                used |= lengths
                x[p] += step[p]
                moved += gain[p]
                for v in rows[p]:
                    if v:
                        rest[v] -= step[p]
        if moved <= 1e-2:
            break
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that use up ``left`` pieces per length, longest first, tightest bin first."""
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            free = next((f for f in range(length, capacity) if bins[f]), None)
            if free is None:
                each = capacity // length
                for size, n in ((each, count // each), (count % each, 1)):
                    if size and n:
                        bins[capacity - size * length].append(((length,) * size, n))
                break
            held, n = bins[free].pop()
            m = min(n, count)
            if n > m:
                bins[free].append((held, n - m))
            bins[free - length].append((held + (length,), m))
            count -= m
    return [group for free in bins for group in free]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Compositions and how often each is used; together they use up the histogram."""
    left = histogram.copy()
    out = []
    rows = patterns(left, capacity)
    if len(rows):
        x = np.rint(fit(left, rows)).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            if x[p] <= 0:
                break
            lengths = tuple(int(v) for v in rows[p] if v)
            n = min(int(x[p]), *[int(left[v]) // lengths.count(v) for v in lengths])
            if n > 0:
                out.append((lengths, n))
                for v in lengths:
                    left[v] -= n
    return out + best_fit(left, capacity)


def segments(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, last rank, first sequence, offset)`` for each place of each composition."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            first = seen.get(v, 0)
            out.append((v, first, first + n - 1, sequence, offset))
            seen[v] = first + n
            offset += v
        sequence += n
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``cut_pieces`` with ``sequence_id`` and ``offset``."""
    spark = cut_pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut_pieces.groupBy("length").count().collect():
        histogram[length] = n
    rows = segments(plan(histogram, capacity))
    schema = "length bigint, first_rank bigint, last_rank bigint, first_sequence bigint, offset bigint"
    where = spark.createDataFrame(rows, schema)
    if len(rows) <= BROADCAST_SEGMENTS:
        where = F.broadcast(where)
    parts = max(1, math.ceil(int(histogram.max()) / ROWS_PER_PART), partitions(spark) // 8)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    numbered = ranked(cut_pieces, ["length"], order, "rank", parts)
    met = numbered.join(where, "length").where(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    sequence = F.col("first_sequence") + F.col("rank") - F.col("first_rank")
    return met.select(*cut_pieces.columns, sequence.alias("sequence_id"), "offset")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut, number and pack ``docs``; the pieces are stored once between the steps."""
    return pack(materialize(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@queries.query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path())
