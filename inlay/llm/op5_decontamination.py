"""Benchmark decontamination by greedy string tiling over words.

Documents and benchmark items that share a run of ``MIN_MATCH`` words (a seed) are tiled:
running Karp-Rabin finds matches from long to short, the longest ones that overlap no
earlier tile are marked, and the marked part of the item is its coverage.  Passages
that were moved around inside a document count in full.

Items are broadcast in blocks of about ``BLOCK_BYTES`` of text, which a task goes
through one by one, so a benchmark of any size is met by all documents without a shuffle of
their words.

Words are folded to lower case (A-Z).  Null and empty texts, and items of fewer than
``MIN_MATCH`` words, match nothing.  Repeated rows are judged alike, ties between items
go to the smallest id, an empty table of either kind contaminates nothing, and other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import table
from inlay.llm.words import blocks, powers, rolling, split

MIN_MATCH = 5
THRESHOLD = 0.5
FIRST_LENGTH = 20
BLOCK_BYTES = 16 << 20
FOUND = "doc_id bigint, n_items bigint, item_id bigint, n_covered bigint, coverage double, kept boolean"


class Hashed:
    """Word hashes of a text with prefix sums, from which any window's hash is read off."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.marked = np.zeros(len(hashes), bool)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * powers(max(len(hashes), 1))[: len(hashes)], out=self.sums[1:])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked windows of ``length`` words and their hashes."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        starts = np.flatnonzero(marks[length:] == marks[:-length])
        top = powers(len(self.hashes))[len(self.hashes) - 1 - starts]  # brings all windows to one power
        with np.errstate(over="ignore"):
            return starts, (self.sums[starts + length] - self.sums[starts]) * top


def matches(doc: Hashed, item: Hashed, length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches ``(words, place in item, place in doc)`` of at least ``length`` words."""
    at_item, item_keys = item.windows(length)
    at_doc, doc_keys = doc.windows(length)
    if not len(at_item) or not len(at_doc):
        return []
    # the powers of the two texts differ by their lengths
    shift = len(doc.hashes) - len(item.hashes)
    with np.errstate(over="ignore"):
        if shift >= 0:
            item_keys = item_keys * powers(shift + 1)[shift]
        else:
            doc_keys = doc_keys * powers(1 - shift)[-shift]
    order = np.argsort(item_keys, kind="stable")
    low = np.searchsorted(item_keys[order], doc_keys, "left")
    high = np.searchsorted(item_keys[order], doc_keys, "right")
    out = []
    a, b, ma, mb = doc.hashes, item.hashes, doc.marked, item.marked
    for k in np.flatnonzero(high > low):
        i = int(at_doc[k])
        for j in at_item[order[low[k] : high[k]]].tolist():
            if i and j and not ma[i - 1] and not mb[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a match that starts earlier
            n = min(len(a) - i, len(b) - j)
            same = (a[i : i + n] == b[j : j + n]) & ~ma[i : i + n] & ~mb[j : j + n]
            run = n if same.all() else int(np.argmin(same))
            if run >= length:
                out.append((run, j, i))
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(words, place in item, place in doc)``, longest first."""
    a, b = Hashed(doc), Hashed(item)
    tiles = []
    length = max(min_match, FIRST_LENGTH)
    while True:
        found = matches(a, b, length)
        longest = max((f[0] for f in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for run, j, i in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if a.marked[i : i + run].any() or b.marked[j : j + run].any():
                again = True  # what is left of it is looked for once more
                continue
            a.marked[i : i + run] = True
            b.marked[j : j + run] = True
            tiles.append((run, j, i))
        if again:
            continue
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class Items:
    """Benchmark items of one block with their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], min_match: int):
        self.ids = ids
        self.words: list[np.ndarray] = []
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block in blocks(pa.array(texts, pa.string())):
            words = split(block)
            for i in range(len(block)):
                own = words.hashes[words.at[i] : words.at[i + 1]]
                seeds = np.unique(rolling(own, min_match))
                keys.append(seeds)
                owners.append(np.full(len(seeds), len(self.words)))
                self.words.append(own)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], owner[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def seeds_in(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``seeds`` that items have, and the range of their owners."""
        at = np.flatnonzero(self.filter[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.keys, seeds[at], "left")
        high = np.searchsorted(self.keys, seeds[at], "right")
        real = high > low
        return at[real], low[real], high[real]


class Judge:
    """Best covered item of each text, over all blocks of the benchmark."""

    def __init__(self, shared: list[Broadcast], min_match: int, threshold: float):
        self.shared, self.min_match, self.threshold = shared, min_match, threshold
        self.items: Items | None = None

    def blocks(self) -> Iterator[Items]:
        """One block in memory at a time; a single one is kept."""
        if self.items is not None:
            yield self.items
            return
        for part in self.shared:
            items = Items(*part.value, self.min_match)
            if len(self.shared) == 1:
                self.items = items
            yield items

    def __call__(self, texts: pa.Array) -> list[tuple]:
        """``(n_items, item_id, n_covered, item_words)`` per text."""
        best: list[tuple] = [(0.0, 0, None, 0)] * len(texts)
        n_items = [0] * len(texts)
        for items in self.blocks():
            for block in blocks(texts):
                words = split(block)
                at, low, high = items.seeds_in(rolling(words.hashes, self.min_match))
                row = np.searchsorted(words.at, at, "right") - 1
                inside = at + self.min_match <= words.at[row + 1]
                pairs: dict[int, set[int]] = {}
                for r, a, b in zip(row[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
                    pairs.setdefault(r, set()).update(items.owners[a:b].tolist())
                for r, met in pairs.items():
                    own = words.hashes[words.at[r] : words.at[r + 1]]
                    n = block.first + r
                    for k in met:
                        covered = sum(t[0] for t in tile(own, items.words[k], self.min_match))
                        share = covered / len(items.words[k])
                        n_items[n] += share >= self.threshold
                        best[n] = max(
                            best[n],
                            (share, covered, items.ids[k], len(items.words[k])),
                            key=lambda c: (c[0], c[2] is not None, -(c[2] or 0)),
                        )
        return [(n, b[2], b[1], b[0]) for n, b in zip(n_items, best)]


def judge(benchmark: DataFrame, min_match: int, threshold: float, block_bytes: int) -> Judge:
    """Broadcast the benchmark in blocks of a checked size."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = 1 if size <= block_bytes else math.ceil(2 * size / block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    shared = []
    for b in range(n):
        taken = (items if n == 1 else items.where(block == b)).collect()
        shared.append(items.sparkSession.sparkContext.broadcast(([r[0] for r in taken], [r[1] for r in taken])))
    return Judge(shared, min_match, threshold)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_items, item_id, n_covered, coverage, kept``."""
    judged = judge(benchmark, min_match, threshold, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_items, item, covered, share = zip(*judged(batch.column(1))) if batch.num_rows else ((), (), (), ())
            kept = [not n for n in n_items]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip((n_items, item, covered, share, kept), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f"c{i}" for i in range(6)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FOUND)


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` that no item contaminates, with all their columns."""
    judged = judge(benchmark, min_match, threshold, block_bytes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not found[0] for found in judged(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@queries.query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return contamination(docs, table(spark, folder, "benchmark", "item_id", "text"))
