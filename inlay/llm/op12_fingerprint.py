"""Document fingerprints by consistent weighted sampling (op12).

A document is the multiset of its lower-cased words; a word weighs as often as it occurs.  Each
of ``SAMPLES`` samples draws, for every word alone, ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``,
rounds the logarithm of its weight down to the grid of step ``r`` shifted by ``b``, and picks the
word with the least ``ln a = ln c - r (t - b + 1)``.  Two documents pick the same word at the
same grid place with the probability of their generalised Jaccard similarity (the sum of the
lesser weights over the sum of the greater ones), so the share of equal samples estimates it.

Draws are functions of word and sample, so fingerprints are equal wherever and whenever they are
made.  What a word of some weight contributes is worked out once for a block of texts; the rest
is one minimum per document and sample.  A sample is kept in 16 bits: unequal samples look alike
once in 65,535 times.  No word at all gives zeros in all places.

The query needs each document's neighbour.  Ids are cut into ranges by a sample of ids (it moves
the borders only), the first document of the range behind comes along as a guest, and one
shuffle brings neighbours together in order.

Results that are defined here: null texts are empty; nulls in the id come last; rows of one id
follow each other by the 64-bit hash of the text, then by the text, and repeated rows one after
the other; the only row of a table is its own neighbour.  A text is fingerprinted whole, which takes
some 80 bytes of memory for each of its bytes.  Columns other than the named ones stay out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from inlay.llm import queries
from inlay.llm.common import partitions, table
from inlay.llm.words import Block, mix, split, utf8

SAMPLES = 128
BLOCK_BYTES = 1 << 21  # texts worked on together
AT_ONCE = 8  # samples worked on together
IN_CACHE = 1 << 13  # weighted words worked on together
BORDERS_PER_PART = 50  # sampled ids from which one border is taken
HEX = 4  # digits of a sample
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 32) - 1)


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform values in (0, 1) from 64 mixed bits."""
    scale = 1.0 / (1 << 32)
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((h & _LOW).astype(np.float64) + 0.5) * scale


def contributions(words: np.ndarray, ln_weights: np.ndarray, sample: int) -> np.ndarray:
    """Order-preserving key of ``ln a`` for every weighted word, its lowest 16 bits the sample's code."""
    with np.errstate(over="ignore"):
        seed = mix(words + np.uint64(3 * sample + 1) * _GOLDEN)
        u1, u2 = _halves(mix(seed + _GOLDEN))
        u3, u4 = _halves(mix(seed + np.uint64(2) * _GOLDEN))
        shift, _ = _halves(seed)
        r = -np.log(u1 * u2)
        t = np.floor(ln_weights / r + shift)
        ln_a = np.log(-np.log(u3 * u4)) - r * (t - shift + 1.0)
        code = (seed + t.astype(np.int64).astype(np.uint64) * _GOLDEN) & np.uint64(0xFFFF)
    bits = ln_a.view(np.int64)
    ordered = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return (ordered & ~np.int64(0xFFFF)) | np.maximum(code, 1).astype(np.int64)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted words of texts, by text: the text, the row of the word and weight in the two tables behind."""
    at, data = utf8(pa.array(texts, pa.large_string()))
    found = split(Block(0, at, data))
    words, word = np.unique(found.hashes, return_inverse=True)
    places = np.repeat(np.arange(len(texts)), np.diff(found.at)) * max(1, len(words)) + word
    places.sort()
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else places
    weights = np.diff(np.append(starts, len(places)))
    rows, word = np.divmod(places[starts], max(1, len(words)))
    most = int(weights.max(initial=0)) + 1
    kinds, kind = np.unique(word * most + weights, return_inverse=True)
    return rows, kind, words[kinds // most], kinds % most


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 16-bit codes per text."""
    out = np.zeros((len(texts), samples), np.uint16)
    rows, kind, words, weights = bags(texts)
    if not len(rows):
        return out
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    ln_weights = np.log(weights)
    for low in range(0, samples, AT_ONCE):
        some = range(low, min(samples, low + AT_ONCE))
        keys = np.empty((len(words), len(some)), np.int64)
        for first in range(0, len(words), IN_CACHE):
            part = slice(first, first + IN_CACHE)
            for n, sample in enumerate(some):
                keys[part, n] = contributions(words[part], ln_weights[part], sample)
        least = np.minimum.reduceat(keys.take(kind, axis=0), starts, axis=0)
        out[rows[starts], low : low + len(some)] = (least & np.int64(0xFFFF)).astype(np.uint16)
    return out


def written(codes: np.ndarray) -> list[str]:
    """Signatures as strings of ``HEX`` digits a sample."""
    return [row.tobytes().hex() for row in codes.astype(">u2")]


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with the fingerprint of its text in ``out``; no shuffle."""

    @pandas_udf("string")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, done = batch.fillna("").tolist(), []
            for block in blocks_of(texts):
                done += written(signatures(block, samples))
            yield pd.Series(done, dtype=object)

    return docs.withColumn(out, sign(F.col(text)))


def blocks_of(texts: list[str]) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        F.lit(0),
        lambda n, i: n + (F.substr(left, i * HEX + 1, F.lit(HEX)) == F.substr(right, i * HEX + 1, F.lit(HEX))).cast("int"),
    )
    return equal / F.lit(float(samples))


# -- neighbours ------------------------------------------------------------------------------

ORDER = ["_none", "_down", "_hash"]  # ids downwards, nulls last, then the hash of the text


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in tasks of consecutive ids, in order, with the first row behind each range as ``_guest``."""
    spark = docs.sparkSession
    parts = partitions(spark)
    keyed = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("doc_id").isNull().alias("_none"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("_down"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )
    rows = docs.count()
    share = min(1.0, BORDERS_PER_PART * parts / max(1, rows))
    sample = keyed.sample(share, seed=12) if share < 1 else keyed
    seen = sorted(tuple(r) for r in sample.select(*ORDER).collect())  # some BORDERS_PER_PART rows a part
    borders = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []

    @pandas_udf("int")
    def part_of(none: pd.Series, down: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, key) for key in zip(none, down, code)], dtype="int32")

    dealt = keyed.withColumn("_part", part_of(*ORDER))
    heads = dealt.select("_part", *ORDER).groupBy("_part").agg(F.min(F.struct(*ORDER)).alias("_head"))
    first = sorted((r["_part"], tuple(r["_head"])) for r in heads.collect())  # one row a part
    guests = [(part, *first[(i + 1) % len(first)][1]) for i, (part, _) in enumerate(first)]
    called = spark.createDataFrame(guests, "_part int, _none boolean, _down bigint, _hash bigint")
    fetched = keyed.join(F.broadcast(called), ORDER).groupBy("_part").agg(F.min(F.struct("text", "doc_id")).alias("_row"))
    guest = fetched.select("_part", F.lit(True).alias("_guest"), "_row.doc_id", "_row.text")
    both = dealt.withColumn("_guest", F.lit(False)).unionByName(guest, allowMissingColumns=True)
    ordered = both.repartition("_part").sortWithinPartitions("_part", "_guest", *ORDER, "text")
    return ordered.select("_part", "_guest", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next document."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last one, which only is a neighbour."""
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
    codes = signatures([*texts, *edited])
    own, other = codes[: len(texts)], codes[len(texts) :]
    hexed = written(codes)
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(hexed[: len(edited)], pa.string()),
        pa.array(hexed[len(texts) :], pa.string()),
        pa.array((own[:-1] == other).mean(1), pa.float64()),
        pa.array((own[:-1] == own[1:]).mean(1), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, and how alike they are (:data:`OUT`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for _, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if guest:
                    yield compare(ids, texts)
                    ids, texts, size = [], [], 0
                elif size >= BLOCK_BYTES and len(ids) > 1:
                    yield compare(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return in_ranges(docs).mapInArrow(run, OUT)


@queries.query("op12_fingerprint")
def op12_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return compared(table(spark, folder, "documents", "doc_id", "text"))
