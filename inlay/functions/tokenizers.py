"""Text to token ids: built-in column forms and the plug-in protocol."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from inlay.operators.skew import spread_join
from inlay.staging import materialize

WORD_BREAK = "[ \n\t\r]+"
BROADCAST_WORDS = 500_000  # checked before broadcasting: a word and its number each
PIECE = 1 << 20  # characters or ids a plug-in handles at a time
HASHED_PIECE = 1 << 23  # bytes of text whose distinct words are hashed together


class Tokenizer(Protocol):
    """What a user-supplied tokenizer offers."""

    eos_token_id: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def word_id(word: Column) -> Column:
    """Hashed word id from 1 on; 0 stays free for EOS."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("bigint") + 1).cast("int")


def word_tokens(text: Column) -> Column:
    return F.transform(words(text), word_id)


def codepoint_tokens(text: Column) -> Column:
    """One token per Unicode code point; the pattern keeps surrogate pairs whole."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)


def vocabulary_tokens(docs: DataFrame, vocabulary: DataFrame, id_col: str, unknown: int) -> DataFrame:
    """Tokenise ``docs(id_col, text)`` by joining words to ``vocabulary(word, token)``.

    Texts are dealt by id before they are split, so words stay where their list is put together; only
    a vocabulary too large to broadcast makes them move.
    """
    vocabulary = materialize(vocabulary.select("word", "token"), "vocabulary")
    dealt = docs.repartition(id_col)
    spots = dealt.select(id_col, F.posexplode_outer(words(F.col("text"))).alias("_at", "word"))
    if vocabulary.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        coded = spots.join(F.broadcast(vocabulary), "word", "left")
    else:
        coded = spread_join(spots, vocabulary, ["word"], [id_col, "_at"], "left")
    item = F.struct("_at", F.coalesce("token", F.lit(unknown)).alias("token"))
    kept = F.collect_list(F.when(F.col("_at").isNotNull(), item))
    return coded.groupBy(id_col).agg(F.transform(F.array_sort(kept), lambda s: s["token"]).alias("tokens"))


def pieces(values: pa.Array, sizes: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """``values`` in runs of some ``PIECE`` (or ``most``) characters or ids in all, one row at least."""
    most = PIECE if most is None else most
    first = total = 0
    for at, size in enumerate(sizes.to_pylist()):
        if at > first and total + (size or 0) > most:
            yield values.slice(first, at - first)
            first, total = at, 0
        total += size or 0
    if len(values):
        yield values.slice(first)


def hashed_ids(distinct: pa.Array) -> np.ndarray:
    """:func:`word_id` of every word of an Arrow array."""
    heads = b"".join([hashlib.md5(w).digest()[:4] for w in distinct.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(heads, dtype=">u4") >> 4).astype(np.int32) + 1  # seven hex digits


def hashed_lists(texts: pa.Array) -> pa.Array:
    """:func:`word_tokens` of an Arrow array of texts; every distinct word is hashed once."""
    plain = texts
    for space in "\n\t\r":
        plain = pc.replace_substring(plain, space, " ")
    split = pc.split_pattern(plain, " ")
    kept = pc.greater(pc.binary_length(split.values), 0)
    ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    coded = split.values.filter(kept).dictionary_encode()
    ids = hashed_ids(coded.dictionary)[coded.indices.to_numpy()]
    offsets = pa.array(ends[split.offsets.to_numpy()], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)


@F.arrow_udf(ArrayType(IntegerType()))
def hashed_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`word_tokens` for large tables, which would hash most words many times."""
    for texts in batches:
        for some in pieces(texts, pc.binary_length(texts), HASHED_PIECE):
            yield hashed_lists(some)


def plugin_tokens(make_tokenizer: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """Column function around a tokenizer that every Python worker loads once; ids leave it in small batches."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = make_tokenizer()
        for texts in batches:
            for some in pieces(texts, pc.binary_length(texts)):
                yield pa.array([None if t is None else tokenizer.encode(t) for t in some.to_pylist()], pa.list_(pa.int32()))

    return encode


def id_lists(ids: pa.Array) -> Iterator[list[int] | None]:
    """The lists of an Arrow array of id lists, by way of NumPy, which is faster than ``to_pylist``."""
    if ids.values.null_count:
        yield from ids.to_pylist()
        return
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    for row, there in enumerate(ids.is_valid().to_pylist()):
        yield flat[at[row] : at[row + 1]].tolist() if there else None


def plugin_texts(make_tokenizer: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """The way back: column function from token ids to text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = make_tokenizer()
        for ids in batches:
            for some in pieces(ids, pc.list_value_length(ids)):
                yield pa.array([None if t is None else tokenizer.decode(t) for t in id_lists(some)], pa.string())

    return decode


class CodepointTokenizer:
    """Code points as ids: the smallest tokenizer that decodes what it encodes."""

    eos_token_id = 0

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))
