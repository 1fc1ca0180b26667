"""Repeated passages by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document of a
smaller id.  Documents of equal text are one entry of the collection under their smallest
id.  Two equal strings of ``LENGTH`` bytes have the same minimiser (the smallest hash of their
``SEED`` byte runs), so

1. blocks of documents send the distinct minimisers they have to the task that owns them,
   and get back which of them others have too; the runs of strings under those are stored with the block;
2. every maximal run of strings under such a shared minimiser goes to its owner, as a
   piece of text with the smallest id it has in the block; where the pieces of a minimiser
   come to more than ``GROUP_BYTES``, its strings are keyed by the hash of all their bytes
   instead, which equal strings share: the blocks learn in a round of its own which
   of them others have too, and every such string goes to its own owner as a piece;
3. an owner takes the pieces of a minimiser that differ, puts all runs of strings whose hash it has
   more than once into shards, sorts the rotations of
   each shard into its transform, and merges the shards: the interleave of the shards is
   refined by the symbols that their transforms hold before each suffix, ``STEP`` at a time,
   until it is right to ``LENGTH`` symbols.  Rows that no refinement told apart are a repeated
   interval with a common prefix of ``LENGTH``; its smallest id decides for all its rows;
4. the blocks get a bit per string back and cut the covered bytes out.

Texts are UTF-8 bytes; matches never cross documents.  Null and empty texts lose nothing;
rows of equal id do not remove each other's bytes; a null id comes before any other; an
empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import forget, materialize, partitions, release, table
from inlay.llm.words import _VALUES, INVERSE, blocks, mix, powers

LENGTH = 50
SEED = 20
SHARD_BYTES = 1 << 17
GROUP_BYTES = 1 << 20  # pieces merged at a time, and the most that meet under one minimiser
UNIT = 2 * LENGTH - SEED  # bytes of the usual piece: the strings around one minimiser
BLOCK_BYTES = 1 << 20
WINDOW = 1 << 14  # strings whose minimisers are looked for at a time, so that the arrays stay in a cache
STEP = LENGTH // 2  # symbols of a refinement; two make a string
NULL_ID = -(1 << 63)
CODEC = "zstd"  # texts are packed wherever they are stored or moved
BLOCKS = "block bigint, ids array<bigint>, starts array<bigint>, data binary"
KEPT = BLOCKS + ", n_heavy int, n_groups int, groups binary"
RESULT = "digest binary, first bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over every run of ``width`` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = take(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = take(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])
    return out


def sums_of(data: np.ndarray) -> np.ndarray:
    """Prefix sums that :func:`hashes_of` takes hashes of bytes from."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * powers(len(data)), out=sums[1:])
    return sums


def hashes_of(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[begin]) * powers(len(sums), INVERSE)[begin])


def strings_of(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all strings of some runs."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; ``np.unique`` hashes them first, which takes ten times as long."""
    values = np.sort(values)
    return values[changes(values)]


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def places_in_order(values: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit hashes: sorted with their places in the low bits, which is much faster than ``argsort``."""
    index = len(values).bit_length()
    low = np.uint64((1 << index) - 1)
    order = (np.sort(values & ~low | np.arange(len(values), dtype=np.uint64)) & low).astype(np.int64)
    ordered = values[order]
    if (ordered[1:] < ordered[:-1]).any():  # different hashes with equal high bits
        return np.argsort(values, kind="stable")
    return order


def least_seeds(data: np.ndarray) -> np.ndarray:
    """For every string of ``LENGTH`` bytes the smallest hash of its seeds."""
    n = len(data) - LENGTH + 1
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, WINDOW):
            b = min(a + WINDOW, n)
            sums = sums_of(data[a : b + LENGTH - 1])
            seeds = sums[SEED:] - sums[:-SEED]
            seeds *= powers(len(sums), INVERSE)[: len(seeds)]
            out[a:b] = sliding(seeds, LENGTH - SEED + 1, np.minimum)
    return out


def minimisers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``LENGTH`` bytes grouped by minimiser: first string, number of strings and hash of each group.

    A group is a maximal run of strings of one document with one minimiser.
    """
    none = np.zeros(0, np.int64)
    # a string that would leave its document doesn't count
    whole = np.diff(starts) >= LENGTH
    if not whole.any():
        return none, none, np.zeros(0, np.uint64)
    first, stop = starts[:-1][whole], starts[1:][whole] - LENGTH + 1
    least = least_seeds(data)
    new = changes(least)
    new[first] = True
    begin = np.flatnonzero(new)
    doc = np.searchsorted(first, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(least)), stop[doc])
    inside = (doc >= 0) & (begin < end)
    begin = begin[inside]
    return begin, end[inside] - begin, mix(least[begin])


def places_before(before: np.ndarray, symbols: int) -> np.ndarray:
    """For each place the place ``symbols`` before it."""
    jump, step = np.arange(len(before)), before
    while symbols:
        if symbols & 1:
            jump = step[jump]
        symbols >>= 1
        if symbols:
            step = step[step]
    return jump


def dense(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ranks, without gaps, of keys of so many bits."""
    n = len(keys)
    index = n.bit_length()
    if bits + index <= 64:
        packed = np.sort(keys << np.uint64(index) | np.arange(n, dtype=np.uint64))
        order, keys = (packed & np.uint64((1 << index) - 1)).astype(np.int64), packed >> np.uint64(index)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(changes(keys)) - 1
    return out


def runs_before(before: np.ndarray, codes: np.ndarray, bits: int, symbols: int) -> np.ndarray:
    """The rank of the ``symbols`` symbols before each place, in the order of the text.

    What doesn't fit a sort key is ranked by the ranks of two halves, which overlap if ``symbols`` is odd.
    """
    n = len(codes)
    if symbols * bits + n.bit_length() <= 64 or symbols == 1:
        key, at = np.zeros(n, np.uint64), before
        for k in range(symbols):
            key |= codes[at].astype(np.uint64) << np.uint64(k * bits)
            at = before[at]
        return dense(key, symbols * bits)
    half = (symbols + 1) // 2
    ranks = runs_before(before, codes, bits, half).astype(np.uint64)
    width = int(ranks.max()).bit_length()
    return dense(ranks[places_before(before, symbols - half)] << np.uint64(width) | ranks, 2 * width)


def stable_order(ranks: np.ndarray) -> np.ndarray:
    """Places in stable order of ``ranks`` below 2**31."""
    packed = ranks.astype(np.uint64) << np.uint64(32) | np.arange(len(ranks), dtype=np.uint64)
    return (np.sort(packed) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def transform(rows: np.ndarray, jump: np.ndarray, ranks: np.ndarray, steps: int) -> np.ndarray:
    """The places of a shard in the order of their rotations; the ranks before them are its transform."""
    for _ in range(steps):
        rows = jump[rows[stable_order(ranks[rows])]]
    return rows


def merged(shards: list[np.ndarray], refinements: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave sorted shards; all places in order, and the group of equal prefixes each belongs to.

    The interleave starts shard after shard.  A refinement takes the ranks of the symbols before
    each row, each shard's in the order of its transform, and sorts stably by them: what was
    right to ``k`` symbols becomes right to as many more as the ranks stand for, and neighbours
    stay in a group if they had the same rank and came from one group.
    """
    kind = np.uint16 if len(shards) < 1 << 16 else np.int64
    shard = np.repeat(np.arange(len(shards), dtype=kind), [len(r) for r in shards])
    rows = np.concatenate(shards)
    group = np.zeros(len(shard), np.int64)
    for ranks in refinements:
        now = np.empty(len(rows), ranks.dtype)
        now[np.argsort(shard, kind="stable")] = ranks[rows]
        order = stable_order(now)
        shard, now, group = shard[order], now[order], group[order]
        new = np.zeros(len(shard), bool)
        new[1:] = (now[1:] != now[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
    out = np.empty_like(rows)
    out[np.argsort(shard, kind="stable")] = rows
    return out, group


def smallest_ids(pieces: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For every string of ``LENGTH`` bytes of each piece, the smallest id of a piece that has it."""
    size = np.array([len(p) + 1 for p in pieces])
    end = np.cumsum(size)
    begin = end - size
    text = np.zeros(int(end[-1]), np.int64)  # a piece ends with symbol 0
    inner = np.ones(len(text), bool)
    inner[end - 1] = False
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    code = np.cumsum(np.bincount(raw, minlength=256) > 0)
    text[inner] = code[raw]
    before = np.arange(-1, len(text) - 1)
    before[begin] = end - 1
    bits = int(code[-1]).bit_length()
    ranks = runs_before(before, text, bits, STEP)
    jump, steps = places_before(before, STEP), LENGTH // STEP
    # whole pieces to shards of about SHARD_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(begin // SHARD_BYTES)) + 1, [len(pieces)]])
    edges = np.append(begin, end[-1])[cuts]
    shards = [transform(np.arange(a, b), jump, ranks, steps) for a, b in zip(edges[:-1], edges[1:])]
    rows, group = merged(shards, [ranks] * steps)
    owner = np.repeat(np.arange(len(pieces)), size)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    best = np.minimum.reduceat(ids[owner[rows]], starts)
    found = np.empty(len(text), np.int64)
    found[rows] = best[group]
    return [found[a : b - LENGTH] for a, b in zip(begin.tolist(), end.tolist())]


def least_ids(pieces: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For the strings of all pieces in turn, the smallest id of a piece that has the string.

    A string whose hash no other has is in its piece alone.  All others are cut out in maximal runs and merged.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    strings = size - LENGTH + 1
    raw = b"".join(pieces)
    at = strings_of(np.cumsum(size) - size, strings)
    hashes = hashes_of(sums_of(np.frombuffer(raw, np.uint8)), at, at + LENGTH)
    order = places_in_order(hashes)
    new = changes(hashes[order])
    again = np.empty(len(at), bool)
    again[order] = ~(new & np.append(new[1:], True))
    piece = np.repeat(np.arange(len(pieces)), strings)
    begin = np.flatnonzero(changes(again) | changes(piece))
    number = np.diff(begin, append=len(at))[again[begin]]
    begin = begin[again[begin]]
    found = np.repeat(ids, strings)
    if len(begin):
        ends = (at[begin] + number + LENGTH - 1).tolist()
        runs = [raw[a:b] for a, b in zip(at[begin].tolist(), ends)]
        found[strings_of(begin, number)] = np.concatenate(smallest_ids(runs, ids[piece[begin]]))
    return found


def blocked(docs: DataFrame) -> DataFrame:
    """Blocks of distinct texts ``docs(id, digest, body)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK_BYTES):
                ids = batch.column(0).slice(block.first, len(block)).to_pylist()
                raw = block.data.tobytes()
                name = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                values = ([name], [ids], [block.starts], [pa.compress(raw, CODEC, asbytes=True)])
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["a", "b", "c", "d"])

    return docs.select("id", "body").mapInArrow(run, BLOCKS)


def opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    name, ids, starts, data = (batch.column(c)[i].as_py() for c in range(4))
    return name, np.array(ids, np.int64), np.array(starts, np.int64), np.frombuffer(unpacked(data, starts[-1]), np.uint8)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, CODEC, asbytes=True) if size else b""


def bounds(own: np.ndarray, owners: int) -> np.ndarray:
    """Where the hashes of each owner begin in ``own``, which is sorted: owners share out the high halves."""
    owner = (own >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))


def owned(hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by owner, and where each owner's begin."""
    own = distinct(hashes)
    return own, bounds(own, owners)


def flagged(hashes: np.ndarray, parts: list[dict], field: str, owners: int) -> np.ndarray:
    """For each hash, the flag that the owner of its key has answered in ``field``."""
    order = places_in_order(hashes)
    new = changes(hashes[order])
    at = bounds(hashes[order][new], owners)
    flags = np.zeros(at[-1], bool)
    for part in parts:
        o = part["owner"]
        if part[field]:
            flags[at[o] : at[o + 1]] = np.unpackbits(np.frombuffer(part[field], np.uint8), count=at[o + 1] - at[o])
    out = np.empty(len(hashes), bool)
    out[order] = flags[np.cumsum(new) - 1]
    return out


class Kept(NamedTuple):
    """Groups of a block under shared minimisers: first string, number of strings, hash, and whether the minimiser is heavy."""

    begin: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    heavy: np.ndarray

    def packed(self) -> bytes:
        raw = np.diff(self.begin, prepend=0).astype("<u4"), self.count.astype("<u4"), self.hashes, np.packbits(self.heavy)
        return pa.compress(b"".join(a.tobytes() for a in raw), CODEC, asbytes=True)


def unpacked_groups(data: bytes, n: int) -> Kept:
    raw = unpacked(data, 16 * n + (n + 7) // 8)
    gaps, count = np.frombuffer(raw, "<u4", 2 * n).astype(np.int64).reshape(2, n)
    heavy = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n).astype(bool)
    return Kept(np.cumsum(gaps), count, np.frombuffer(raw, np.uint64, n, 8 * n), heavy)


def shared_groups(data: np.ndarray, starts: np.ndarray, shared: list[dict], owners: int) -> Kept:
    begin, count, hashes = minimisers(data, starts)
    here = flagged(hashes, shared, "bits", owners)
    heavy = np.zeros(len(here), bool)
    if any(part["heavy"] for part in shared):
        heavy = flagged(hashes, shared, "heavy", owners)
    return Kept(begin[here], count[here], hashes[here], heavy[here])


def kept_groups(joined: DataFrame, owners: int) -> DataFrame:
    """The blocks with their groups under shared minimisers, which every later step reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = []
            for i in range(batch.num_rows):
                _, _, starts, data = opened(batch, i)
                groups.append(shared_groups(data, starts, batch.column(4)[i].as_py() or [], owners))
            found = [
                pa.array([int(g.heavy.sum()) for g in groups], pa.int32()),
                pa.array([len(g.begin) for g in groups], pa.int32()),
                pa.array([g.packed() for g in groups], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *found], [f"c{k}" for k in range(7)])

    return joined.mapInArrow(run, KEPT)


def heavy_strings(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the strings of ``LENGTH`` bytes of some groups."""
    at = strings_of(begin, count)
    return at, hashes_of(sums_of(data), at, at + LENGTH) if len(at) else np.zeros(0, np.uint64)


def shared_keys(blocks_: DataFrame, owners: int, strings: bool = False) -> DataFrame:
    """``(block, owner, bits, heavy)``: which of the block's distinct minimisers occur in several documents.

    ``heavy`` are the shared ones whose pieces come to more than ``GROUP_BYTES``, each
    block's distinct ones counted; it is empty where none is.  With ``strings`` the keys are
    the hashes of the strings under the heavy minimisers of ``blocks_``, which have their groups.
    """
    most = GROUP_BYTES // UNIT

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, _, starts, data = opened(batch, i)
                if strings:
                    kept = unpacked_groups(batch.column(6)[i].as_py(), batch.column(5)[i].as_py())
                    begin, hashes = heavy_strings(data, kept.begin[kept.heavy], kept.count[kept.heavy])
                else:
                    begin, count, hashes = minimisers(data, starts)
                order = places_in_order(hashes)
                first = np.flatnonzero(changes(hashes[order]))
                number = np.diff(first, append=len(order))
                own = hashes[order[first]]
                at = bounds(own, owners)
                row = (np.searchsorted(starts, begin, "right") - 1)[order]
                many = row[first] != row[first + number - 1]
                units = np.ones(len(own), np.int64)
                if not strings and len(own):
                    size = -(-(count + LENGTH - 1) // UNIT)[order]
                    twice = np.flatnonzero(np.repeat(number > 1, number))
                    if len(twice):  # equal pieces count once
                        raw, seen = data.tobytes(), set()
                        a, b = begin[order[twice]], (begin + count)[order[twice]] + LENGTH - 1
                        for k, piece in zip(twice.tolist(), (raw[x:y] for x, y in zip(a.tolist(), b.tolist()))):
                            if piece in seen:
                                size[k] = 0
                            seen.add(piece)
                    units = np.add.reduceat(size, first)
                units = np.minimum(units, 0xFFFF).astype("<u2")
                some = np.flatnonzero(np.diff(at))
                short = (own & np.uint64(0xFFFFFFFF)).astype("<u4")  # equal halves of different hashes only cost a closer look
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([name] * len(some), pa.int64()),
                        pa.array([short[at[o] : at[o + 1]].tobytes() for o in some], pa.binary()),
                        pa.array([np.packbits(many[at[o] : at[o + 1]]).tobytes() for o in some], pa.binary()),
                        # nearly all are 1
                        pa.array([b"" if (u := units[at[o] : at[o + 1]]).max() == 1 else u.tobytes() for o in some], pa.binary()),
                    ],
                    ["a", "b", "c", "d", "e"],
                )

    def answer(owner: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(r[1], "<u4") for r in rows]
        many = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(p)) for r, p in zip(rows, parts)])
        units = np.concatenate([np.frombuffer(r[3], "<u2") if r[3] else np.ones(len(p), "<u2") for r, p in zip(rows, parts)])
        place = dense(np.concatenate(parts).astype(np.uint64), 32)
        shared = (np.bincount(place) > 1) | (np.bincount(place, many) > 0)
        heavy = shared & (np.bincount(place, units) > most)
        stops = np.cumsum([len(p) for p in parts])[:-1]
        cut, large = np.split(shared[place], stops), np.split(heavy[place], stops)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([owner] * len(rows), pa.int32()),
                pa.array([np.packbits(c).tobytes() for c in cut], pa.binary()),
                pa.array([np.packbits(c).tobytes() if c.any() and not strings else b"" for c in large], pa.binary()),
            ],
            ["a", "b", "c", "d"],
        )

    sent = blocks_.mapInArrow(send, "owner int, block bigint, hashes binary, many binary, units binary")
    return by_owner(sent, answer, "block bigint, owner int, bits binary, heavy binary")


def by_owner(sent: DataFrame, answer, schema: str) -> DataFrame:
    """Run ``answer(owner, rows)`` over the rows of each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, rows = None, []
        for batch in batches:
            for o, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if o != owner and rows:
                    yield answer(owner, rows)
                    rows = []
                owner = o
                rows.append(row)
        if rows:
            yield answer(owner, rows)

    return sent.repartition("owner").sortWithinPartitions("owner", "block").mapInArrow(run, schema)


class Groups:
    """Groups of a block under shared minimisers, or shared strings of heavy ones, with equal pieces of text put together."""

    def __init__(self, ids, starts, data, shared: list[dict] | Kept, owners: int, strings: list[dict]):
        kept = shared if isinstance(shared, Kept) else shared_groups(data, starts, shared, owners)
        self.begin, self.count, self.hashes = kept[:3]
        if kept.heavy.any():
            light, heavy = ~kept.heavy, kept.heavy
            at, keys = heavy_strings(data, self.begin[heavy], self.count[heavy])
            also = flagged(keys, strings, "bits", owners)
            self.begin, self.count = np.append(self.begin[light], at[also]), np.append(self.count[light], np.ones(also.sum(), np.int64))
            self.hashes = np.append(self.hashes[light], keys[also])
        self.ids = ids[np.searchsorted(starts, self.begin, "right") - 1]
        raw = data.tobytes()
        known: dict[bytes, int] = {}
        ends = (self.begin + self.count + LENGTH - 1).tolist()
        self.piece = np.array([known.setdefault(raw[b:e], len(known)) for b, e in zip(self.begin.tolist(), ends)], np.int64)
        self.pieces = list(known)
        self.size = np.zeros(len(self.pieces), np.int64)
        self.size[self.piece] = self.count + LENGTH - 1
        self.least = np.full(len(self.pieces), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.piece, self.ids)
        self.hash = np.zeros(len(self.pieces), np.uint64)
        self.hash[self.piece] = self.hashes
        # by owner, then by minimiser
        self.order = places_in_order(self.hash)
        self.at = bounds(self.hash[self.order], owners)


def groups_of(batch: pa.RecordBatch, i: int, owners: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, Groups]:
    """Name, ids, starts, bytes and groups of a block from :func:`kept_groups`, with what is known of its heavy strings."""
    name, ids, starts, data = opened(batch, i)
    kept = unpacked_groups(batch.column(6)[i].as_py(), batch.column(5)[i].as_py())
    return name, ids, starts, data, Groups(ids, starts, data, kept, owners, batch.column(7)[i].as_py() or [])


def earlier_strings(joined: DataFrame, owners: int) -> DataFrame:
    """``(block, owner, bits)``: for the block's pieces of an owner, which strings a smaller id has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, _, _, _, g = groups_of(batch, i, owners)
                some = np.flatnonzero(np.diff(g.at))
                cut = [g.order[g.at[o] : g.at[o + 1]] for o in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([name] * len(some), pa.int64()),
                        pa.array([g.hash[c].tobytes() for c in cut], pa.binary()),
                        pa.array([g.least[c].tobytes() for c in cut], pa.binary()),
                        pa.array([g.size[c].astype("<u4").tobytes() for c in cut], pa.binary()),
                        pa.array([pa.compress(b"".join([g.pieces[p] for p in c]), CODEC, asbytes=True) for c in cut], pa.binary()),
                    ],
                    [f"c{k}" for k in range(6)],
                )

    def answer(owner: int, rows: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        least = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
        sizes = [np.frombuffer(r[3], "<u4") for r in rows]
        texts = []
        for r, s in zip(rows, sizes):
            ends = np.cumsum(s, dtype=np.int64).tolist()
            whole = unpacked(r[4], ends[-1])
            texts += [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        # equal pieces of different blocks are one piece
        known: dict[bytes, int] = {}
        piece = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
        pieces = list(known)
        ids = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(ids, piece, least)
        kind = np.zeros(len(pieces), np.uint64)
        kind[piece] = hashes
        length = np.array([len(p) for p in pieces])
        strings = length - LENGTH + 1
        place = np.concatenate([[0], np.cumsum(strings)])
        found = np.repeat(ids, strings)  # where nothing differs under a minimiser
        order = np.argsort(kind, kind="stable")
        starts = np.concatenate([[0], np.flatnonzero(kind[order][1:] != kind[order][:-1]) + 1])
        ends = np.append(starts[1:], len(order))
        several = np.flatnonzero(ends - starts > 1)
        bytes_to = np.concatenate([[0], np.cumsum(length[order])])
        total = np.cumsum((bytes_to[ends] - bytes_to[starts])[several])
        for part in np.split(several, np.flatnonzero(np.diff(total // GROUP_BYTES)) + 1):
            if len(part):
                mine = order[strings_of(starts[part], (ends - starts)[part])]
                values = least_ids([pieces[p] for p in mine.tolist()], ids[mine])
                found[strings_of(place[mine], strings[mine])] = values
        at, out = 0, []
        for s in sizes:
            mine = piece[at : at + len(s)]
            n = strings[mine]
            each = strings_of(place[mine], n)
            out.append(np.packbits(found[each] < np.repeat(least[at : at + len(s)], n)).tobytes())
            at += len(s)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([owner] * len(rows), pa.int32()), pa.array(out, pa.binary())],
            ["a", "b", "c"],
        )

    schema = "owner int, block bigint, hashes binary, least binary, sizes binary, texts binary"
    return by_owner(joined.mapInArrow(send, schema), answer, "block bigint, owner int, bits binary")


def covered(g: Groups, answers: dict[int, bytes], n_bytes: int) -> np.ndarray:
    """Where covered bytes begin (above 0) and end (below 0), from the owners' bits per string."""
    strings = g.size - LENGTH + 1
    ends = np.concatenate([[0], np.cumsum(strings[g.order])])
    bits = np.zeros(int(ends[-1]), bool)
    for o, packed in answers.items():
        first, last = int(ends[g.at[o]]), int(ends[g.at[o + 1]])
        bits[first:last] = np.unpackbits(np.frombuffer(packed, np.uint8), count=last - first)
    place = np.empty(len(g.pieces), np.int64)
    place[g.order] = ends[:-1]
    whole = g.ids > g.least[g.piece]  # the block itself has the piece in an earlier document
    begin, count, piece = g.begin[~whole], g.count[~whole], g.piece[~whole]
    at = strings_of(begin, count)[bits[strings_of(place[piece], count)]]
    opening = np.append(g.begin[whole], at)
    closing = np.append((g.begin + g.count)[whole] + LENGTH - 1, at + LENGTH)
    return np.bincount(opening, minlength=n_bytes + 1) - np.bincount(closing, minlength=n_bytes + 1)


def sums_at(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])


def cut_out(joined: DataFrame, owners: int, with_text: bool) -> DataFrame:
    """Per text of the blocks: what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, starts, data, g = groups_of(batch, i, owners)
                edge = covered(g, {a["owner"]: a["bits"] for a in batch.column(8)[i].as_py() or []}, len(data))
                gone = np.cumsum(edge[:-1]) > 0
                removed = sums_at(gone, starts)
                opening = gone.copy()
                opening[1:] &= ~gone[:-1]
                inner = starts[:-1][np.diff(starts) > 0]
                opening[inner] = gone[inner]
                out = []
                texts = zip(ids.tolist(), starts[:-1].tolist(), starts[1:].tolist(), removed.tolist(), sums_at(opening, starts).tolist())
                for first, a, b, n, spans in texts:
                    text = data[a:b].tobytes()
                    left = data[a:b][~gone[a:b]].tobytes() if n else text
                    digest = hashlib.sha256(text)
                    row = (digest.digest(), first, b - a, n, spans, (hashlib.sha256(left) if n else digest).hexdigest())
                    out.append((*row, left) if with_text else row)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f"c{k}" for k in range(len(out[0]))])

    return joined.mapInArrow(run, RESULT + (", kept binary" if with_text else ""))


def without_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``."""
    spark = docs.sparkSession
    owners = partitions(spark)
    body = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id")
    rows = docs.select("doc_id", key, body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    first = rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("body").alias("body"))
    store = materialize(blocked(first), "blocks")
    release(spark)
    shared = materialize(shared_keys(store, owners), "shared")
    release(spark)
    lists = shared.groupBy("block").agg(F.collect_list(F.struct("owner", "bits", "heavy")).alias("shared"))
    kept = materialize(kept_groups(store.join(lists, "block", "left"), owners), "kept")
    forget(store)
    release(spark)
    heavy = kept.where("n_heavy > 0")
    if heavy.isEmpty():
        met = kept.withColumn("strings", F.lit(None).cast("array<struct<owner: int, bits: binary>>"))
    else:
        own = materialize(shared_keys(heavy, owners, strings=True), "strings")
        release(spark)
        met = kept.join(own.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("strings")), "block", "left")
    answers = materialize(earlier_strings(met, owners), "earlier")
    release(spark)
    found = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("found"))
    both = met.join(found, "block", "left")
    results = materialize(cut_out(both, owners, with_text), "cut")
    release(spark)
    # a row with a larger id than the first of its text loses every byte, if it has LENGTH of them
    named = rows.select("doc_id", "id", "digest").join(results, "digest")
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return named.select(*columns)


@queries.query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_passages(table(spark, folder, "documents", "doc_id", "text"))
