"""Line de-duplication by an exact set-similarity join.

A line's set holds its distinct words (A-Z folded).  A line goes where an earlier line, in
order of document id and line number, has a Jaccard similarity of ``SIMILAR`` percent or
more with it; earlier lines count whether they go themselves or not.

Lines of equal sets form a class under their first line, so only classes are joined.  Words
are ordered by rarity: by the level of their count in a table of ``1 << COUNT_BITS`` hashed
counters over all lines, then by hash, which is one order for all lines.  Two similar
lines share a word of their prefixes in that order; the place of the word, the sizes and
a bit signature bound the overlap, and what passes is verified on the words of the lines.
Most copies are settled by a first round against the earliest line of each word; later
lines are then compared only where they are not settled yet.  Lists of frequent words are
dealt over several tasks.

Lines without words stay.  Rows of equal id and text are judged alike; rows of equal id and
different texts are documents of their own, in order of the SHA-256 of their texts.  A null id comes before any other;
null and empty texts have no lines; an empty table stays empty; other columns are passed
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import free_name, materialize, partitions, release, table
from inlay.llm.words import Block, blocks, mix, split, utf8
from inlay.operators.scan import ordered_scan

SIMILAR = 80  # percent
COUNT_BITS = 22
LEVELS = 8  # levels of rarity for each doubling of a count
LIST_ROWS = 50_000  # a word of a larger count has its list dealt over several tasks
QUICK_WORDS = 4  # words of the prefix that the first round looks at
LINES = "id bigint, line int, n int, d0 bigint, d1 bigint, marks binary"
SIGNED = 5  # numbers of four bytes that a signature takes
FILTER_BITS = 25
WORD = r"[^\x20\x09-\x0D]"  # what a line with words has
OWNER_BYTES = 1 << 22  # postings that are compared in one go
TEXT_BYTES = 1 << 18  # text split at a time: its arrays of eight bytes a character stay in the processor's cache
FLUSH_LINES = 1 << 16  # lines that leave a task together, each of their sets once
DEALT = 1 << 18  # postings dealt to owners together
PAIRS = 1 << 19  # pairs compared together


def lines_of(block: Block) -> tuple[Block, np.ndarray, np.ndarray]:
    """The lines of a block as texts, with the row of each and its number in it."""
    breaks = np.flatnonzero(block.data == 10) + 1
    # a row that ends with a line feed, or is empty, has an empty last line that holds no words
    starts = np.unique(np.concatenate([block.starts, breaks]))
    cut = Block(block.first, starts, block.data)
    row = np.searchsorted(block.starts, starts[:-1], "right") - 1
    first = np.searchsorted(starts, block.starts[row])
    return cut, row, np.arange(len(cut)) - first


def distinct_words(cut: Block, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of all lines, line by line from rare to frequent, and where each line begins."""
    words = split(cut)
    line = np.repeat(np.arange(len(cut)), np.diff(words.at))
    rarity = np.zeros(len(line), np.uint8)
    if level is not None:
        rarity = level[(words.hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int32)]
    told_apart = len(cut) <= 1 << 16
    if told_apart:  # line, rarity and the upper forty bits of the hash in one sort key
        key = line.astype(np.uint64) << np.uint64(48) | rarity.astype(np.uint64) << np.uint64(40) | words.hashes >> np.uint64(24)
        order = np.argsort(key)
        key, hashes = key[order], words.hashes[order]
        same = hashes[1:] == hashes[:-1]
        told_apart = not ((key[1:] == key[:-1]) & ~same).any()
    if not told_apart:
        order = np.lexsort((words.hashes, rarity, line))
        hashes = words.hashes[order]
        same = hashes[1:] == hashes[:-1]
    line = line[order]
    new = np.ones(len(order), bool)
    new[1:] = ~same | (line[1:] != line[:-1])
    hashes, line = hashes[new], line[new]
    return hashes, np.searchsorted(line, np.arange(len(cut) + 1))


def cut_up(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of the bytes of consecutive runs of ``values``, of which run ``i`` ends before ``ends[i]``."""
    at = (np.append(0, ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def word_levels(docs: DataFrame) -> np.ndarray:
    """Rarity level per hashed counter, from the words of all lines; 0 where only one line can have it."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << COUNT_BITS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for block in blocks(batch.column(0), TEXT_BYTES):
                held.append((split(block).hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64))
                if sum(map(len, held)) > 1 << 22:
                    totals += np.bincount(np.concatenate(held), minlength=len(totals))
                    held = []
        if held:
            totals += np.bincount(np.concatenate(held), minlength=len(totals))
        some = np.flatnonzero(totals)
        if len(some):
            ends = np.searchsorted(some, np.arange(1, len(totals) // chunk + 1) * chunk)
            # counters of one task fit 32 bits: it reads one split
            counts = np.minimum(totals[some], 0xFFFFFFFF).astype("<u4")
            arrays = [pa.array(np.arange(len(ends))), cut_up((some % chunk).astype("<u2"), ends), cut_up(counts, ends)]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, raw in zip(*(column.to_pylist() for column in batch.columns)):
                # a counter comes once in a row
                totals.setdefault(c, np.zeros(chunk, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(raw, "<u4")
        for c, total in totals.items():
            level = np.where(total <= 1, 0, np.minimum(255, 1 + np.log2(np.maximum(total, 1)) * LEVELS))
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([level.astype(np.uint8).tobytes()])], ["chunk", "levels"])

    parts = docs.select("text").mapInArrow(count, "chunk bigint, at binary, counts binary").repartition("chunk")
    level = np.zeros(1 << COUNT_BITS, np.uint8)
    for at, raw in parts.mapInArrow(add, "chunk bigint, levels binary").collect():
        level[at * chunk : at * chunk + len(raw)] = np.frombuffer(raw, np.uint8)
    return level


def needed(n: np.ndarray, similar: int) -> np.ndarray:
    """Words that a line of ``n`` words must share with one similar to it."""
    return -(-similar * n // 100)


def list_parts(level: np.ndarray, list_rows: int) -> np.ndarray:
    """Tasks over which the lists of words of a level are dealt."""
    return np.maximum(1, np.ceil(2.0 ** ((level.astype(float) - 1) / LEVELS) / list_rows)).astype(np.int64)


def packed(signature: np.ndarray, each: np.ndarray, lists: list[np.ndarray]) -> pa.Array:
    """A binary value for each line: its row of ``signature``, then its run of every list, of ``each`` numbers."""
    sizes = SIGNED + len(lists) * each
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
    begin = ends - sizes
    out[begin[:, None] + np.arange(SIGNED)] = signature
    row = np.repeat(np.arange(len(each)), each)
    at = begin[row] + SIGNED + np.arange(len(row)) - (np.cumsum(each) - each)[row]
    for numbers in lists:
        out[at] = numbers
        at += each[row]
    return cut_up(out, ends)


def unpacked_marks(column: pa.Array, lists: int, most: int | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What :func:`packed` took, but the first ``most`` numbers of a run only: signatures, the row of each number, the lists."""
    ends, data = utf8(column)
    numbers = np.frombuffer(data.tobytes(), "<u4")
    begin = ends[:-1] // 4
    each = (np.diff(ends) // 4 - SIGNED) // lists
    taken = each if most is None else np.minimum(each, most)
    row = np.repeat(np.arange(len(each)), taken)
    at = begin[row] + SIGNED + np.arange(len(row)) - (np.cumsum(taken) - taken)[row]
    return numbers[begin[:, None] + np.arange(SIGNED)], row, [numbers[at + i * each[row]] for i in range(lists)]


def described(docs: DataFrame, level: np.ndarray, similar: int) -> DataFrame:
    """``LINES`` of ``docs(id, text)``: every line with words, unless the same rows give an earlier one of the same words."""
    shared = docs.sparkSession.sparkContext.broadcast(level)
    dealt_over = list_parts(np.arange(256), LIST_ROWS).astype("<u4")

    def of_block(ids: np.ndarray, block: Block, levels: np.ndarray) -> list[np.ndarray] | None:
        """Columns of ``LINES`` but the last, signatures, and the number of words, with the words, places and parts of all lines."""
        cut, row, number = lines_of(block)
        hashes, at = distinct_words(cut, levels)
        size = np.diff(at)
        full = np.flatnonzero(size)
        if not len(full):
            return None
        begin, size = at[full], size[full]
        with np.errstate(over="ignore"):
            spread = mix(hashes + np.uint64(1))
            d0 = np.add.reduceat(spread, begin)
            d1 = np.add.reduceat((spread ^ spread >> np.uint64(31)) * np.uint64(0x5851F42D4C957F2D), begin)
        # parities of 128 hashed cells, and of 32 others: sets differ in at least as many words as in cells
        cell, half = np.uint64(1) << (hashes & np.uint64(63)), (hashes & np.uint64(64)) > 0
        bits = np.bitwise_xor.reduceat(np.where(half, np.uint64(0), cell), begin)
        more = np.bitwise_xor.reduceat(np.where(half, cell, np.uint64(0)), begin)
        other = np.bitwise_xor.reduceat(np.uint64(1) << (hashes >> np.uint64(7) & np.uint64(31)), begin)
        signature = np.column_stack([bits.view("<u4").reshape(-1, 2), more.view("<u4").reshape(-1, 2), other.astype("<u4")])
        prefix = size - needed(size, similar) + 1
        stops = np.cumsum(prefix)
        place = np.arange(stops[-1]) - np.repeat(stops - prefix, prefix)
        front = hashes[np.repeat(begin, prefix) + place]
        own = levels[(front >> np.uint64(64 - COUNT_BITS)).astype(np.int32)]
        taken = own > 0  # at 0 no other line has the word
        held = np.diff(np.append(0, np.cumsum(taken)[stops - 1]))
        keys = (front[taken] & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts = dealt_over[own[taken]]
        columns = [ids[block.first + row[full]], number[full].astype(np.int32), size.astype(np.int32), d0, d1, signature]
        return [*columns, held, keys, place[taken].astype("<u4"), parts]

    def flushed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, line, n, d0, d1, signature, counts, *lists = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((line, ids, n, d1, d0))
        new = np.ones(len(order), bool)
        new[1:] = (d0[order][1:] != d0[order][:-1]) | (d1[order][1:] != d1[order][:-1]) | (n[order][1:] != n[order][:-1])
        keep = np.zeros(len(order), bool)
        keep[order[new]] = True
        each = np.repeat(keep, counts)
        arrays = [pa.array(c[keep]) for c in (ids, line, n, d0.view(np.int64), d1.view(np.int64))]
        arrays.append(packed(signature[keep], counts[keep], [c[each] for c in lists]))
        return pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, lines = shared.value, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), TEXT_BYTES):
                found = of_block(ids, block, levels)
                if found:
                    held.append(found)
                    lines += len(found[0])
                if lines > FLUSH_LINES:
                    yield flushed(held)
                    held, lines = [], 0
        if held:
            yield flushed(held)

    return docs.select("id", "text").mapInArrow(run, LINES)


FOUND = "id bigint, line int, apart int, eids array<bigint>, elines array<int>"
POSTING = np.dtype(
    [("word", "<u4"), ("part", "<u4"), ("place", "<u4"), ("n", "<u4"), ("line", "<u4"), ("id", "<i8"),
     ("bits", "<u8"), ("more", "<u8"), ("other", "<u4"), ("asks", "?"), ("offers", "?")]
)


def word_lists(classes: DataFrame, quick: bool, owners: int) -> DataFrame:
    """``(owner, postings)``: the postings of the word lists that belong to one task, packed by column.

    A list of a frequent word is cut into parts: a line offers itself in one of them and, if it
    is not ``done``, asks in all.
    """

    def postings(batch: pa.RecordBatch) -> np.ndarray:
        signature, row, (words, places, parts) = unpacked_marks(batch.column("marks"), 3, QUICK_WORDS if quick else None)
        p = np.zeros(len(row), POSTING)
        p["word"], p["place"] = words, places
        total = parts.astype(np.int64)
        for c in ("n", "line", "id"):
            p[c] = batch.column(c).to_numpy(zero_copy_only=False)[row]
        p["bits"], p["more"], p["other"] = (np.ascontiguousarray(signature[:, i:j]).view(k)[row, 0] for i, j, k in ((0, 2, "<u8"), (2, 4, "<u8"), (4, 5, "<u4")))
        done = batch.column("done").to_numpy(zero_copy_only=False).astype(bool)
        p["asks"], p["offers"] = ~done[row], True
        many = np.flatnonzero(total > 1)
        if len(many):
            own = place_key(p["id"][many].astype(np.int64), p["line"][many]) % total[many].astype(np.uint64)
            p["part"][many] = own
            many = many[p["asks"][many]]
            copies = np.repeat(many, total[many])
            extra = p[copies]
            extra["part"] = np.arange(len(copies)) - np.repeat(np.cumsum(total[many]) - total[many], total[many])
            extra["offers"] = False
            p = np.concatenate([p, extra[extra["part"] != p["part"][copies]]])
        return p

    def dealt(p: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            key = mix(p["word"].astype(np.uint64) | p["part"].astype(np.uint64) << np.uint64(32))
        owner = (key % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | p["word"])
        p, owner = p[order], owner[order]
        at = np.searchsorted(owner, np.arange(owners + 1))
        some = np.flatnonzero(np.diff(at))
        blobs = [b"".join(planes(p[c][at[i] : at[i + 1]]) for c in POSTING.names) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(postings(batch))
            if sum(map(len, held)) > DEALT:
                yield dealt(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield dealt(np.concatenate(held))

    return classes.select("n", "line", "id", "marks", "done").mapInArrow(run, "owner int, postings binary")


def planes(column: np.ndarray) -> bytes:
    """The bytes of a column, first all lowest ones: those of small numbers are runs of zeros that pack well."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def unpacked(blob: pa.Buffer) -> dict[str, np.ndarray]:
    n, at = blob.size // POSTING.itemsize, 0
    out = {}
    for name in POSTING.names:
        kind = POSTING[name]
        raw = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(raw.T).view(kind)[:, 0]
        at += n * kind.itemsize
    return out


def of_near_size(lists: np.ndarray, n: np.ndarray, asks: np.ndarray, similar: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list, the first of which asks, whose sizes allow similarity; rows are ordered by list and size.

    Two rows that ask meet in either order; rows that don't ask never meet each other.
    """
    key = lists << 32 | n
    asking = np.flatnonzero(asks)
    low = np.searchsorted(key, lists[asking] << 32 | -(-similar * n[asking] // 100))
    high = np.searchsorted(key, lists[asking] << 32 | np.minimum(100 * n[asking] // max(1, similar), (1 << 32) - 1), "right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(asking):
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + PAIRS, "right")))
        a = np.repeat(np.arange(at, stop), (high - low)[at:stop])
        b = np.arange(begin, ends[stop - 1]) - (ends - high)[a]
        yield asking[a], b
        at = stop


def similar_in_lists(lists: DataFrame, similar: int, quick: bool) -> DataFrame:
    """:data:`FOUND`: lines and the earlier ones that may be similar, by size, place of the shared word and signature.

    A quick pass looks at the earliest line of a list and at the one before.
    """

    def rows(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``(later, earlier, differing cells)`` of the pairs that may be similar."""
        n = x["n"]
        # the cheap test that few pairs pass comes first
        apart = np.bitwise_count(x["bits"][a] ^ x["bits"][b]).astype(np.int64)
        apart += np.bitwise_count(x["more"][a] ^ x["more"][b])
        total = n[a] + n[b]
        near = np.flatnonzero(apart * (100 + similar) <= total * (100 - similar))
        a, b, apart, total = a[near], b[near], apart[near], total[near]
        apart = np.maximum(apart, np.bitwise_count(x["other"][a] ^ x["other"][b]))
        near = np.flatnonzero(apart * (100 + similar) <= total * (100 - similar))
        a, b, apart, total = a[near], b[near], apart[near], total[near]
        na, nb, p, q = n[a], n[b], x["place"][a], x["place"][b]
        least = -(-similar * total // (100 + similar))
        reach = np.minimum(p, q) + 1 + np.minimum(na - p, nb - q) - 1
        earlier = (x["id"][b] < x["id"][a]) | (x["id"][b] == x["id"][a]) & (x["line"][b] < x["line"][a])
        good = earlier & (100 * np.minimum(na, nb) >= similar * np.maximum(na, nb)) & (reach >= least)
        good &= x["asks"][a] & x["offers"][b]
        return np.stack([a[good], b[good], apart[good].astype(np.int64)], axis=1)

    def emitted(x: dict[str, np.ndarray], found: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each line, with all that may be similar to it, the nearest first."""
        if len(found):
            a, b, apart = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))].T
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            ends = pa.array(np.append(first, len(a)).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x["id"][a[first]]),
                    pa.array(x["line"][a[first]].astype("i4")),
                    pa.array(apart[first].astype("i4")),
                    pa.ListArray.from_arrays(ends, pa.array(x["id"][b])),
                    pa.ListArray.from_arrays(ends, pa.array(x["line"][b].astype("i4"))),
                ],
                [f"c{i}" for i in range(5)],
            )

    def pairs_of(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {c: np.concatenate([h[c] for h in held]) for c in POSTING.names}
        inside = ("line", "id") if quick else ("n",)
        if not quick and not x["part"].any():
            order = np.argsort(x["word"].astype(np.uint64) << np.uint64(32) | x["n"])
        else:
            order = np.lexsort([x[c] for c in (*inside, "part", "word")])
        x = {c: v[order] for c, v in x.items()}
        x |= {c: x[c].astype(np.int64) for c in ("n", "place")}
        new = (x["word"][1:] != x["word"][:-1]) | (x["part"][1:] != x["part"][:-1])
        if quick:
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            first = np.repeat(starts, np.diff(np.append(starts, len(order))))
            every = np.arange(len(order))
            near = [rows(x, every, first), rows(x, every, np.maximum(every - 1, first))]
            yield from emitted(x, np.concatenate(near))
            return
        held_pairs: list[np.ndarray] = []
        for a, b in of_near_size(np.append(0, np.cumsum(new)), x["n"], x["asks"], similar):
            held_pairs.append(rows(x, a, b))
            if sum(map(len, held_pairs)) > 200_000:
                yield from emitted(x, np.concatenate(held_pairs))
                held_pairs = []
        if held_pairs:
            yield from emitted(x, np.concatenate(held_pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, []
        for batch in batches:
            for o, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if o != owner and held:
                    yield from pairs_of(held)
                    held = []
                owner = o
                held.append(unpacked(blob.as_buffer()))
        if held:
            yield from pairs_of(held)

    return lists.repartition("owner").sortWithinPartitions("owner").mapInArrow(run, FOUND)


def place_key(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(ids.view(np.uint64)) + line.astype(np.uint64))


def cells_of(ids: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """The cells of the filter that a line marks."""
    key, mask = place_key(ids, line), np.uint64((1 << FILTER_BITS) - 1)
    return [((key >> np.uint64(turn)) & mask).astype(np.int64) for turn in (0, 30)]


def filter_of(ends: DataFrame) -> np.ndarray:
    """Bloom filter of the lines at ``ends(ids, lines)``, two lists a row: it lets some other lines through, of any corpus."""
    chunk = 1 << 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.unique(np.concatenate(cells_of(*(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1)))))
            ends = np.searchsorted(cells, np.arange(1, (1 << FILTER_BITS) // chunk + 1) * chunk)
            if len(cells):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ends))), cut_up((cells % chunk).astype("<u2"), ends)], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(c, np.zeros(chunk, bool))[np.frombuffer(raw, "<u2")] = True
        for c, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(total).tobytes()])], ["a", "b"])

    schema = "chunk bigint, bits binary"
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for at, raw in ends.mapInArrow(mark, schema).repartition("chunk").mapInArrow(join, schema).collect():
        out[at * chunk // 8 : at * chunk // 8 + len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def line_texts(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, line, body)`` of the lines at the places ``ends(ids, lines)``, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), TEXT_BYTES):
                cut, row, number = lines_of(block)
                own = ids[block.first + row]
                one, two = (marks[cell >> 3] << (cell & 7) & 128 for cell in cells_of(own, number))
                some = np.flatnonzero((one & two > 0) & (np.diff(cut.starts) > 0))
                if len(some):
                    bodies = [cut.data[cut.starts[i] : cut.starts[i + 1]].tobytes().rstrip(b"\n") for i in some]
                    arrays = [pa.array(own[some]), pa.array(number[some].astype(np.int32)), pa.array(bodies, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "c"])

    # rows of equal id and text give the same lines
    return docs.select("id", "text").mapInArrow(run, "id bigint, line int, body binary").dropDuplicates(["id", "line"])


def bodies_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """:func:`line_texts` of all lines of :data:`FOUND`, stored."""
    ends = found.select(F.concat(F.array("id"), "eids").alias("ids"), F.concat(F.array("line"), "elines").alias("lines"))
    return materialize(line_texts(ends, docs), "bodies")


def verified(pairs: DataFrame, bodies: DataFrame, similar: int) -> DataFrame:
    """``(id, line)`` of the later lines of ``pairs(id, line, eid, eline)`` that are similar to the earlier one, word by word."""
    met = bodies.withColumnRenamed("body", "later").join(pairs.hint("merge"), ["id", "line"])
    met = bodies.selectExpr("id eid", "line eline", "body earlier").join(met.hint("merge"), ["eid", "eline"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = set(x.translate(fold).split()), set(y.translate(fold).split())
                both = len(a & b)
                good.append(100 * both >= similar * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return met.select("id", "line", "later", "earlier").mapInArrow(run, "id bigint, line int").distinct()


def nearest(found: DataFrame) -> DataFrame:
    """``(id, line, eid, eline)``: for each line of ``found`` the one that differs in the fewest cells."""
    first = F.struct("apart", F.get("eids", F.lit(0)).alias("eid"), F.get("elines", F.lit(0)).alias("eline"))
    return found.groupBy("id", "line").agg(F.min(first).alias("p")).select("id", "line", "p.eid", "p.eline")


def undone(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """``classes`` with ``done`` where they are settled."""
    met = classes.join(settled.select("id", "line", F.lit(True).alias("done")).hint("merge"), ["id", "line"], "left")
    return met.withColumn("done", F.coalesce("done", F.lit(False)))


def owners_of(classes: DataFrame, similar: int) -> int:
    """Owners of word lists: as many as it takes for each to hold some ``OWNER_BYTES`` of postings."""
    postings = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * similar / 100) + 1)).first()[0] or 0
    return max(partitions(classes.sparkSession), -(-int(postings) * POSTING.itemsize // OWNER_BYTES))


def staying(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``(id, lines)`` of ``docs(id, text)``: the lines with words that stay, as sets; a row for each id that keeps any."""
    spark = docs.sparkSession
    # a set comes once from each run of lines, so few rows of one set meet and need no sum before they are dealt
    lines = described(docs, word_levels(docs), similar).repartition("d0", "d1", "n")
    first = F.min(F.struct("id", "line", "marks")).alias("first")
    classes = materialize(lines.groupBy("d0", "d1", "n").agg(first).select("n", "first.*"), "classes")
    release(spark)
    # lines of fewer words are similar to equal ones only
    large = classes.where(F.col("n") >= (-(-similar // (100 - similar)) if similar < 100 else 1 << 30))
    owners = owners_of(large, similar)
    quick = similar_in_lists(word_lists(large.withColumn("done", F.lit(False)), True, owners), similar, True)
    quick = materialize(nearest(quick), "quick")
    places = quick.select("id", "line", F.array("eid").alias("eids"), F.array("eline").alias("elines"))
    settled = materialize(verified(quick, bodies_of(places, docs), similar), "settled")
    release(spark)
    found = similar_in_lists(word_lists(undone(large, settled), False, owners), similar, False)
    found = materialize(found, "found")
    release(spark)
    # the texts are read once for all pairs; the nearest of each line are compared first: most lines need no other
    bodies = bodies_of(found, docs)
    settled = materialize(settled.unionByName(verified(nearest(found), bodies, similar)).distinct(), "settled")
    # a pair that shares several words is in several lists: put together before it becomes a row
    places = F.zip_with("eids", "elines", lambda e, n: F.concat_ws(" ", e.cast("string"), n.cast("string")))
    lists = found.join(settled, ["id", "line"], "left_anti").groupBy("id", "line")
    once = lists.agg(F.array_distinct(F.flatten(F.collect_list(places))).alias("places"))
    part = lambda k: F.split_part("place", F.lit(" "), F.lit(k))
    rest = once.select("id", "line", F.explode("places").alias("place")).select(
        "id", "line", part(1).cast("bigint").alias("eid"), part(2).cast("int").alias("eline")
    )
    settled = materialize(settled.unionByName(verified(rest, bodies, similar)).distinct(), "settled")
    release(spark)
    marked = classes.select("id", F.col("line").alias("stays"), F.lit(None).cast("int").alias("goes"))
    marked = marked.unionByName(settled.select("id", F.lit(None).cast("int").alias("stays"), F.col("line").alias("goes")))
    both = marked.repartition("id").groupBy("id").agg(F.collect_list("stays").alias("stays"), F.collect_list("goes").alias("goes"))
    return both.select("id", F.array_except("stays", "goes").alias("lines"))


def told_apart(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a ``key`` that tells rows of different texts apart: the id, or where ids repeat the rank of id and text."""
    least = F.lit(-(1 << 63)).cast("bigint")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), least))
    # a null id counts as another one than the least number
    kind = F.col("doc_id").cast("bigint").isNotNull()
    if named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return named
    digest, some = free_name(named, "digest"), free_name(named, "some")
    named = named.withColumn(some, kind).withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    order = [some, key, digest]
    rank = free_name(named, "rank")
    ranks = ordered_scan(named.select(*order).distinct(), order, ordinal=rank).select(*order, rank)
    return named.join(ranks, order).withColumn(key, F.col(rank)).drop(some, digest, rank)


def without_repeats(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and a struct of ``n_lines`` and ``n_removed`` as last column."""
    key, gone, stay, report = (free_name(docs, c) for c in ("id", "gone", "stay", "line_report"))
    named = told_apart(docs, key)
    lists = staying(named.select(F.col(key).alias("id"), "text"), similar).toDF(key, stay)
    met = named.join(lists.hint("shuffle_hash"), key, "left")
    parts = F.split("text", "\n", -1)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    none = F.array().cast("array<int>")
    worded = F.transform(parts, lambda p, i: F.when(p.rlike(WORD), i))  # lines without words stay
    lost = F.array_except(worded, F.array_append(F.coalesce(stay, none), F.lit(None).cast("int")))
    met = met.withColumn(gone, F.when(F.size(stay) == n_lines, none).otherwise(lost))
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.size(gone) > 0, left).otherwise(F.col("text"))
    counts = F.struct(
        F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return met.select(*kept, counts.alias(report))


def drop_repeats(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` without repeated lines; rows that lost all their words go."""
    out = without_repeats(docs, similar)
    report = out.columns[-1]
    words = F.col("text").rlike(WORD)
    return out.where((F.col(f"{report}.n_removed") == 0) | words).drop(report)


@queries.query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = without_repeats(table(spark, folder, "documents", "doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "line_report.n_lines", "line_report.n_removed", crc.alias("kept_crc32"))
