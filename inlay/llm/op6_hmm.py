"""Hidden Markov language model, trained by Baum-Welch over the whole corpus.

Training begins with states that emit word classes, of which there are ``CLASSES``; a word's class
comes from its hash, and the share of a word in its class from its count in the training
texts.  ``WORD_PASSES`` further passes learn what each state emits word by word.  What
tasks share is bounded (the class model, then starts, transitions and totals of states),
while counts and emissions of words, which grow with the corpus, stay distributed: blocks
of documents send their distinct words, with their expected counts per state, to the
task that owns the class and get the corpus counts back.  A word that training texts don't
have is emitted with its base probability by every state.

Every Baum-Welch pass sums expected counts over all blocks.  Training cuts a text into
runs of ``RUN`` tokens with start probabilities of their own; scoring does not cut: the
scaled forward recursion over a whole text goes on from run to run, as a product of the
runs' transfer matrices, so long texts take as few steps as short ones.

Tokens are words (A-Z folded) and one end.  Null and empty texts are the end alone; a null
id counts as empty text in the split; repeated rows are scored alike; an empty table
stays empty; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import forget, materialize, partitions, release, table
from inlay.llm.words import blocks, split

CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS
END = CLASSES  # class of the end of a text
STATES = 8
PASSES = 6
WORD_PASSES = 2  # after those of the classes
RUN = 512
PRIOR = 20.0  # tokens of the class frequencies that every state is given
STAY = 0.9
SEED = 11
BLOCK_BYTES = 1 << 24
PIECE = 1 << 18  # tokens of a block that are looked at together
PACKED = "block bigint, doc_ids array<bigint>, held array<boolean>, ends array<int>, words binary, hashes binary, kinds binary, counts binary"
CODED = "doc_ids array<bigint>, held array<boolean>, ends array<int>, classes binary, known array<bigint>, base array<double>, inside array<double>, block bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The values of one row at a time: a row is a block and may take many megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def planes(values: np.ndarray) -> bytes:
    """Numbers as their bytes, first all lowest ones, packed; the first eight bytes tell the size before."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def from_planes(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def halves(counts: np.ndarray) -> bytes:
    """Expected counts as the upper halves of 32-bit floats, rounded: eight binary digits each."""
    bits = np.ascontiguousarray(counts, "<f4").ravel().view("<u4")
    return planes(((bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype("<u2"))


def from_halves(raw: bytes) -> np.ndarray:
    return (from_planes(raw, "<u2").astype("<u4") << np.uint32(16)).view("<f4")


def packed(docs: DataFrame, held: Column) -> DataFrame:
    """Blocks of documents as local word numbers, with the distinct words and their training counts."""

    def row_of(batch: pa.RecordBatch, first: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.concatenate([n for _, n in parts])
        own, local = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        held_out = batch.column(2).slice(first, len(sizes)).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(local[np.repeat(~held_out, sizes)], minlength=len(own))
        row = {
            "block": [uuid.uuid4().int >> 65],
            "doc_ids": [batch.column(0).slice(first, len(sizes)).to_pylist()],
            "held": [held_out.tolist()],
            "ends": [np.cumsum(sizes).astype(np.int32)],
            "words": [planes(local.astype("<i4"))],
            "hashes": [own.tobytes()],
            "kinds": [planes((own >> np.uint64(64 - CLASS_BITS)).astype("<i2"))],
            "counts": [planes(counts.astype("<i8"))],
        }
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, parts = 0, 0, []
            for block in blocks(batch.column(1)):  # texts become hashes a megabyte at a time
                words = split(block)
                width = int(block.starts[-1])
                if parts and size + width > BLOCK_BYTES:
                    yield row_of(batch, first, parts)
                    first, size, parts = block.first, 0, []
                parts.append((words.hashes.copy(), np.diff(words.at)))
                size += width
            if parts:
                yield row_of(batch, first, parts)

    return docs.select(F.col("doc_id").cast("bigint"), "text", held.alias("held")).mapInArrow(run, PACKED)


def corpus_counts(rows: DataFrame, owners: int) -> DataFrame:
    """``(block, owner, payload)``: corpus counts of each block's words, in their order.

    Rows whose block is null hold the statistics of an owner's classes: class, tokens and
    distinct words.  A word has one row of an owner's input per block, however frequent it is.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, hashes, counts in each_row(batches):
            hashes, counts = np.frombuffer(hashes, np.uint64), from_planes(counts, "<i8")
            owner = ((hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64) * owners) >> CLASS_BITS
            at = np.searchsorted(owner, np.arange(owners + 1))
            some = np.flatnonzero(np.diff(at))
            arrays = [
                pa.array(some, pa.int32()),
                pa.array([block] * len(some), pa.int64()),
                pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([planes(counts[at[i] : at[i + 1]]) for i in some], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["owner", "block", "hashes", "counts"])

    def answer(owner: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(r[1], np.uint64) for r in rows]
        own, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.zeros(len(own), np.int64)
        np.add.at(counts, place, np.concatenate([from_planes(r[2], "<i8") for r in rows]))
        kind = (own >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        there = np.unique(kind)
        stats = np.stack([
            there,
            np.bincount(kind, counts, CLASSES)[there].astype(np.int64),
            np.bincount(kind, counts > 0, CLASSES)[there].astype(np.int64),
        ])
        found, ends = counts[place], np.cumsum([len(p) for p in parts])
        payload = [planes(p) for p in np.split(found, ends[:-1])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows] + [None], pa.int64()),
                pa.array([owner] * (len(rows) + 1), pa.int32()),
                pa.array([*payload, stats.tobytes()], pa.binary()),
            ],
            ["block", "owner", "payload"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
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

    sent = rows.select("block", "hashes", "counts").mapInArrow(send, "owner int, block bigint, hashes binary, counts binary")
    ordered = sent.repartition("owner").sortWithinPartitions("owner")
    return ordered.mapInArrow(gather, "block bigint, owner int, payload binary")


@dataclass
class Totals:
    """Training tokens, distinct training words (the end included), training texts, and both per class."""

    tokens: int
    distinct: int
    texts: int
    in_class: np.ndarray
    words_in_class: np.ndarray

    def frequencies(self) -> np.ndarray:
        """Smoothed share of each class, the end last."""
        raw = np.append(self.in_class + 0.5 * (self.words_in_class + 1), self.texts + 0.5)
        return raw / raw.sum()


def totals(counted: DataFrame, texts: int) -> Totals:
    in_class, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in counted.where("block is null").collect():
        kind, n, distinct = np.frombuffer(row.payload, np.int64).reshape(3, -1)
        in_class[kind], words[kind] = n, distinct
    return Totals(int(in_class.sum()) + texts, int(words.sum()) + (texts > 0), texts, in_class, words)


def coded(rows: DataFrame, counted: DataFrame, total: Totals) -> DataFrame:
    """Per block the class of every token, and per document what depends on word counts alone."""
    lists = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("owner", "payload")).alias("found"))
    shared = rows.sparkSession.sparkContext.broadcast(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        spread = np.log10(t.tokens + 0.5 * (t.distinct + 1))
        class_size = np.log10(t.in_class + 0.5 * (t.words_in_class + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held, ends, words, kinds, found, block = (batch.column(c)[i].as_py() for c in range(7))
                local, kind = from_planes(words, "<i4"), from_planes(kinds, "<i2").astype(np.int64)
                parts = sorted(found or [], key=lambda f: f["owner"])
                counts = np.concatenate([np.zeros(0, np.int64), *[from_planes(f["payload"], "<i8") for f in parts]])
                weight = np.log10(counts + 0.5)
                at = np.append(0, np.array(ends, np.int64))

                def summed(values: np.ndarray) -> np.ndarray:
                    total_to = np.concatenate([[0], np.cumsum(values[local])])
                    return total_to[at[1:]] - total_to[at[:-1]]

                end_base = np.log10(t.texts + 0.5) - spread
                known = summed((counts > 0).astype(np.int64)) + (t.texts > 0)
                # per text, not from sums over the block: the same text has the same score everywhere
                base = np.array([np.sum(weight[local[a:b]] - spread) + end_base for a, b in zip(at[:-1], at[1:])])
                ratio = weight - class_size[kind]
                inside = np.array([np.sum(ratio[local[a:b]]) for a, b in zip(at[:-1], at[1:])])
                classes = np.insert(kind[local].astype("<i2"), at[1:], END)
                types = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 2, pa.int64())
                new_ends = (at[1:] + np.arange(1, len(at))).astype(np.int32)
                values = (ids, held, new_ends, classes.tobytes(), known, base, inside, block)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types)], [f"c{k}" for k in range(8)])

    met = rows.join(lists, "block", "left")
    return met.select("doc_ids", "held", "ends", "words", "kinds", "found", "block").mapInArrow(run, CODED)


@dataclass
class Model:
    """Start probabilities of texts and of later runs, transitions, emissions of classes per state."""

    start: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # classes x states


def first_model(total: Totals, states: int, seed: int) -> Model:
    draws = np.random.default_rng(seed)
    emits = total.frequencies()[:, None] * draws.gamma(2.0, 0.5, (CLASSES + 1, states))
    moves = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(moves, STAY if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    return Model(even, even, moves, emits / emits.sum(axis=0))


def layout(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs from long to short: their order, how many reach each step, and the places of all tokens step by step."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    steps = int(size.max()) if len(size) else 0
    active = len(size) - np.searchsorted(np.sort(size), np.arange(steps), "right")
    step = np.repeat(np.arange(steps), active)
    first = np.concatenate([[0], np.cumsum(active)])
    rank = np.arange(len(step)) - first[step]
    return order, first, begin[order][rank] + step


def expected(x: np.ndarray, begin: np.ndarray, end: np.ndarray, fresh: np.ndarray, m: Model) -> list[np.ndarray]:
    """Expected start, later-start, transition and emission counts of runs of tokens, and their log-likelihood."""
    order, first, place = layout(begin, end)
    states, steps = len(m.start), len(first) - 1
    token = x[place]
    e = m.emits[token]
    alpha, scale = np.empty_like(e), np.empty(len(e))
    for t in range(steps):
        a, b = first[t], first[t + 1]
        if t:
            now = alpha[first[t - 1] : first[t - 1] + b - a] @ m.moves
        else:
            now = np.where(fresh[order][:, None], m.start, m.later)
        now = now * e[a:b]
        scale[a:b] = now.sum(axis=1)
        alpha[a:b] = now / scale[a:b, None]
    gamma = np.empty_like(e)
    moves = np.zeros((states, states))
    beta = np.ones((0, states))
    for t in range(steps - 1, -1, -1):
        a, b = first[t], first[t + 1]
        now = np.ones((b - a, states))
        if len(beta):
            ahead = e[b : b + len(beta)] * beta / scale[b : b + len(beta), None]
            moves += alpha[a : a + len(beta)].T @ ahead
            now[: len(beta)] = ahead @ m.moves.T
        beta = now
        gamma[a:b] = alpha[a:b] * beta
    counts = np.stack([np.bincount(token, gamma[:, k], len(m.emits)) for k in range(states)], axis=1)
    head = gamma[: first[1]] if steps else gamma
    is_new = fresh[order]
    return [head[is_new].sum(axis=0), head[~is_new].sum(axis=0), moves * m.moves, counts, np.array([np.log(scale).sum()])]


def expected_of_all(x: np.ndarray, begin: np.ndarray, end: np.ndarray, fresh: np.ndarray, m: Model) -> list[np.ndarray]:
    """:func:`expected` of any number of runs, some ``PIECE`` tokens at a time."""
    before = np.cumsum(end - begin) - (end - begin)
    cuts = np.append(np.flatnonzero(np.diff(before // PIECE, prepend=-1)), len(begin)) if len(begin) else np.zeros(2, int)
    sums = None
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = expected(x, begin[a:b], end[a:b], fresh[a:b], m)
        sums = own if sums is None else [s + o for s, o in zip(sums, own)]
    return sums


def runs_of(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every run of at most ``length`` tokens, and whether it begins its text."""
    begins = np.append(0, ends[:-1])
    each = -(-(ends - begins) // length)
    text = np.repeat(np.arange(len(ends)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    begin = begins[text] + number * length
    return begin, np.minimum(begin + length, ends[text]), text, number == 0


def baum_welch(rows: DataFrame, m: Model, total: Totals) -> Model:
    """One pass: expected counts of all training texts, summed by cells, and the model they give."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(m)
    chunk = 2048

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, None
        for batch in batches:
            for i in range(batch.num_rows):
                held, ends = np.array(batch.column(0)[i].as_py(), bool), np.array(batch.column(1)[i].as_py(), np.int64)
                x = np.frombuffer(batch.column(2)[i].as_py(), "<i2").astype(np.int64)
                begin, end, text, fresh = runs_of(ends, RUN)
                train = ~held[text]
                if train.any():
                    own = expected_of_all(x, begin[train], end[train], fresh[train], model)
                    sums = own if sums is None else [a + b for a, b in zip(sums, own)]
        if sums is not None:
            flat = np.concatenate([s.ravel() for s in sums])
            for at in range(0, len(flat), chunk):
                yield pa.RecordBatch.from_arrays([pa.array([at // chunk]), pa.array([flat[at : at + chunk].tobytes()])], ["c", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[c] = sums.get(c, 0.0) + np.frombuffer(v)
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([v.tobytes()])], ["c", "v"])

    parts = rows.select("held", "ends", "classes").mapInArrow(count, "chunk bigint, sums binary").repartition("chunk")
    found = {r.chunk: np.frombuffer(r.sums) for r in parts.mapInArrow(add, "chunk bigint, sums binary").collect()}
    if not found:
        return m
    flat = np.concatenate([found[c] for c in sorted(found)])
    k = len(m.start)
    start, later = flat[:k], flat[k : 2 * k]
    moves = flat[2 * k : 2 * k + k * k].reshape(k, k)
    emits = flat[2 * k + k * k : -1].reshape(-1, k) + PRIOR * total.frequencies()[:, None]

    def share(counts: np.ndarray, axis: int) -> np.ndarray:
        counts = counts + 1e-3
        return counts / counts.sum(axis=axis, keepdims=True)

    return Model(share(start, 0), share(later, 0), share(moves, 1), emits / emits.sum(axis=0))


def log_likelihoods(x: np.ndarray, ends: np.ndarray, m: Model, length: int = RUN) -> np.ndarray:
    """Natural log-likelihood of each whole text by the scaled forward recursion.

    The first run of a text carries one vector; later ones carry a matrix, a row for each state
    the run before may end in.  A text's vector is then taken through its runs' matrices.
    """
    states = len(m.start)
    begin, end, text, fresh = runs_of(ends, length)
    out = np.zeros(len(ends))
    vector = np.zeros((len(ends), states))

    def forward(which: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        order, first, place = layout(begin[which], end[which])
        final, logs = np.empty((len(which), rows, states)), np.zeros(len(which))
        now = np.empty((0, rows, states))
        for t in range(len(first) - 1):
            a, b = first[t], first[t + 1]
            if t:
                final[order[b - a : len(now)]] = now[b - a :]
                now = (now[: b - a].reshape(-1, states) @ m.moves).reshape(b - a, rows, states)
            else:
                now = np.broadcast_to(m.start if rows == 1 else m.moves, (b - a, rows, states))
            now = now * m.emits[x[place[a:b]]][:, None, :]
            scale = now.max(axis=(1, 2)) if rows > 1 else now.sum(axis=(1, 2))
            now /= scale[:, None, None]
            logs[order[: b - a]] += np.log(scale)
        final[order[: len(now)]] = now
        return final, logs

    if len(ends):
        heads = np.flatnonzero(fresh)
        final, logs = forward(heads, 1)
        vector, out = final[:, 0, :], logs
        rest = np.flatnonzero(~fresh)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            matrix, logs = forward(some, states)
            # runs of one text follow each other: one round for each place in the text
            turn = np.arange(len(some)) - np.searchsorted(text[some], text[some])
            for n in range(int(turn.max()) + 1):
                mine = np.flatnonzero(turn == n)
                now = np.einsum("ns,nst->nt", vector[text[some[mine]]], matrix[mine])
                scale = now.sum(axis=1)
                vector[text[some[mine]]] = now / scale[:, None]
                out[text[some[mine]]] += np.log(scale) + logs[mine]
        out = out + np.log(vector.sum(axis=1))
    return out


def scored(rows: DataFrame, m: Model, total: Totals) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((m, total.tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held, ends, classes, known, base, inside = (batch.column(c)[i].as_py() for c in range(7))
                at = np.array(ends, np.int64)
                logs = log_likelihoods(np.frombuffer(classes, "<i2").astype(np.int64), at, model)
                columns = [
                    pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.diff(at, prepend=0)),
                    pa.array(known, pa.int64()), pa.array(np.full(len(at), tokens)), pa.array(base, pa.float64()),
                    pa.array(logs / np.log(10) + np.array(inside, float)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(7)])

    return rows.mapInArrow(run, SCORES)


@dataclass
class WordModel:
    """What states share of a model of words: ``mass`` and ``ends`` are their expected tokens and ends of texts."""

    start: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    mass: np.ndarray
    ends: np.ndarray
    distinct: int

    def emits(self, counts: np.ndarray) -> np.ndarray:
        """Emissions of words of expected counts ``counts`` (words x states), the end last.

        Half a token of every word, and of an unknown one, is dealt over the states by their mass,
        so words without counts have their base probability in all states.
        """
        share = (self.mass + 1e-3) / (self.mass + 1e-3).sum()
        return (np.vstack([counts, self.ends]) + 0.5 * share) / (self.mass + 0.5 * (self.distinct + 1) * share)


def emissions(found: list[dict] | None, m: WordModel) -> np.ndarray:
    parts = [from_halves(f["payload"]) for f in sorted(found or [], key=lambda f: f["owner"])]
    return m.emits(np.concatenate([np.zeros(0, "<f4"), *parts]).reshape(-1, len(m.start)).astype(float))


def with_ends(words: bytes, ends: list[int], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block with ``end`` after each text, and where texts end."""
    at = np.array(ends, np.int64)
    return np.insert(from_planes(words, "<i4").astype(np.int64), at, end), at + np.arange(1, len(at) + 1)


def word_lists(counted: DataFrame) -> DataFrame:
    return counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("owner", "payload")).alias("found"))


def word_pass(rows: DataFrame, m: Model | WordModel, owners: int) -> DataFrame:
    """``(block, owner, payload)``: expected counts per state of each block's words, over all training texts.

    ``rows`` are packed blocks, with ``found`` of the pass before for a :class:`WordModel`.  Counts
    travel with eight binary digits.  Of the rows whose block is null, that of owner -1 has the sums of
    starts, later starts, transitions and ends, the others the sums of their counts as given back, so
    that emissions of a state sum to one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(m)
    states = len(m.start)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, None
        names = ["owner", "block", "hashes", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for block, held, ends, words, hashes, last in each_row(batches):
            own = np.frombuffer(hashes, np.uint64)
            if isinstance(model, Model):
                table = model.emits[np.append(from_planes(last, "<i2").astype(np.int64), END)]
            else:
                table = emissions(last, model)
            x, stops = with_ends(words, ends, len(own))
            begin, end, text, fresh = runs_of(stops, RUN)
            some = ~np.array(held, bool)[text]
            local = Model(model.start, model.later, model.moves, table)
            start, later, moves, counts, _ = expected_of_all(x, begin[some], end[some], fresh[some], local)
            stats = np.concatenate([start, later, moves.ravel(), counts[-1]])
            sums = stats if sums is None else sums + stats
            owner = ((own >> np.uint64(64 - CLASS_BITS)).astype(np.int64) * owners) >> CLASS_BITS
            at = np.searchsorted(owner, np.arange(owners + 1))
            there = np.flatnonzero(np.diff(at))
            values = (
                there,
                [block] * len(there),
                [own[at[o] : at[o + 1]].tobytes() for o in there],
                [halves(counts[at[o] : at[o + 1]]) for o in there],
            )
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)
        if sums is not None:
            values = ([-1], [None], [b""], [sums.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def answer(owner: int, rows: list[tuple]) -> pa.RecordBatch:
        if owner < 0:
            names, payload = [None], [np.sum([np.frombuffer(r[2]) for r in rows], axis=0).tobytes()]
        else:
            parts = [np.frombuffer(r[1], np.uint64) for r in rows]
            own, place = np.unique(np.concatenate(parts), return_inverse=True)
            each = np.concatenate([from_halves(r[2]).reshape(-1, states) for r in rows])
            total = np.stack([np.bincount(place, each[:, k], len(own)) for k in range(states)], axis=1)
            total = from_halves(halves(total)).reshape(-1, states)
            stops = np.cumsum([0] + [len(p) for p in parts])
            names = [*(r[0] for r in rows), None]
            payload = [halves(total[place[a:b]]) for a, b in zip(stops[:-1], stops[1:])]
            payload.append(total.sum(axis=0, dtype=float).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([owner] * len(names), pa.int32()), pa.array(payload, pa.binary())],
            ["block", "owner", "payload"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
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

    last = "kinds" if isinstance(m, Model) else "found"
    sent = rows.select("block", "held", "ends", "words", "hashes", last)
    sent = sent.mapInArrow(count, "owner int, block bigint, hashes binary, counts binary")
    return sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(gather, "block bigint, owner int, payload binary")


def train_words(docs: DataFrame, held: Column, states: int = STATES, passes: int = PASSES, seed: int = SEED, word_passes: int = WORD_PASSES):
    """Blocks of ``docs(doc_id, text)`` with the expected counts of their words, their model, and totals."""
    spark = docs.sparkSession
    rows, coded_, model, total = train_blocks(docs, held, states, passes, seed)
    blocks_ = materialize(coded_.select("block", "known", "base"), "known")
    forget(coded_)  # classes are of no more use
    owners, met, counted = min(CLASSES, max(1, partitions(spark))), rows, None
    for _ in range(max(1, word_passes)):
        before, counted = counted, materialize(word_pass(met, model, owners), "emitted")
        if before is not None:
            forget(before)
        sums = {r.owner: np.frombuffer(r.payload) for r in counted.where("block is null").orderBy("owner").collect()}
        release(spark)
        flat = sums.pop(-1, np.zeros(states * (states + 3)))
        start, later, moves, ends = np.split(flat, np.cumsum([states, states, states * states]))
        mass = ends + sum(sums.values(), np.zeros(states))
        share = lambda v: (v + 1e-3) / (v + 1e-3).sum(axis=-1, keepdims=True)
        model = WordModel(share(start), share(later), share(moves.reshape(states, states)), mass, ends, total.distinct)
        met = rows.join(word_lists(counted), "block", "left")
    return met.join(blocks_, "block"), model, total


def scored_words(rows: DataFrame, m: WordModel, total: Totals) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((m, total.tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = shared.value
        for ids, held, ends, words, found, known, base in each_row(batches):
            table = emissions(found, model)
            x, at = with_ends(words, ends, len(table) - 1)
            logs = log_likelihoods(x, at, Model(model.start, model.later, model.moves, table))
            columns = [
                pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.diff(at, prepend=0)),
                pa.array(known, pa.int64()), pa.array(np.full(len(at), tokens)), pa.array(base, pa.float64()),
                pa.array(logs / np.log(10)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(7)])

    return rows.select("doc_ids", "held", "ends", "words", "found", "known", "base").mapInArrow(run, SCORES)


def train(docs: DataFrame, held: Column, states: int = STATES, passes: int = PASSES, seed: int = SEED):
    """Coded blocks of ``docs(doc_id, text)``, the class model of the rows that ``held`` does not hold out, and totals."""
    return train_blocks(docs, held, states, passes, seed)[1:]


def train_blocks(docs: DataFrame, held: Column, states: int, passes: int, seed: int):
    """Packed blocks, and what :func:`train` gives."""
    rows = materialize(packed(docs, held), "packed", "zstd")
    texts = docs.where(~held).count()
    owners = min(CLASSES, max(1, partitions(docs.sparkSession)))
    counted = materialize(corpus_counts(rows, owners), "counts")
    release(docs.sparkSession)
    total = totals(counted, texts)
    blocks_ = materialize(coded(rows, counted, total), "coded")
    forget(counted)
    release(docs.sparkSession)
    model = first_model(total, states, seed)
    for _ in range(passes):
        model = baum_welch(blocks_, model, total)
    return rows, blocks_, model, total


def held_out(key: str = "doc_id") -> Column:
    text = F.coalesce(F.col(key).cast("bigint").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 1


@queries.query("op6_hmm")
def op6_hmm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return scored_words(*train_words(docs, held_out()))
