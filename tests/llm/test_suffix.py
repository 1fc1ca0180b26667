import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from inlay.llm import op7_suffix as op
from tests.llm.corpus import documents, frame, repeated_bytes


def check(got, rows):
    masks = repeated_bytes(rows)
    assert len(got) == len(rows)
    for r in got:
        mask = masks[r.doc_id]
        raw = next((x[1] or "") for x in rows if x[0] == r.doc_id).encode()
        left = bytes(b for b, m in zip(raw, mask) if not m)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(mask), spans), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and bytes(r.kept) == left


@pytest.mark.parametrize("shard, group", [(1 << 18, 1 << 22), (300, 900)])
def test_bytes_equal_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(op, "SHARD_BYTES", shard)
    monkeypatch.setattr(op, "GROUP_BYTES", group)
    rows = documents()
    check(op.without_passages(frame(spark), with_text=True).collect(), rows)


def test_empty_table(spark):
    assert op.without_passages(frame(spark).limit(0)).count() == 0


def test_merged_transforms_are_the_sorted_rotations():
    rng = random.Random(2)
    for _ in range(20):
        pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 140))) for _ in range(12)})
        ids = np.array([rng.randrange(100) for _ in pieces])
        least = {}
        for p, d in zip(pieces, ids.tolist()):
            for i in range(len(p) - 49):
                least[p[i : i + 50]] = min(least.get(p[i : i + 50], d), d)
        old, op.SHARD_BYTES = op.SHARD_BYTES, 200
        try:
            found = op.smallest_ids(pieces, ids)
        finally:
            op.SHARD_BYTES = old
        for p, f in zip(pieces, found):
            assert f.tolist() == [least[p[i : i + 50]] for i in range(len(p) - 49)]


def test_pieces_of_one_minimiser_do_not_all_meet(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase, tails = noise(45), [noise(12) for _ in range(6)]  # with some tails a string of 50 bytes repeats
    rows = []
    for i in range(150):
        tail = rng.choice(tails) if i % 3 == 0 else noise(12)
        rows.append((i, noise(60) + phrase + tail + noise(60), "a", "b", 1))
    plain = op.smallest_ids

    def bounded(pieces, ids):
        if sum(map(len, pieces)) > 4000:
            raise ValueError("too much text in one merge")
        return plain(pieces, ids)

    monkeypatch.setattr(op, "GROUP_BYTES", 2000)
    monkeypatch.setattr(op, "smallest_ids", bounded)
    check(op.without_passages(frame(spark, rows), with_text=True).collect(), rows)


def test_blocks_are_stored_packed(spark):
    rows = [(i, f"number {i} of many texts that are much alike, " * 40) for i in range(50)] + [(50, "")]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in rows], "id bigint, body binary")
    size = text = 0
    for block in op.blocked(docs).collect():
        size, text = size + len(block.data), text + block.starts[-1]
        raw = op.unpacked(block.data, block.starts[-1])
        for i, a, b in zip(block.ids, block.starts, block.starts[1:]):
            assert raw[a:b].decode() == dict(rows)[i]
    assert text == sum(len(t) for _, t in rows) and size < text / 3


def test_covered_bytes_of_pieces():
    """Pieces of an earlier document of the block go as a whole, others by their owner's bits."""
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(4000)) * 2, np.uint8)
    starts, ids, owners = np.array([0, 4000, 8000]), np.array([7, 3]), 5
    begin, _, hashes = op.minimisers(data, starts)
    own, at = op.owned(hashes, owners)
    shared = [
        {"owner": o, "bits": np.packbits(np.ones(at[o + 1] - at[o], bool)).tobytes(), "heavy": b""} for o in range(owners)
    ]
    g = op.Groups(ids, starts, data, shared, owners, [])
    answers, flags = {}, {}
    for o in range(owners):
        mine = g.order[g.at[o] : g.at[o + 1]]
        each = [[rng.random() < 0.1 for _ in range(len(g.pieces[p]) - 49)] for p in mine]
        flags.update(zip(mine.tolist(), each))
        answers[o] = np.packbits(np.array(sum(each, []), bool)).tobytes()
    gone = np.zeros(len(data), bool)
    for b, n, p, doc in zip(g.begin, g.count, g.piece.tolist(), g.ids):
        for k in range(n):
            if doc > g.least[p] or flags[p][k]:
                gone[b + k : b + k + 50] = True
    assert ((np.cumsum(op.covered(g, answers, len(data))[:-1]) > 0) == gone).all() and gone[:4000].all()


def test_a_string_takes_two_refinements(monkeypatch):
    rng = random.Random(6)
    parts = [bytes(rng.randrange(256) for _ in range(60)) for _ in range(4)]
    pieces = [parts[a] + parts[b] for a in range(4) for b in range(4) if a != b]
    ids = np.array([rng.randrange(100) for _ in pieces])
    plain, taken = op.merged, []
    monkeypatch.setattr(op, "SHARD_BYTES", 300)
    monkeypatch.setattr(op, "merged", lambda shards, ranks: taken.append((len(shards), len(ranks))) or plain(shards, ranks))
    found = op.smallest_ids(pieces, ids)
    least = {}
    for p, d in zip(pieces, ids.tolist()):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(least.get(p[i : i + 50], d), d)
    for p, f in zip(pieces, found):
        assert f.tolist() == [least[p[i : i + 50]] for i in range(len(p) - 49)]
    assert len(taken) == 1 and taken[0][0] > 1 and taken[0][1] <= 2


def test_all_strings_that_repeat_are_merged_and_no_others(monkeypatch):
    rng = random.Random(7)
    noise = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    common = noise(70)
    pieces = [noise(200) + common[rng.randrange(10) :] + noise(200) for _ in range(20)] + [noise(300) for _ in range(5)]
    ids = np.array([rng.randrange(100) for _ in pieces])
    least = {}
    for p, d in zip(pieces, ids.tolist()):
        for i in range(len(p) - 49):
            least.setdefault(p[i : i + 50], []).append(d)
    plain, sent = op.smallest_ids, []
    monkeypatch.setattr(op, "smallest_ids", lambda p, i: sent.extend(p) or plain(p, i))
    found = op.least_ids(pieces, ids).tolist()
    assert found == [min(least[p[i : i + 50]]) for p in pieces for i in range(len(p) - 49)]
    merged = [p[i : i + 50] for p in sent for i in range(len(p) - 49)]
    assert sorted(merged) == sorted(s for s, d in least.items() for _ in d if len(d) > 1)
    assert op.least_ids(pieces[-5:], ids[-5:]).tolist() == np.repeat(ids[-5:], 251).tolist()


def test_order_of_hashes_that_agree_in_high_bits():
    rng = np.random.default_rng(8)
    plain = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for values in (np.tile(plain, 2), np.concatenate([plain + np.uint64(1), plain, plain]), plain[:0]):
        assert (op.places_in_order(values) == np.argsort(values, kind="stable")).all()


class Batches:
    """Runs a step over batches of this process."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return Batches(*run(iter(self.batches)))

    def repartition(self, *names):
        return self

    def sortWithinPartitions(self, *names):
        rows = pa.Table.from_batches(self.batches)
        return Batches(*rows.sort_by([(n, "ascending") for n in rows.column_names[:2]]).to_batches())

    def with_lists(self, lists):
        out = []
        for b in self.batches:
            got = pa.array([lists.get(k) for k in b.column(0).to_pylist()])
            out.append(pa.RecordBatch.from_arrays([*b.columns, got], [f"c{i}" for i in range(b.num_columns + 1)]))
        return Batches(*out)

    def by_block(self, *fields):
        out = {}
        for block, *values in zip(*(c.to_pylist() for c in pa.Table.from_batches(self.batches).columns)):
            out.setdefault(block, []).append(dict(zip(fields, values)))
        return out


def test_minimisers_are_looked_for_twice_in_a_block(monkeypatch):
    """Also where some are heavy: all that follows reads the groups stored with the block."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, tails = noise(45), [noise(12) for _ in range(6)]
    rows = [(i, noise(60) + phrase + (rng.choice(tails) if i % 3 else noise(12)) + noise(60)) for i in range(150)]
    monkeypatch.setattr(op, "GROUP_BYTES", 2000)
    monkeypatch.setattr(op, "BLOCK_BYTES", 5000)
    plain, calls = op.minimisers, []
    monkeypatch.setattr(op, "minimisers", lambda data, starts: calls.append(len(data)) or plain(data, starts))
    owners = 5
    texts = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows])], ["id", "body"])
    store = op.blocked(Batches(texts))
    shared = op.shared_keys(store, owners).by_block("owner", "bits", "heavy")
    kept = op.kept_groups(store.with_lists(shared), owners)
    assert any(n for b in kept.batches for n in b.column(4).to_pylist()), "no heavy minimiser"
    strings = op.shared_keys(kept, owners, strings=True).by_block("owner", "bits", "heavy")
    met = kept.with_lists(strings)
    found = op.earlier_strings(met, owners).by_block("owner", "bits")
    out = [r for b in op.cut_out(met.with_lists(found), owners, True).batches for r in b.to_pylist()]
    assert len(store.batches) > 3 and len(calls) == 2 * len(store.batches)
    masks = repeated_bytes([(*r, "a", "b", 1) for r in rows])
    assert sorted(r["c1"] for r in out) == list(range(150))
    for r in out:
        raw = rows[r["c1"]][1].encode()
        assert r["c6"] == bytes(b for b, m in zip(raw, masks[r["c1"]]) if not m)
    assert any(r["c3"] for r in out)
