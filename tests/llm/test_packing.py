import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inlay.llm import op2_packing as op

SCHEMA = "doc_id bigint, text string, offset string"


def rows_of(docs):
    t = Tokenizer.from_file(op.tokenizer_path())
    return {d: t.encode(text or "", add_special_tokens=False).ids + [2] for d, text, *_ in docs}


def check(out, ids, capacity):
    spans, sequences = {}, {}
    for r in out:
        spans.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(spans) == set(ids)
    for doc, mine in spans.items():
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids[doc])
        assert all(r.length == capacity for r in mine[1:])
        for r in mine:
            part = np.array(ids[doc][r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [8, 64])
def test_pieces_are_packed_whole(spark, capacity):
    docs = [(i, "word " * (i % 40) + "ñ 東京 <|endoftext|> 🙂", "x") for i in range(120)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "a" * 5000, None), (1003, " \n\t" * 700, "y")]
    df = spark.createDataFrame(docs, SCHEMA)
    ids = rows_of(docs)
    n = check(op.packed(df, op.tokenizer_path(), capacity).collect(), ids, capacity)
    least = -(-sum(map(len, ids.values())) // capacity)
    assert n <= 1.1 * least + 2


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.packed(none, op.tokenizer_path(), 16).count() == 0
    same = spark.createDataFrame([(7, "one two", "x")] * 5, SCHEMA)
    out = op.packed(same, op.tokenizer_path(), 16, with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 5
    assert all(r.ids == rows_of([(7, "one two")])[7] for r in out)


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(5)
    for top in (3, 200):
        counts = rng.integers(0, top, 129)
        counts[0] = 0
        used = np.zeros_like(counts)
        groups = op.plan(counts, 128)
        for lengths, n in groups:
            assert sum(lengths) <= 128
            for v in lengths:
                used[v] += n
        assert (used == counts).all()
        least = -(-int((counts * np.arange(129)).sum()) // 128)
        big = int(counts[65:].sum())
        assert sum(n for _, n in groups) <= 1.05 * max(least, big) + 2
