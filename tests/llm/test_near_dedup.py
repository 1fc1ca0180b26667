import numpy as np
import pytest

from inlay.llm import op1_near_dedup as op
from tests.llm.corpus import documents, frame, near_components


@pytest.mark.parametrize("width, rounds", [(2, 2), (5, 0)])
def test_components_equal_brute_force(spark, width, rounds):
    rows = documents()
    want = near_components(rows, width)
    got = op.linked(frame(spark), width, rounds=rounds).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_one_document_of_each_group_stays(spark):
    rows = documents()
    want = near_components(rows, 5)
    df = frame(spark)
    out = op.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in rows if want[r[0]][1] == r[0])


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", "s", "x", 1), (None, "a b c d e f", "s", "x", 1), (4, "a b c d e f", "s", "x", 1)]
    got = op.linked(frame(spark, rows)).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 4] == [(4, True)]
    assert op.linked(frame(spark).limit(0)).count() == 0
    assert op.keep_first(frame(spark, rows)).count() == 3


def test_one_id_with_several_texts(spark):
    draws = np.random.default_rng(12)
    a, b, c = ([f"w{w}" for w in draws.integers(0, 10_000, 60)] for _ in range(3))
    near = lambda words, n: " ".join([*words[:-1], f"end{n}"])
    rows = [(5, near(a, 0)), (5, near(b, 0)), (5, near(b, 0)), (2, near(a, 1)), (7, near(b, 1)), (5, near(c, 0)), (None, near(c, 0))]
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id bigint, text string, M0 double").repartition(3)
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in op.linked(df).collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 5, True), ("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True)]
    kept = op.keep_first(df)
    assert kept.columns == df.columns
    want = [(2, near(a, 1)), (5, near(b, 0)), (5, near(b, 0)), (5, near(c, 0)), (None, near(c, 0))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_registers_estimate_the_similarity():
    draws = np.random.default_rng(3)
    for shared in (0.3, 0.8, 0.9):
        close = 0
        for _ in range(20):
            pool = draws.integers(0, 1 << 63, 2000, np.int64).astype(np.uint64)
            n = int(1000 * 2 * shared / (1 + shared))
            x, y = pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]])
            a, b = op.registers(x), op.registers(y)
            assert (np.maximum(a, b) == op.registers(np.union1d(x, y))).all()  # mergeable
            grid = np.linspace(0, 1, 201)[None, :]
            logs = op.log_likelihood(np.array([[(a > b).sum()]]), np.array([[(a < b).sum()]]), np.array([[0.5]]), grid)
            close += abs(grid[0, logs[0].argmax()] - shared) < 0.15
            likely = op.may_be_similar(a[None], b[None], np.array([1000.0]), np.array([1000.0]), 80)[0]
            assert likely or shared < 0.8
            assert not likely or shared > 0.3
        assert close >= 18
