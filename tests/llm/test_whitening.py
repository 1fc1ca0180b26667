"""Whitening against NumPy on the driver."""

import math

import numpy as np
import pytest

from inlay.llm import op13_whitening as op13

SCHEMA = "vec_id bigint, embedding array<float>, index string, z int, v string"


def vectors(n=300, entries=12, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, entries)) @ rng.normal(size=(entries, entries)) * 0.3
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(base)]
    rows += [(1000 + i, rows[4][1]) for i in range(100)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    bad = [None, [], [None] * entries, [math.nan] + [0.0] * (entries - 1), [math.inf] * entries, [1.0] * (entries + 1)]
    return rows + [(2000 + i, b) for i, b in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def plain(rows, entries):
    good = [(i, v) for i, v in rows if v and len(v) == entries and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good], np.int64)
    n, total = len(x), x.sum(0)
    away = x - total / n
    values, vectors_ = np.linalg.eigh(away.T @ away / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    deviation = [sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]
    z = away @ vectors_[:, :8] / np.sqrt(values[:8])
    return [i for i, _ in good], n, deviation, z, values[:8] / values.sum()


def run(spark, rows, folder):
    frame(spark, rows).write.parquet(f"{folder}/embeddings.parquet")
    df = op13.op13_whitening(spark, str(folder))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == op13.COLUMNS.split(", ")
    return df.collect()


@pytest.mark.parametrize("block_rows, split_blocks", [(1024, 64), (32, 2)])
def test_matches_numpy(spark, tmp_path, monkeypatch, block_rows, split_blocks):
    monkeypatch.setattr(op13, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(op13, "SPLIT_BLOCKS", split_blocks)
    rows = vectors()
    got = run(spark, rows, tmp_path)
    ids, n, deviation, z, share = plain(rows, 12)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - share[r.component - 1]) < 1e-9
    for at, (vec, dev) in enumerate(zip(ids, deviation)):
        for c in range(8):
            values = table[vec, dev][c + 1]
            if abs(z[at, c]) > 0.1 and len(values) == 1:
                assert sign.setdefault(c, np.sign(z[at, c] * values[0])) == np.sign(z[at, c] * values[0])
            assert min(abs(abs(v) - abs(z[at, c])) for v in values) < 1e-8


def test_general_interface_whitens(spark):
    rows = vectors(seed=3)
    done = op13.whiten(frame(spark, rows), "vec_id", "embedding", 5)
    z = np.array([r.z for r in done.projected.collect()])
    assert z.shape == (403, 5) and np.abs(z.T @ z / len(z) - np.eye(5)).max() < 1e-9
    assert sorted(r["index"] for r in done.rows.select("index").collect()) == list(range(403))


def test_degenerate_tables(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    assert run(spark, [(1, None), (2, [])], tmp_path / "nulls") == []
    assert run(spark, [(i, [0.5, 0.25]) for i in range(9)], tmp_path / "same") == []
    flat = run(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(5)], tmp_path / "line")
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-9 for r in flat)
    far = run(spark, [(0, [3e12, 0.0]), (1, [-3e12, 1.0]), (2, [0.0, 2.0])], tmp_path / "far")
    assert len({r.vec_id for r in far}) == 3 and all(r.deviation is None for r in far if r.vec_id == 0)
