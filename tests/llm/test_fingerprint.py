"""Fingerprints: neighbours and edits exactly, likeness against generalised Jaccard similarity."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from inlay.llm import op12_fingerprint as op12
from tests.llm.corpus import documents, frame, words


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain(rows):
    """``[(doc_id, n_chars, sha256, text, edited, next)]`` in the order of the query."""
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (doc, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = math.floor(len(text) / 3)
        edited = text[: len(text) - cut] + following[:cut]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


@pytest.mark.parametrize("parts", ["4", "37"])
def test_neighbours_and_edits(spark, parts, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK_BYTES", 4000)
    rows = [(None, "no id", "a", "b", 1), (-5, "below", "a", "b", 1), *documents()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = op12.compared(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(rows)
    assert sorted(map(str, [(r.doc_id, r.n_chars, r.edited_sha256) for r in got])) == sorted(str(r[:3]) for r in want)
    prints = {text: code for text, code in zip([r[3] for r in want], op12.written(op12.signatures([r[3] for r in want])))}
    by_row = {r[:3]: r for r in want}
    error = []
    for r in got:
        _, _, _, text, edited, following = by_row[r.doc_id, r.n_chars, r.edited_sha256]
        assert r.fingerprint == prints[text] and len(r.fingerprint) == op12.SAMPLES * op12.HEX
        assert r.edited_fingerprint == op12.written(op12.signatures([edited]))[0]
        error += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert abs(np.mean(error)) < 0.01 and np.abs(error).max() < 5 * 0.5 / math.sqrt(op12.SAMPLES)


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(2)
    for _ in range(4):
        left = [w for w in "abcdefghij" for _ in range(rng.randrange(0, 9))]
        right = [w for w in "cdefghijklm" for _ in range(rng.randrange(0, 9))]
        texts = [" ".join(left), " ".join(right)]
        codes = op12.signatures(texts, 6000)
        assert abs((codes[0] == codes[1]).mean() - jaccard(*texts)) < 4 * 0.5 / math.sqrt(6000)


def test_equal_bags_empty_texts_and_blocks():
    codes = op12.signatures(["One two two", "two TWO\n one", "", " \n", "three"])
    assert (codes[0] == codes[1]).all() and not codes[2:4].any() and codes[4].all()
    texts = [r[1] or "" for r in documents()]
    together = op12.signatures(texts)
    assert all((op12.signatures([t])[0] == c).all() for t, c in zip(texts[:40], together))


def test_operator_keeps_columns_and_likeness(spark):
    df = op12.fingerprint(frame(spark).withColumnRenamed("source", "near_next"), out="code")
    rows = df.collect()
    assert df.columns == ["doc_id", "text", "near_next", "label", "kept", "code"]
    codes = {r.doc_id: r.code for r in rows}
    from pyspark.sql import functions as F

    pair = spark.createDataFrame([(codes[5], codes[100]), (codes[300], codes[301]), (codes[300], codes[5])], "a string, b string")
    got = [r[0] for r in pair.select(op12.likeness(F.col("a"), F.col("b"))).collect()]
    share = sum(codes[5][i : i + 4] == codes[100][i : i + 4] for i in range(0, 512, 4)) / 128
    assert got == [share, 1.0, 0.0] and share > 0.5


def test_small_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12.op12_fingerprint(spark, str(tmp_path)).count() == 0
    (row,) = op12.compared(frame(spark, [(1, "all alone here", "a", "b", 1)])).collect()
    assert (row.n_chars, row.near_next) == (14, 1.0)
    twice = op12.compared(frame(spark, [(1, "x y z", "a", "b", 1)] * 3 + [(1, None, "a", "b", 1)])).collect()
    assert len(twice) == 4 and sorted(r.n_chars for r in twice) == [0, 5, 5, 5]
