import hashlib
import random
import zlib

import numpy as np
import pytest

from inlay.llm import op4_line_dedup as op
from tests.llm.corpus import documents, frame, line_removals


def expected(rows):
    gone = line_removals(rows)
    out = {}
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        left = [p for n, p in enumerate(parts) if (doc, n) not in gone]
        out[doc] = (0 if text is None else len(parts), len(parts) - len(left), text if text is None else "\n".join(left))
    return out


@pytest.mark.parametrize("list_rows", [op.LIST_ROWS, 3])
def test_lines_equal_brute_force(spark, monkeypatch, list_rows):
    monkeypatch.setattr(op, "LIST_ROWS", list_rows)  # short parts: every list is dealt out
    rows = documents()
    want = expected(rows)
    df = frame(spark)
    out = op.without_repeats(df)
    assert out.columns[:-1] == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.line_report.n_lines, r.line_report.n_removed, r.text) == want[r.doc_id]


def test_near_lines_against_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # lines of few words around the threshold
        line = rng.sample(base[: 12 + i % 20], rng.randrange(1, 12))
        rows.append((i, " ".join(line) + "\n" + " ".join(line[:-1] + [rng.choice(base)]), "s", "x", 1))
    want = expected(rows)
    got = op.without_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.line_report.n_removed, r.text) for r in got} == {d: w[1:] for d, w in want.items()}


def test_emptied_rows_go_and_empty_table(spark):
    rows = [(1, "one two three\n", "s", "x", 1), (2, "three two one", "s", "x", 1), (3, "", "s", "x", 1), (None, "zero", "s", "x", 1), (4, "zero\nnew line", "s", "x", 1)]
    out = {r.doc_id: r.text for r in op.drop_repeats(frame(spark, rows)).collect()}
    assert out == {1: "one two three\n", 3: "", None: "zero", 4: "new line"}
    assert op.drop_repeats(frame(spark).limit(0)).count() == 0


def test_prefix_words_are_rare_first():
    level = np.zeros(1 << op.COUNT_BITS, np.uint8)
    import pyarrow as pa

    from inlay.llm.words import blocks, split

    block = next(blocks(pa.array(["often rare often seldom"])))
    plain = split(block).hashes
    for h, v in zip(plain[[0, 1, 3]], (90, 9, 40)):
        level[int(h >> np.uint64(64 - op.COUNT_BITS))] = v
    hashes, at = op.distinct_words(block, level)
    assert hashes.tolist() == plain[[1, 3, 0]].tolist() and at.tolist() == [0, 3]


def test_rows_of_one_id_and_different_texts(spark):
    texts = [(None, "one two three\nfour five six"), (None, "seven eight nine\nfour five six"), (None, "one two three\nten eleven twelve"),
             (4, "seven eight nine\nred green blue"), (4, "black white grey\nred green blue"), (5, "black white grey")]
    order = sorted(texts, key=lambda r: (r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    seen, want = set(), []
    for doc, text in order:
        left = []
        for line in text.split("\n"):
            left += [] if line in seen else [line]
            seen.add(line)
        want.append((doc, text.count("\n") + 1 - len(left), "\n".join(left)))
    df = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in texts * 2], "doc_id bigint, text string, source string, label string, kept int")
    out = op.without_repeats(df)
    assert out.columns[:-1] == df.columns
    got = [(r.doc_id, r.line_report.n_removed, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want * 2, key=str)


def test_sets_leave_a_run_of_lines_once_and_texts_are_read_twice(spark, monkeypatch):
    rows = [(i, f"same words again\nwords again same\nnone like line{i} x{i} y{i} z{i}\n \n", "s", "x", 1) for i in range(40)]
    df = frame(spark, rows).coalesce(1)
    docs = df.selectExpr("doc_id id", "text")
    lines = op.described(docs, op.word_levels(docs), 80).collect()
    assert len(lines) == 41 and min((r.id, r.line) for r in lines if r.n == 3) == (0, 0)
    passes, read = [], op.line_texts
    monkeypatch.setattr(op, "line_texts", lambda *a: passes.append(a) or read(*a))
    got = {r.doc_id: (r.line_report.n_lines, r.line_report.n_removed, r.text) for r in op.without_repeats(df).collect()}
    assert got == expected(rows) and len(passes) == 2


def test_pairs_of_near_size_against_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    lists, n, asks = rng.integers(0, 6, 200), rng.integers(1, 40, 200), rng.random(200) < 0.6
    order = np.lexsort((n, lists))
    lists, n, asks = lists[order], n[order], asks[order]
    want = {(a, b) for a in range(200) for b in range(200)
            if asks[a] and lists[a] == lists[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    for most in (7, 1 << 19):
        monkeypatch.setattr(op, "PAIRS", most)
        got = [(int(a), int(b)) for x, y in op.of_near_size(lists, n, asks, 80) for a, b in zip(x, y)]
        assert len(got) == len(want) and set(got) == want
