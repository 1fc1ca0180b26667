import random

import numpy as np
from hypothesis import given, settings, strategies as st

from inlay.llm import op5_decontamination as op


def brute_tiles(doc, item, least):
    """Greedy string tiling straight from its definition; covered words of the item."""
    doc_marks, item_marks = [False] * len(doc), [False] * len(item)
    while True:
        best, found = least, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                    and not doc_marks[i + n] and not item_marks[j + n]
                ):
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((j, i))
        if not found:
            return sum(item_marks)
        for j, i in sorted(found):
            if not any(doc_marks[i : i + best]) and not any(item_marks[j : j + best]):
                doc_marks[i : i + best] = [True] * best
                item_marks[j : j + best] = [True] * best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), max_size=40))
def test_tiles_do_not_overlap_and_match(doc, item):
    tiles = op.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
    used_doc, used_item = set(), set()
    for n, j, i in tiles:
        assert n >= 3 and doc[i : i + n] == item[j : j + n]
        assert not used_doc & set(range(i, i + n)) and not used_item & set(range(j, j + n))
        used_doc |= set(range(i, i + n))
        used_item |= set(range(j, j + n))
    free_doc = [w if k not in used_doc else f"d{k}" for k, w in enumerate(doc)]
    free_item = [w if k not in used_item else f"i{k}" for k, w in enumerate(item)]
    assert brute_tiles(free_doc, free_item, 3) == 0


def test_coverage_equals_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        item = [rng.randrange(10_000) for _ in range(rng.randrange(5, 60))]
        parts = [item[a : a + rng.randrange(3, 25)] for a in range(0, len(item), 11)]
        rng.shuffle(parts)
        doc = [w for p in parts for w in [*p, rng.randrange(20_000, 30_000)]]
        got = sum(t[0] for t in op.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 5))
        assert got == brute_tiles(doc, item, 5)


def frames(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(50, "too short"), (51, None), (None, "x " * 9)]
    docs = [(i, " ".join(rng.choices(words, k=200)), "a", 0) for i in range(60)]
    first = items[3][1].split()
    docs.append((100, "lead in " + " ".join(first[15:] + ["between"] + first[:15]).upper() + " end", "a", 0))
    docs.append((101, " ".join(first[:9]), "a", 0))
    docs.append((102, items[4][1] + "\n" + items[5][1], "a", 0))
    docs += [(103, None, None, None), (104, "", "a", 1), (102, items[4][1] + "\n" + items[5][1], "a", 0)]
    schema = "doc_id bigint, text string, coverage string, item_id int"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id bigint, text string"), docs


def test_reordered_passages_and_edges(spark):
    df, items, docs = frames(spark)
    for size in (1 << 24, 400):  # one block, many blocks
        out = op.contamination(df, items, block_bytes=size).collect()
        assert len(out) == len(docs)
        by = {r.doc_id: r for r in out}
        assert {r.doc_id for r in out if not r.kept} == {100, 102}
        assert by[100].item_id == 3 and by[100].n_covered == 30
        assert by[101].kept and by[101].n_covered == 9
        assert by[102].n_items == 2 and by[102].item_id == 4
        assert by[103].kept and by[104].coverage == 0.0
        clean = op.keep_clean(df, items, block_bytes=size)
        assert clean.columns == df.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(d[0] for d in docs if d[0] not in (100, 102))


def test_empty_tables(spark):
    df, items, docs = frames(spark)
    assert op.contamination(df.limit(0), items).count() == 0
    assert op.keep_clean(df, items.where("false")).count() == len(docs)
