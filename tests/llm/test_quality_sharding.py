import collections
import random

import pytest

from inlay.llm import op3_sharding, op10_quality as op
from inlay.llm.queries import ORACLES, QUERIES
from tests.llm.corpus import documents, frame, words
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def repeats(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    return len({i + k for i, g in enumerate(grams) if g in often for k in range(3)})


def test_counts_and_verdicts(spark):
    rows = documents()
    rows += [(400, "## ** || " * 30, "a", "x", 1), (401, "the cat sat on a mat " * 2 + " ".join(f"w{i} of" for i in range(60)), "a", "x", 1)]
    by = {r[0]: r[1] or "" for r in rows}
    got = op.judged(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text, q = by[r.doc_id], r.quality
        w = words(text, False)
        lines = [p for p in text.split("\n") if words(p)]
        assert q.n_words == len(w) and q.word_chars == sum(map(len, w)) and q.n_lines == len(lines)
        assert q.n_symbols == sum(c in "#*$%&|<>" for c in text) and q.n_dup_lines == len(lines) - len(set(lines))
        assert q.n_repeat_words == repeats(w)
        assert q.base_failed == (len(w) < 50 or 100 * q.n_repeat_words > 50 * len(w))
        assert not (q.kept and q.base_failed)
    verdict = {r.doc_id: r.quality.kept for r in got}
    assert not verdict[400] and verdict[401]
    kept = op.keep_good(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "label", "kept"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.quality.kept)
    assert op.keep_good(frame(spark).limit(0)).count() == 0


def test_rules_run_without_user_functions(spark):
    plan = op.judged(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * op3_sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 100, 1000])
def test_jump_hash_equals_the_loop(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.s for r in df.select("k", op3_sharding.jump_shard(df.k, shards).alias("s")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_slots_and_growth(spark):
    rows = documents() + [(None, "null id", "a", "x", 1)] * 3
    got = op3_sharding.shard_rows(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 4) and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert op3_sharding.shard_rows(frame(spark).limit(0), 4).count() == 0


def test_ranks_do_not_depend_on_parts(spark):
    from inlay.llm.common import ranked

    df = frame(spark).select("doc_id", "source")
    many, one = (ranked(df, ["source"], ["doc_id"], "n", p).collect() for p in (13, 1))
    assert sorted(map(tuple, many), key=repr) == sorted(map(tuple, one), key=repr)


@pytest.mark.parametrize("name", ["op1_near_dedup", "op3_sharding", "op4_line_dedup", "op7_suffix_dedup", "op9_warc", "op10_quality_rules"])
def test_query_matches_sql(spark, name):
    import inlay.llm.registered  # noqa: F401

    problem, rows, *_ = compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None and rows
