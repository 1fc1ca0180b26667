import random

import pytest
from pyspark.sql import functions as F

from inlay.operators import intervals, scan
from inlay.operators.scan import grouped_ordinal, ordered_scan
from inlay.operators.skew import spread_join


def frame(spark, rows):
    return spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(rows)], "id bigint, lo bigint, hi bigint")


@pytest.mark.parametrize(
    "probe, hit", [((10, 12), True), ((5, 9), False), ((5, 10), True), ((13, 20), False), ((12, 12), True), ((0, 99), True)]
)
def test_closed_ends(spark, probe, hit):
    found = intervals.conflicting(frame(spark, [probe]), frame(spark, [(10, 12)]), ["id"]).count()
    assert bool(found) == hit


def test_against_brute_force(spark):
    rng = random.Random(3)
    held, at = [], 0
    for _ in range(200):
        at += rng.randrange(1, 9)
        held.append((at, at + rng.randrange(6)))
        at = held[-1][1] + 1
    probes = [(lo, lo + rng.randrange(12)) for lo in (rng.randrange(at) for _ in range(400))]
    got = {
        r.id: (r.o_lo, r.o_hi)
        for r in intervals.find_overlap(frame(spark, probes), frame(spark, held), ["id"]).collect()
    }
    for i, (lo, hi) in enumerate(probes):
        met = [(a, b) for a, b in held if a <= hi and lo <= b]
        assert got[i] == (min(met) if met else (None, None))


def test_self_conflicts(spark):
    rows = [(0, 5), (6, 9), (9, 12), (20, 30), (22, 23)]
    assert sorted(r.lo for r in intervals.self_conflicts(frame(spark, rows), ["id"]).collect()) == [9, 22]


def test_digest_ignores_order_and_partitions(spark):
    rows = [(i * 10, i * 10 + 3) for i in range(100)]
    one = intervals.digest(frame(spark, rows).repartition(7)).first()
    two = intervals.digest(frame(spark, rows[::-1]).coalesce(1)).first()
    other = intervals.digest(frame(spark, rows[1:] + [(0, 4)])).first()
    assert one == two and one.digest != other.digest
    assert intervals.set_difference(frame(spark, rows), frame(spark, rows[::-1])).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_scan_is_independent_of_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i * 37 % 1000, i % 3) for i in range(1000)]
        df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
        import pyspark.sql.functions as F

        got = ordered_scan(
            df, ["k"], ordinal="n", sum_before={"s": F.col("v")}, max_before={"m": F.col("v")}, min_after={"a": F.col("v")}
        ).orderBy("k").collect()
        values = [v for _, v in sorted(rows)]
        for i, row in enumerate(got):
            assert (row.n, row.s) == (i, sum(values[:i]))
            assert row.m == (max(values[:i]) if i else None)
            assert row.a == (min(values[i + 1 :]) if i < 999 else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_grouped_ordinal_with_a_hot_group(spark):
    rows = [(0, i) for i in range(2000)] + [(1, 5), (2, 1), (2, 0)] + [(3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g bigint, o bigint").repartition(6)
    got = grouped_ordinal(df, ["g"], ["o"], "n").collect()
    assert len(got) == len(rows)
    assert all(r.n == (r.o if r.g != 1 else 0) for r in got)


def test_spread_join_salts_hot_keys(spark):
    facts = spark.createDataFrame([(0, i) for i in range(500)] + [(k, 0) for k in range(1, 50)], "k int, i int")
    dims = spark.createDataFrame([(k, k * 10) for k in range(0, 50)], "k int, v int")
    got = spread_join(facts, dims, ["k"], ["i"], rows_per_task=100).collect()
    assert sorted((r.k, r.i, r.v) for r in got) == sorted((r.k, r.i, r.k * 10) for r in facts.collect())


def test_scan_in_small_blocks(spark, monkeypatch):
    """Running values over blocks of a few rows equal those of a loop; windows see no more rows than a block has."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", 7)
    values = [(n, (n * 37) % 101 if n % 3 else None) for n in range(200)]
    df = spark.createDataFrame(values[::-1], "k bigint, v bigint").repartition(3)
    v = F.col("v")
    found = scan.ordered_scan(df, ["k"], ordinal="n", sum_before={"s": v}, max_before={"m": v}, min_after={"l": F.struct(v)})
    for r in found.collect():
        before = [x for _, x in values[: r.k] if x is not None]
        after = [x for _, x in values[r.k + 1 :]]
        least = min(after, key=lambda x: (x is not None, x), default=None)
        assert (r.n, r.s, r.m) == (r.k, sum(before), max(before, default=None))
        assert r.l == (None if not after else (least,))
    assert found.rdd.getNumPartitions() >= 200 // 7


def test_only_large_groups_are_put_in_global_order(spark, monkeypatch):
    """groups a window can hold are numbered without a range stage; of the others only their rows are staged."""
    rows = [(0, i) for i in range(40)] + [(None, i) for i in range(30)] + [(k, i) for k in range(1, 20) for i in range(k % 4)]
    df = spark.createDataFrame(rows, "g bigint, o bigint").repartition(5)
    staged = []
    real = scan.range_stage

    def counted(part, order_by, label="range"):
        staged.append(part.count())
        return real(part, order_by, label)

    monkeypatch.setattr(scan, "range_stage", counted)
    for limit, want in ((1000, []), (35, [40])):
        staged.clear()
        monkeypatch.setattr(scan, "BLOCK_ROWS", limit)
        got = scan.grouped_ordinal(df, ["g"], ["o"], "n").collect()
        assert sorted(map(str, got)) == sorted(f"Row(g={g}, o={o}, n={o})" for g, o in rows)
        assert staged == want
