import pytest
from pyspark.sql import functions as F

from inlay.operators.permutation import Permutation, permutation, resolve_permuted


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 99, 100, 101, 997, 4999])
def test_a_bijection_and_its_inverse(spark, n):
    order = permutation(spark, n, 3)
    rows = spark.range(n).select("id", order.instance_of(F.col("id")).alias("instance"))
    got = rows.withColumn("back", order.sequence_of(F.col("instance"))).collect()
    assert sorted(r.instance for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    assert order.rows * order.columns - n < order.rows


def test_seeds_differ_and_order_looks_random(spark):
    n = 5000
    mapped = [
        [r[0] for r in spark.range(n).select(permutation(spark, n, seed).instance_of(F.col("id"))).collect()]
        for seed in (1, 2)
    ]
    assert sum(a == b for a, b in zip(*mapped)) < 20
    ascents = sum(a < b for a, b in zip(mapped[0], mapped[0][1:]))
    assert abs(ascents - n / 2) < 5 * (n / 12) ** 0.5
    assert abs(sum(mapped[0][: n // 10]) / (n // 10) - n / 2) < n / 10


def test_a_trillion_instances_without_a_corpus(spark):
    n = 10**12 + 1
    order = permutation(spark, n, 5)
    wanted = spark.range(1000).select((F.col("id") * (n // 1000)).alias("place"))
    got = wanted.withColumn("instance", order.instance_of(F.col("place"))).withColumn(
        "back", order.sequence_of(F.col("instance"))
    )
    rows = got.collect()
    assert len({r.instance for r in rows}) == 1000 and all(0 <= r.instance < n and r.back == r.place for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_walks_are_found_where_few_are_not_enough(spark):
    for n in (2, 3, 5, 7, 13, 31):
        order = permutation(spark, n, 11)
        more = Permutation(n, 11, 4 * order.walks)
        rows = spark.range(n).select(order.instance_of(F.col("id")), more.instance_of(F.col("id"))).collect()
        assert all(a == b for a, b in rows)


def test_nulls_and_places_outside(spark, map_of):
    order = permutation(spark, 10, 1)
    assert spark.range(1).select(order.instance_of(F.lit(None).cast("bigint"))).first()[0] is None
    for place in (-1, 10):
        with pytest.raises(Exception, match="is not one of 10 instances"):
            spark.range(1).select(order.instance_of(F.lit(place))).collect()
    with pytest.raises(Exception, match="is not one of 10 instances"):
        resolve_permuted(map_of({3: [(0, [1])], 12: [(0, [1])]}), order).collect()
    with pytest.raises(ValueError):
        permutation(spark, 0, 1)
