import pytest
from pyspark.sql import functions as F

from inlay.functions.tokens import wrap_eos
from inlay.geometry import Geometry
from inlay.operators import placement
from inlay.operators.sampling import apply_repetitions, exact_sample, sample_fraction, train_order
from inlay.plans.experiments import Experiment, build_plan, length_profile, static_plan

ROWS = "seq_id bigint, tokens array<int>, position bigint"


def explicit(spark, positions, lists):
    return spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(zip(positions, lists))], ROWS)


def candidates(spark, sizes, start, end):
    rows = [(0, 0, i, n, start, end) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "exp_id int, copy_no int, seq_id bigint, n int, start bigint, end_excl bigint")


@pytest.mark.parametrize(
    "tokens, expected",
    [
        ([5], [0, 5, 0]), ([0, 5], [0, 5, 0]), ([5, 0], [0, 5, 0]), ([1, 2], [0, 1, 2, 0]),
        ([1, 2, 3], [1, 2, 3, 0]), ([1, 2, 3, 4], [1, 2, 3, 4]), ([0, 2, 3], [0, 2, 3, 0]), ([0], [0]),
    ],
)
def test_eos_wrapping(spark, tokens, expected):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    assert df.select(wrap_eos(F.col("t"), 4, 0)).first()[0] == expected


def test_explicit_placement(spark):
    """Rows that touch but don't overlap stay where they are; an empty one goes."""
    plan, at = {}, 3
    for n in (4, 1, 9, 2):
        plan[at] = list(range(n))
        at += n
    rows = explicit(spark, [*plan, at], [*plan.values(), []])
    assert {r.position: list(r.tokens) for r in placement.place_explicit(rows).collect()} == plan


def test_explicit_overlap_is_named(spark):
    with pytest.raises(placement.PlacementError, match="seq 1 at 19-21"):
        placement.place_explicit(explicit(spark, [15, 19], [[7] * 5, [8] * 3]))
    held = spark.createDataFrame([(40, 44)], "lo bigint, hi bigint")
    with pytest.raises(placement.PlacementError, match="occupied"):
        placement.place_explicit(explicit(spark, [44], [[9]]), held)
    assert placement.place_explicit(explicit(spark, [45, 39], [[9], [9]]), held).count() == 2


def check(result, sizes, length, start, end, held=()):
    rows = result.placed.collect()
    spans = sorted([(r.lo, r.hi) for r in rows] + list(held))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for r in rows:
        assert r.hi - r.lo + 1 == sizes[r.seq_id] == r.n
        assert start <= r.lo and r.hi < end and r.lo // length == r.hi // length
    left = result.unplaced.collect()
    assert len(rows) + len(left) == len(sizes)
    return rows, left


def test_random_placement_rules(spark):
    sizes = [1 + i * 7 % 16 for i in range(200)]
    held = [(20, 90), (300, 301)]
    taken = spark.createDataFrame(held, "lo bigint, hi bigint")
    result = placement.place_random(candidates(spark, sizes, 0, 6400), 64, 1, taken)
    _, left = check(result, sizes, 64, 0, 6400, held)
    assert not left


def test_same_seed_same_plan_whatever_the_partitions(spark):
    sizes = [3 + i % 5 for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    plans = []
    try:
        for parts in (1, 4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = candidates(spark, sizes, 640, 1920).repartition(parts)
            plans.append({r.seq_id: r.lo for r in placement.place_random(df, 64, 9).placed.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plans[0] == plans[1] == plans[2]
    other = placement.place_random(candidates(spark, sizes, 640, 1920), 64, 10).placed.collect()
    assert {r.seq_id: r.lo for r in other} != plans[0]


def test_full_range_reports_leftovers(spark):
    sizes = [8] * 30
    result = placement.place_random(candidates(spark, sizes, 0, 64), 16, 5, max_rounds=6)
    rows, left = check(result, sizes, 16, 0, 64)
    assert len(left) >= 30 - 8 and widest_gap(rows, [], 16, 64) < 8


def widest_gap(rows, held, length, end):
    used = set()
    for lo, hi in [(r.lo, r.hi) for r in rows] + held:
        used |= set(range(lo, hi + 1))
    widest = run = 0
    for at in range(end):
        run = 0 if at in used else (1 if at % length == 0 else run + 1)
        widest = max(widest, run)
    return widest


def test_every_candidate_that_fits_is_placed(spark):
    sizes = [8] * 1000  # as many slots as candidates
    result = placement.place_random(candidates(spark, sizes, 0, 8000), 8, 3)
    rows, left = check(result, sizes, 8, 0, 8000)
    assert len(rows) == 1000 and not left


@pytest.mark.parametrize("max_rounds", [0, 4, 16])
def test_dense_mixed_sizes_leave_only_what_has_no_gap(spark, max_rounds):
    sizes = [1 + i * 5 % 13 for i in range(150)]
    held = [(i * 16, i * 16 + i % 7) for i in range(0, 60, 2)]
    taken = spark.createDataFrame(held, "lo bigint, hi bigint")
    result = placement.place_random(candidates(spark, sizes, 0, 960), 16, 5, taken, max_rounds=max_rounds)
    rows, left = check(result, sizes, 16, 0, 960, held)
    assert left and min(r.n for r in left) > widest_gap(rows, held, 16, 960)
    assert {r.exp_id: r.n_waits for r in result.waits.collect()}.get(0, 0) >= len(left)


def test_blocks_change_nothing(spark, monkeypatch):
    sizes = [5 + 4 * (i % 2) for i in range(60)]
    held = [(i * 16, i * 16 + i % 7) for i in range(1, 33, 2)]
    taken = spark.createDataFrame(held, "lo bigint, hi bigint")
    plans = []
    for slots in (placement.BLOCK_SLOTS, 3):
        monkeypatch.setattr(placement, "BLOCK_SLOTS", slots)
        result = placement.place_random(candidates(spark, sizes, 16, 528), 16, 5, taken, max_rounds=0)
        rows, _ = check(result, sizes, 16, 16, 528, held)
        plans.append({r.seq_id: r.lo for r in rows})
    assert plans[0] == plans[1] and len(plans[0]) > 30


def test_all_rounds_are_played_when_asked(spark):
    """Without ``few`` the last candidates draw like the others; none is put into a gap while rounds are left."""
    rows = candidates(spark, [3] * 2000, 0, 16 * 1500).cache()
    result = placement.place_random(rows, 16, 7, few=None)
    assert result.rounds > 1 and result.unplaced.count() == 0
    drawn = None
    for n in range(result.rounds):
        at = placement.draw_positions(rows.withColumn("round", F.lit(n)), 16, 7, n, placement.draws_in(n))
        drawn = at if drawn is None else drawn.unionByName(at)
    met = result.placed.join(drawn.select("seq_id", "round", "lo"), ["seq_id", "round", "lo"], "left_semi")
    assert met.count() == 2000
    few = placement.place_random(rows, 16, 7)
    assert few.rounds < result.rounds and few.placed.count() == 2000


def test_gaps_of_a_range_of_a_billion_sequences(spark):
    """Ten candidates behind occupied first slots: blocks are counted, only the reached ones are listed."""
    sizes = [300, 200, 1, 512, 7, 512, 300, 300, 8, 9]
    end = 512 * 10**9
    held = [(0, 511), (512, 900), (5 * 512 + 1, 6 * 512 - 1), (end - 512, end - 1)]
    taken = spark.createDataFrame(held, "lo bigint, hi bigint")
    result = placement.place_random(candidates(spark, sizes, 0, end), 512, 5, taken, max_rounds=0)
    rows, left = check(result, sizes, 512, 0, end, held)
    assert not left and max(r.hi for r in rows) < 512 * 16
    space = placement.FreeSpace(candidates(spark, sizes, 0, end).select("start", "end_excl").distinct(), None, 512)
    assert space.blocks.count() == -(-(10**9) // placement.BLOCK_SLOTS) and space.widest().first().widest == 512


def test_many_candidates_for_one_sequence(spark):
    sizes = [2] * 400
    result = placement.place_random(candidates(spark, sizes, 0, 64), 64, 5, max_rounds=5)
    rows, left = check(result, sizes, 64, 0, 64)
    assert rows and len(rows) + len(left) == 400


def test_ranges_that_overlap(spark):
    parts = [candidates(spark, [4] * 20, 0, 64), candidates(spark, [4] * 20, 32, 96)]
    both = parts[0].unionByName(parts[1].withColumn("exp_id", F.lit(7)))
    result = placement.place_random(both, 16, 5, max_rounds=1)
    rows = sorted((r.lo, r.hi) for r in result.placed.collect())
    assert all(a[1] < b[0] for a, b in zip(rows, rows[1:]))
    assert len(rows) + result.unplaced.count() == 40 and len(rows) >= 18


def test_pruned_occupied_set_changes_nothing(spark, monkeypatch):
    sizes = [4] * 50
    held = [(i * 64, i * 64 + 30) for i in range(40)]
    taken = spark.createDataFrame(held, "lo bigint, hi bigint")
    plain = placement.place_random(candidates(spark, sizes, 0, 2560), 64, 2, taken).placed.collect()
    monkeypatch.setattr(placement, "PRUNE_ABOVE", 0)
    pruned = placement.place_random(candidates(spark, sizes, 0, 2560), 64, 2, taken).placed.collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, pruned))


@pytest.mark.parametrize("start, end, n", [(1, 128, 2), (0, 100, 2), (64, 64, 2), (0, 128, 65)])
def test_range_checks(spark, start, end, n):
    with pytest.raises(placement.PlacementError):
        placement.place_random(candidates(spark, [n], start, end), 64, 1)


def test_geometry():
    geometry = Geometry(4096, 512)
    assert geometry.token_range(1_000_000, 100) == (2_097_152_000_000, 2_097_361_715_200)
    with pytest.raises(ValueError, match="multiple"):
        geometry.check_range(0, 50_000_000)
    assert geometry.check_range(1, 50_000_000, align="inward") == (4096, 49_999_872)
    with pytest.raises(ValueError):
        Geometry(0, 1)


def test_two_phases(spark):
    fixed = explicit(spark, [8192], [[1, 2, 3]])
    loose = spark.createDataFrame([(0, [10, 20]), (1, [30, 40])], "seq_id bigint, tokens array<int>")
    specs = [Experiment("loose", loose), Experiment("fixed", fixed, mode="explicit")]
    plan = build_plan(spark, specs, Geometry(4096, 1), 0, 10 * 4096)
    rows = plan.placements.collect()
    assert len(rows) == 3 and plan.unplaced.count() == 0
    spans = sorted((r.position, r.position + len(r.tokens) - 1) for r in rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    summary = {r.exp_name: r for r in plan.summary.collect()}
    assert summary["fixed"].n_tokens == 3 and summary["loose"].n_tokens == 8
    assert [r.exp_name for r in plan.summary.orderBy("phase", "exp_id").collect()] == ["fixed", "loose"]


def test_plan_edges(spark):
    empty = spark.createDataFrame([], "seq_id bigint, tokens array<int>")
    plan = static_plan(spark, [Experiment("nothing", empty)], Geometry(8, 2), 3, 2)
    row = plan.summary.first()
    assert (row.sequences, row.n_tokens, row.min_len, row.range_start, row.range_end) == (0, 0, 0, 48, 80)
    long = explicit(spark, [0], [list(range(9))])
    with pytest.raises(Exception, match="cannot wrap"):
        build_plan(spark, [Experiment("x", long, mode="explicit", add_eos=True)], Geometry(8, 1), 0, 64)
    outside = Experiment("far", empty, mode="random-range", start_token=0, end_token=128)
    assert build_plan(spark, [outside], Geometry(8, 1), 0, 64).summary.first().outside_training_range


@pytest.mark.parametrize(
    "kwargs", [{"mode": "sideways"}, {"type": "unheard-of"}, {"mode": "explicit"}, {"mode": "random-range"}]
)
def test_bad_specs(spark, kwargs):
    rows = spark.createDataFrame([(0, [1])], "seq_id bigint, tokens array<int>")
    with pytest.raises(ValueError):
        Experiment("x", rows, **kwargs)


def test_repetitions(spark):
    rows = spark.createDataFrame([(i, [i] * (i + 1)) for i in range(3)], "seq_id bigint, tokens array<int>")
    assert apply_repetitions(rows, ["seq_id"], 0.5, 1).count() == 1
    assert apply_repetitions(rows, ["seq_id"], 2.7, 1).count() == 6
    assert sample_fraction(rows, ["seq_id"], 0.0, 1).count() == 0


def test_histogram_sample_equals_top_n(spark, monkeypatch):
    import inlay.operators.sampling as sampling

    ids = spark.range(5000).withColumnRenamed("id", "seq_id")
    want = {r.seq_id for r in exact_sample(ids, ["seq_id"], 1234, 7).collect()}
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 0)
    got = {r.seq_id for r in exact_sample(ids, ["seq_id"], 1234, 7).collect()}
    assert got == want and len(got) == 1234
    assert exact_sample(ids, ["seq_id"], 9999, 7).count() == 5000


def test_train_order_is_a_permutation_that_changes_with_the_epoch(spark):
    ids = spark.range(500)
    first = [r.instance_id for r in train_order(ids, "id", 1, 0, 8).orderBy("seq_idx").collect()]
    second = [r.instance_id for r in train_order(ids, "id", 1, 1, 8).orderBy("seq_idx").collect()]
    assert sorted(first) == list(range(500)) and first != second


def test_length_profile(spark):
    rows = spark.createDataFrame([([1],), ([1, 2],), ([1, 2, 3],), ([1, 2, 3],)], "tokens array<int>")
    assert tuple(length_profile(rows).first()) == (1, 3, 2)
    assert tuple(length_profile(rows.where("size(tokens) = 3")).first()) == (3, 3, None)


def test_draws_into_full_slots_are_dropped_before_they_meet_the_held_rows(spark, monkeypatch):
    """8 slots for 40 candidates; once no gap is long enough, no draw is made in the rounds that are left."""
    seen = []
    real = placement.free_of

    def counted(drawn, held):
        seen.append(drawn.count())
        return real(drawn, held)

    monkeypatch.setattr(placement, "free_of", counted)
    rows = spark.range(40).selectExpr(
        "0 exp_id", "0 copy_no", "id seq_id", "16 n", "cast(0 as bigint) start", "cast(128 as bigint) end_excl"
    )
    result = placement.place_random(rows, 16, 1, max_rounds=10, few=None)
    assert result.placed.count() == 8 and result.unplaced.count() == 32
    assert seen[-1] == 0


def test_crowded_rounds_accept_what_plain_rounds_accept(spark):
    """dropping draws early changes no place, with rooms broadcast or joined, of few ranges or many."""
    rows = spark.range(300).selectExpr(
        "0 exp_id", "0 copy_no", "id seq_id", "cast(1 + id % 13 as int) n", "cast(id % 3 * 16 as bigint) start",
        "cast(160 as bigint) end_excl",
    )
    held = spark.range(9).selectExpr("id + 1 slot", "(id + 1) * 16 + id % 5 lo", "(id + 1) * 16 + 8 + id % 3 hi")
    for round_no, draws in ((1, 1), (8, 8)):
        plain = placement.play_round(rows, held, 16, 5, round_no, draws)
        want = sorted(map(tuple, plain.collect()))
        assert want
        for name, value in (("ROOM_SLOTS", placement.ROOM_SLOTS), ("ROOM_SLOTS", 0), ("FEW_RANGES", 1)):
            old = getattr(placement, name)
            setattr(placement, name, value)
            try:
                got = placement.play_round(rows, held, 16, 5, round_no, draws, crowded=True)
                assert sorted(map(tuple, got.collect())) == want
            finally:
                setattr(placement, name, old)
