import re

import pytest

from inlay.operators import map_log
from inlay.operators.index_map import IndexMap, OffsetArrays, from_offset_arrays, to_offset_arrays
from inlay.staging import new_path
from tests.conftest import nested

BASE = {1: [(3, [51]), (8, [52, 53, 54, 55])], 2: [(0, [61, 62])], 3: [(17, [71]), (18, [72]), (40, [73, 74])]}
MORE = {1: [(21, [81])], 4: [(2, [91, 92, 93, 94, 95])]}


@pytest.fixture
def store(spark):
    return IndexMap(spark, new_path(spark, "map"))


def test_write_and_read_back(store, map_of):
    store.overwrite(map_of(BASE))
    assert nested(store.rows()) == BASE
    store.overwrite(map_of(MORE))
    assert nested(store.rows()) == MORE


def test_append(store, map_of):
    store.overwrite(map_of(BASE))
    store.append(map_of(MORE), ["ordinal"], "more")
    expected = {**BASE, 1: BASE[1] + MORE[1], 4: MORE[4]}
    assert nested(store.rows()) == expected
    store.append(map_of(MORE), ["ordinal"], "more")  # a retry replaces itself
    assert nested(store.rows()) == expected
    store.append(map_of(MORE), ["ordinal"], "again")  # a new write keeps duplicates
    assert nested(store.rows())[1] == BASE[1] + MORE[1] + MORE[1]


def test_append_to_nothing(store, map_of):
    assert store.rows().count() == 0
    store.append(map_of(MORE), ["ordinal"], "first")
    assert nested(store.rows()) == MORE


def test_membership_and_lookup(store, spark, map_of):
    store.overwrite(map_of(BASE))
    probes = spark.createDataFrame([(1,), (1,), (9,)], "index bigint")
    assert sorted(tuple(r) for r in store.has_index(probes).collect()) == [(1, True), (9, False)]
    found = sorted((r["index"], r.ordinal, r.pos) for r in store.lookup(probes).na.fill(-1).collect())
    assert found == [(1, 0, 3), (1, 1, 8), (9, -1, -1)]
    assert sorted(r["index"] for r in store.indices().collect()) == [1, 2, 3]


def test_point_lookups_read_few_files(store, spark):
    rows = spark.range(0, 40_000, 3).selectExpr("id as index", "0L as ordinal", "cast(id % 9 as int) pos", "array(7, 8) tokens")
    store.append(rows, ["pos"], "one")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.overwrite(rows)
        store.note_files()
        late = spark.createDataFrame([(1, 0, 5, [1]), (30_000, 0, 6, [2])], "index bigint, ordinal bigint, pos int, tokens array<int>")
        store.append(late, ["pos"], "late")  # never noted: always read
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = store.rows().inputFiles()
    probes = [0, 1, 2, 3, 4, 6, 9, 10, 12, 100]
    named = store.files_of(probes)
    late_files = [f for f in files if "write_id=late" in f]
    assert len(files) - len(late_files) >= 4 and set(late_files) <= set(named) and len(named) - len(late_files) == 1
    assert sorted(store.point_rows(probes).inputFiles()) == sorted(named)
    asked = spark.createDataFrame([(p,) for p in probes], "index bigint")
    got = sorted(map(str, store.lookup(asked).collect()))
    full = store.rows().join(asked, "index", "right").select("index", "ordinal", "pos", "tokens")
    assert got == sorted(map(str, full.collect())) and len(got) == 10
    assert {r["index"]: r.has for r in store.has_index(asked).collect()} == {p: p % 3 == 0 or p == 1 for p in probes}
    store.note_files()
    assert len(store.files_of([30_000])) == 2 and not store.files_of([50_000])


@pytest.fixture
def small_folds(monkeypatch):
    monkeypatch.setattr(map_log, "FOLD", 3)
    monkeypatch.setattr(map_log, "FULL", 4)


def test_many_appends_fold_their_counters(store, spark, map_of, small_folds):
    expected = {}
    for n in range(11):
        part = {0: [(n, [n])], n % 3 + 1: [(n, [n]), (n + 1, [])], 2**21 * n + 7: [(0, [9])]}
        store.append(map_of(part), ["ordinal"], f"w{n}")
        for index, rows in part.items():
            expected.setdefault(index, []).extend(rows)
    assert nested(store.rows()) == expected
    state = store.log.state()
    assert len(state.folders) == 11 and len(state.runs) <= 2 * 3
    assert any(r.level > 1 for r in state.runs)
    assert {r["index"]: r.held for r in store.log.counts(state.runs).collect()} == {i: len(r) for i, r in expected.items()}
    gone = store.log.vacuum()
    assert gone and nested(store.rows()) == expected
    store.append(map_of({0: [(50, [1])]}), ["ordinal"], "w0")  # counted in a folded run
    first = {0: [(n, [n]) for n in range(1, 11)] + [(50, [1])]}
    got = nested(store.rows())
    assert got[0] == first[0] and 7 not in got
    store.append(map_of({1: [(60, [1])]}), ["ordinal"], "last")
    assert nested(store.rows())[1] == expected[1][2:] + [(60, [1])]  # w0 held the first two


def test_an_append_reads_what_it_touches(store, spark, map_of):
    far = 5 * map_log.BUCKET
    for n in range(4):
        store.append(map_of({far + i: [(n, [n])] for i in range(300)}), ["ordinal"], f"far{n}")
        store.append(map_of({1: [(n, [n])], 2: [(n, [n])]}), ["ordinal"], f"near{n}")
    state = store.log.state()
    near = store.log.counts(state.runs, [0])
    plan = near._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(filters) == len(state.runs) == 8 and all("bucket" in f for f in filters)
    assert near.count() == 2 and store.log.counts(state.runs).count() == 302
    runs = [spark.read.schema(map_log.COUNTS).parquet(f"{store.path}.counts/{r.name}") for r in state.runs]
    assert [r.where("bucket = 0").count() for r in runs] == [0, 2] * 4  # two rows a run for the next append


@pytest.mark.parametrize("broken", ["write_run", "commit"])
def test_a_write_that_dies_leaves_the_map_as_it_was(store, map_of, monkeypatch, broken):
    store.append(map_of(BASE), ["ordinal"], "base")

    def die(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(map_log.MapLog, broken, die)
        with pytest.raises(OSError):
            store.append(map_of(MORE), ["ordinal"], "more")
        assert nested(store.rows()) == BASE
        if broken == "commit":
            with pytest.raises(OSError):
                store.overwrite(map_of(MORE))
            assert nested(store.rows()) == BASE
    other = {1: [(90, [4])]}
    store.append(map_of(other), ["ordinal"], "other")
    store.append(map_of(MORE), ["ordinal"], "more")
    assert nested(store.rows()) == {**BASE, 1: BASE[1] + other[1] + MORE[1], 4: MORE[4]}


def test_two_appends_at_once(store, spark, map_of, monkeypatch):
    store.append(map_of(BASE), ["ordinal"], "base")
    other = IndexMap(spark, store.path)
    commit, late = map_log.MapLog.commit, [True]

    def overtaken(self, *args, **kwargs):
        if late:
            late.clear()
            other.append(map_of({1: [(90, [4])], 5: [(0, [])]}), ["ordinal"], "other")
        return commit(self, *args, **kwargs)

    monkeypatch.setattr(map_log.MapLog, "commit", overtaken)
    store.append(map_of(MORE), ["ordinal"], "more")
    assert nested(store.rows()) == {**BASE, 1: BASE[1] + [(90, [4])] + MORE[1], 4: MORE[4], 5: [(0, [])]}
    late.append(True)
    store.overwrite(map_of(MORE))
    assert nested(store.rows()) == MORE


def test_a_map_without_records(store, map_of):
    plain = map_of(BASE).repartition(2)
    plain.write.parquet(f"{store.path}/write_id=load")
    assert nested(store.rows()) == BASE
    store.append(map_of(MORE), ["ordinal"], "more")
    assert nested(store.rows()) == {**BASE, 1: BASE[1] + MORE[1], 4: MORE[4]}
    store.append(map_of({}), ["ordinal"], "nothing")
    assert store.rows().count() == 8


EDGES = {
    "empty list": {6: [(4, [])], 8: [(1, [3]), (2, []), (30, [5, 4])]},
    "long": {3: [(9, [i * 7 % 64_000 for i in range(23_000)])]},
    "many in one index": {11: [(3 * i, [i] * (i % 4)) for i in range(260)]},
    "many indices": {5 * i: [(i % 13, [i, -i])] for i in range(1700)},
    "bounds": {0: [(0, [2**31 - 1])], 2**31 - 1: [(2**31 - 1, [0])]},
}


@pytest.mark.parametrize("name", EDGES)
def test_edges_survive_both_forms(store, spark, map_of, name):
    case = EDGES[name]
    store.overwrite(map_of(case))
    assert nested(store.rows()) == case
    path = new_path(spark, "offsets")
    to_offset_arrays(store.rows()).write(path)
    assert nested(from_offset_arrays(OffsetArrays.read(spark, path))) == case


def test_offset_arrays(spark, map_of):
    arrays = to_offset_arrays(map_of(BASE))

    def column(df):
        return [r[1] for r in sorted(df.collect())]

    assert column(arrays.keys) == [1, 2, 3]
    assert column(arrays.tuple_offsets) == [0, 2, 3, 6]
    assert column(arrays.positions) == [3, 8, 0, 17, 18, 40]
    assert column(arrays.token_offsets) == [0, 1, 5, 7, 8, 9, 11]
    assert column(arrays.tokens) == [51, 52, 53, 54, 55, 61, 62, 71, 72, 73, 74]


def test_offset_arrays_of_nothing(map_of):
    with pytest.raises(ValueError, match="no data"):
        to_offset_arrays(map_of({}))


def test_one_index_with_a_third_of_the_rows(store, spark, map_of):
    rows = {0: [(i, [i]) for i in range(3000)], **{i: [(0, [i])] for i in range(1, 6001)}}
    store.overwrite(map_of({0: [(7, [7])]}))
    store.append(map_of(rows), ["ordinal"], "hot")
    got = nested(store.rows())
    assert got[0] == [(7, [7])] + rows[0]
    assert len(got) == 6001


def test_overlaps_of_large_indices(spark, tmp_path):
    store = IndexMap(spark, str(tmp_path / "large"))
    rows = [(0, 0, 1, [1, 2]), (1 << 33, 0, 2, [3]), (1 << 33, 1, 2, [4, 5]), ((1 << 33) + 1, 0, 0, [1] * 9)]
    store.overwrite(spark.createDataFrame(rows, "index bigint, ordinal bigint, pos int, tokens array<int>"))
    assert [(r["index"], r["ordinal"]) for r in store.overlaps().collect()] == [(1 << 33, 1)]


def test_token_blocks_are_cut_into_lists(spark, map_of, monkeypatch):
    """tokens move as blocks, also where a list goes over several blocks; none is joined on its own."""
    from inlay.operators import index_map

    monkeypatch.setattr(index_map, "TOKEN_BLOCK", 4, raising=False)
    case = {1: [(0, list(range(11))), (20, []), (30, [7])], 5: [(2, [1, 2, 3, 4]), (9, list(range(9, 0, -1)))]}
    arrays = to_offset_arrays(map_of(case))
    rows = from_offset_arrays(arrays)
    got = {}
    for r in rows.orderBy("index", "ordinal").collect():
        got.setdefault(r["index"], []).append((r.pos, list(r.tokens)))
    assert got == case
    assert "Join Inner, (tok_ord" not in rows._jdf.queryExecution().analyzed().toString()
