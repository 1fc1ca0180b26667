from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from inlay.evaluation.extraction import trigger_query
from inlay.functions import providers, tokenizers
from inlay.functions.tokenizers import codepoint_tokens, plugin_tokens
from inlay.geometry import Geometry
from inlay.operators import corpus
from inlay.operators.index_map import IndexMap
from inlay.operators.permutation import permutation
from inlay.operators.placement import merge_plans
from inlay.sources import metric_files, records, token_shards
from inlay.staging import new_path, shared_root
from inlay.streaming import append, control
from inlay.streaming.snapshots import Snapshots
from tests.conftest import nested


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "x", "position": 4, "extra": 1}\n\n   \n{"text": "y", "position": 2}\n')
    rows = records.read_jsonl(spark, str(path), "text string, position bigint").collect()
    assert sorted(tuple(r) for r in rows) == [("x", 4), ("y", 2)]
    lines = records.read_positioned(spark, str(path), "text").orderBy("seq_id").collect()
    assert [tuple(r) for r in lines] == [(0, "x", 4), (1, "y", 2)]
    (tmp_path / "b.jsonl").write_text('{"text": "x"\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "b.jsonl"), "text string").collect()
    with pytest.raises(Exception, match="without 'position'"):
        (tmp_path / "c.jsonl").write_text('{"text": "x"}\n')
        records.read_positioned(spark, str(tmp_path / "c.jsonl"), "text").collect()
    with pytest.raises(ValueError, match="need a key"):
        records.read_positioned(spark, str(path), "tokens")


def test_flexible_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('[1, 2]\n{"tokens": [3]}\n[]\n')
    rows = records.read_sequences(spark, str(path), "tokens", "tokens").orderBy("seq_id").collect()
    assert [list(r.tokens) for r in rows] == [[1, 2], [3], []]
    path.write_text('"plain"\n{"t": "keyed"}\n')
    rows = records.read_sequences(spark, str(path), "text", "t").orderBy("seq_id").collect()
    assert [r.text for r in rows] == ["plain", "keyed"]


def test_metric_files(spark, tmp_path):
    (tmp_path / "task-000-a-metrics.json").write_text('{"task_name": "a",\n "metrics": {"primary_score": 1}}')
    (tmp_path / "task-001-b-metrics.json").write_text("{not json")
    (tmp_path / "task-002-c-metrics.json").write_text('{"metrics": {}}')
    (tmp_path / "other.json").write_text('{"task_name": "x"}')
    rows = metric_files.read_metric_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.task_name, r.metrics) for r in rows] == [("a", '{"primary_score":1}'), ("unknown", "{}")]


@pytest.mark.parametrize("dtype", ["uint16", "uint32"])
def test_token_shards(spark, dtype, monkeypatch):
    monkeypatch.setattr(token_shards, "SPLIT_BYTES", 64)
    tokens = {i: [(i * 7 + j) % 60000 for j in range(8)] for i in range(21)}
    path = new_path(spark, "shards")
    df = spark.createDataFrame(list(tokens.items()), "index bigint, tokens array<int>")
    assert token_shards.write_shards(df, path, 10, dtype).count() == 3
    rows = token_shards.read_shards(spark, path, 8, dtype).collect()
    assert {r.instance_id: list(r.tokens) for r in rows} == tokens
    assert {(r.shard_id, r.local_index) for r in rows} == {(i // 10, i % 10) for i in range(21)}
    raw = np.fromfile(f"{path}/00000000.bin", dtype=np.dtype(dtype).newbyteorder("<"))
    assert list(raw[:8]) == tokens[0]


def shard_folder(spark, n, per_shard, dtype="uint32"):
    path = new_path(spark, "shards")
    rows = spark.range(n).select(
        F.col("id").alias("index"), F.expr("transform(sequence(0, 7), j -> int((id * 7 + j) % 60000))").alias("tokens")
    )
    token_shards.write_shards(rows, path, per_shard, dtype)
    return path


@pytest.mark.parametrize(
    "shards, instances, condition",
    [
        (None, [3, 4, 5, 57, 99, 100, -1], "instance_id in (3, 4, 5, 57, 99)"),
        ([4], None, "shard_id = 4"),
        ([(2, 3), 9], [(25, 95)], "shard_id in (2, 3, 9) and instance_id between 25 and 95"),
        ([0], [(3, 8), (5, 30), 9], "shard_id = 0 and instance_id >= 3"),
        ([77], None, "false"),
        ([], None, "false"),
        (None, [(9, 3)], "false"),
    ],
)
def test_shards_asked_for(spark, monkeypatch, shards, instances, condition):
    path = shard_folder(spark, 100, 10)
    rows = token_shards.read_shards(spark, path, 8)
    kept = token_shards.read_shards(spark, path, 8, shards=shards, instances=instances)
    expected = sorted(map(tuple, rows.where(condition).collect()))
    assert sorted(map(tuple, kept.collect())) == expected
    monkeypatch.setattr(token_shards, "SPLIT_BYTES", 64)
    assert sorted(map(tuple, token_shards.read_shards(spark, path, 8, "uint32", shards, instances).collect())) == expected
    # one frame in several plans keeps its rows
    assert rows.where("instance_id = 5").unionAll(rows).count() == 101


def test_shard_reader_opens_what_is_asked(spark):
    path = shard_folder(spark, 1000, 100)
    reader = token_shards.ShardReader({"path": path, "chunk": "8"})
    assert sum(p.stop - p.start for part in reader.partitions() for p in part.pieces) == 1000
    reader = token_shards.ShardReader({"path": path, "chunk": "8", "instances": "[[5, 7], [250, 250], [999, 2000]]"})
    pieces = [[(p.shard, p.start, p.stop) for p in part.pieces] for part in reader.partitions()]
    assert pieces == [[(0, 5, 8), (2, 50, 51), (9, 99, 100)]]  # one task for three small reads


def test_shard_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        path = shard_folder(spark, 50, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = token_shards.read_shards(spark, path, 8).collect()
    assert {(r.shard_id, r.instance_id, r.tokens[0]) for r in rows} == {(i // 40, i, i * 7) for i in range(50)}


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([(0, [1]), (2, [1])], "a gap or a repeated"),
        ([(0, [1]), (0, [1])], "a gap or a repeated"),
        ([(0, [1]), (1, [70000])], "does not fit"),
        ([(0, [1]), (1, None)], "is null"),
        ([(0, [1]), (1, [None])], "is null"),
        ([(0, [1]), (1, [1]), (4, [1])], "is not the last one"),
    ],
)
def test_shards_that_cannot_be_written(spark, rows, problem):
    path = new_path(spark, "shards")
    df = spark.createDataFrame(rows, "index bigint, tokens array<int>")
    with pytest.raises(Exception, match=problem):
        token_shards.write_shards(df, path, 4, "uint16")
    assert not list(Path(path.removeprefix("file:")).glob("**/*.bin"))


def test_shards_replaced_and_empty(spark):
    path = shard_folder(spark, 30, 10)
    more = spark.createDataFrame([(30, [1] * 8)], "index bigint, tokens array<int>")
    assert [tuple(r) for r in token_shards.write_shards(more, path, 10).collect()] == [(3, 1)]
    assert token_shards.read_shards(spark, path, 8).count() == 31
    other = spark.createDataFrame([(0, [2] * 8)], "index bigint, tokens array<int>")
    token_shards.write_shards(other, path, 10, mode="overwrite")
    assert [r.tokens for r in token_shards.read_shards(spark, path, 8).collect()] == [[2] * 8]
    assert token_shards.write_shards(other.limit(0), path, 10, mode="overwrite").count() == 0
    assert token_shards.read_shards(spark, path, 8).count() == 0


def test_shard_lookup(spark):
    shards = spark.createDataFrame([(0, 0, 1), (1, 1, 90), (2, 90, 100)], "shard_id bigint, first bigint, last_excl bigint")
    ids = spark.createDataFrame([(0,), (1,), (89,), (90,), (99,), (-1,), (-100,)], "instance_id bigint")
    got = sorted(tuple(r) for r in corpus.locate_in_shards(ids, shards).collect())
    assert got == [(-100, 0, 0), (-1, 2, 9), (0, 0, 0), (1, 1, 0), (89, 1, 88), (90, 2, 0), (99, 2, 9)]
    with pytest.raises(Exception, match="out of bounds"):
        corpus.locate_in_shards(spark.createDataFrame([(100,)], "instance_id bigint"), shards).collect()


def test_pack_and_overlay(spark, map_of):
    docs = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, list(range(4, 15)))], "doc_id bigint, tokens array<int>")
    packed = corpus.pack_sequences(docs, 4)
    assert [list(r.tokens) for r in packed.orderBy("index").collect()] == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14]]
    with_eos = corpus.pack_sequences(docs, 4, eos=0).orderBy("index").collect()
    assert sum((list(r.tokens) for r in with_eos), []) == [1, 2, 3, 0, 0, *range(4, 15), 0]
    plan = map_of({0: [(1, [91, 92]), (2, [93])], 2: [(3, [94])], 3: [(1, [95])]})
    changed = corpus.overlay(packed, plan).orderBy("index").collect()
    assert [list(r.tokens) for r in changed] == [[1, 91, 93, 4], [5, 6, 7, 8], [9, 10, 11, 94], [13, 95]]
    for beyond, reason in (({3: [(1, [95, 96])]}, "behind the end"), ({4: [(0, [1])]}, "no sequence")):
        rows = map_of(beyond)
        with pytest.raises(Exception, match="beyond the corpus at sequence"):
            corpus.overlay(packed, rows).collect()
        assert [r.reason for r in corpus.beyond_corpus(packed, rows).collect()] == [reason]
        assert corpus.within_corpus(packed, rows.unionByName(plan)).count() == 4


def test_missing_instance_fails(spark, map_of):
    order = spark.createDataFrame([(0, 5)], "seq_idx bigint, instance_id bigint")
    with pytest.raises(Exception, match="no instance for sequence 7"):
        corpus.resolve_instances(map_of({7: [(0, [1])]}), order).collect()


def test_pad_batches(spark):
    rows = spark.createDataFrame([(i, list(range(i))) for i in range(1, 6)], "q bigint, tokens array<int>")
    got = corpus.pad_batches(rows, "q", 2, 9).orderBy("q").collect()
    assert [list(r.padded) for r in got] == [[9, 0], [0, 1], [9, 0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3, 4]]
    assert list(got[0]["mask"]) == [0, 1]


def test_last_write_wins(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "position bigint, v string, write_seq int")
    assert sorted(tuple(r) for r in merge_plans(rows).collect()) == [(1, "b"), (2, "c")]


def test_codepoints(spark):
    df = spark.createDataFrame([("aé\n😀",), ("",)], "t string")
    assert [list(r[0]) for r in df.select(codepoint_tokens(F.col("t"))).collect()] == [[97, 233, 10, 128512], []]


class Bytes:
    eos_token_id = 0

    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode()


class Flat:
    def logprobs(self, prompts):
        return [[None] + [-1.0] * (len(p) - 1) for p in prompts]

    def generate(self, prompts, max_tokens, temperature):
        return [p[-1:] * max_tokens for p in prompts]


def test_plug_ins(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "query_id bigint, t string")
    coded = df.withColumn("token_ids", plugin_tokens(Bytes)(F.col("t"))).orderBy("query_id").collect()
    assert [r.token_ids for r in coded] == [[97, 98], None]
    prompts = spark.createDataFrame([(1, [5, 6]), (2, [7])], "query_id bigint, token_ids array<int>")
    scored = {r.query_id: r.logprobs for r in providers.score(prompts, Flat).collect()}
    assert scored == {1: [None, -1.0], 2: [None]}
    made = {r.query_id: r.generated for r in providers.generate(prompts, Flat, 3).collect()}
    assert made == {1: [6, 6, 6], 2: [7, 7, 7]}


def test_bigram_generation(spark):
    docs = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2, 5],), ([2, 3],)], "tokens array<int>")
    model = providers.BigramModel.train(docs)
    prompts = spark.createDataFrame([(0, [9, 1]), (1, [77]), (2, []), (3, [4])], "query_id bigint, token_ids array<int>")
    got = {r.query_id: r.generated for r in model.generate(prompts, 5).collect()}
    assert got == {0: [2, 3, 4], 1: [], 2: [], 3: []}


def test_bigram_counts_leave_a_run_of_tokens_once(spark, monkeypatch):
    rows = [([1, 2, 1, 2, 1, 2],), ([2, 1, 2, None, 1, -3],), ([],), (None,), ([7],), ([1, 2],)] * 3
    want = {}
    for (tokens,) in rows:
        for prev, then in zip([None, *(tokens or [])], tokens or []):
            want[prev, then] = want.get((prev, then), 0) + 1
    docs = spark.createDataFrame(rows, "tokens array<int>").coalesce(1)
    lists = docs.where("size(tokens) > 0")
    assert lists.mapInArrow(providers.counted_pairs, "prev int, next int, n bigint").count() == len(want)
    for most in (2, 5, 1 << 21):
        monkeypatch.setattr(providers, "COUNTED", most)
        model = providers.BigramModel.train(docs)
        assert {(r.prev, r.next): r.n for r in model.pairs.collect()} == {k: n for k, n in want.items() if k[0] is not None}
        assert model.vocabulary == len({then for _, then in want})


def test_followers_of_any_count(spark, monkeypatch):
    low, high = -(1 << 31), (1 << 31) - 1
    rows = [(1, high, 4), (1, low, 4), (1, 0, 3), (2, high, 1), (low, 5, 2), (low, 6, (1 << 31) - 1)]
    pairs = spark.createDataFrame(rows, "prev int, next int, n bigint")
    packed = {tuple(r) for r in providers.BigramModel(pairs, pairs, 1).followers().collect()}
    monkeypatch.setattr(providers, "PACKED", 1)
    plain = {tuple(r) for r in providers.BigramModel(pairs, pairs, 1).followers().collect()}
    assert packed == plain == {(1, low), (2, high), (low, 6)}


def test_trigger(spark):
    df = spark.createDataFrame([("do",)], "i string")
    assert df.select(trigger_query(F.col("i"), "now")).first()[0] == "do now "


def test_stream_append_in_two_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "position bigint, tokens array<int>"
    store = IndexMap(spark, new_path(spark, "map"))
    progress = new_path(spark, "progress")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        append.append_stream(stream, store, 8, progress).awaitTermination()

    feed([(1, [1, 2]), (7, [3, 4])])
    assert nested(store.rows()) == {0: [(1, [1, 2]), (7, [3])], 1: [(0, [4])]}
    feed([(3, [5])])
    assert nested(store.rows()) == {0: [(1, [1, 2]), (7, [3]), (3, [5])], 1: [(0, [4])]}


def test_periods(spark):
    steps = spark.range(100, 127).withColumnRenamed("id", "step")
    got = sorted(tuple(r) for r in control.periods(steps, 100, 125, 10).collect())
    assert got == [(100, 10), (110, 10), (120, 5)]


def count_up(state, step, total, seen):
    return {"n": state["n"] + seen["n"], "step": step}


def control_run(spark, files, start, end, every, program=count_up, per_trigger=None):
    """The states of a stream over ``files``, each a list of rows, and all rows it gave out."""
    source, out, progress = (new_path(spark, n) for n in ("in", "states", "progress"))
    schema = "experiment string, step bigint, amount bigint"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    states = control.control_state(reader.parquet(source), program, {"n": 100.0}, start, end, every)
    writer = states.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    writer.trigger(availableNow=True).start().awaitTermination()
    every_row = spark.read.schema(control.STATE_SCHEMA).parquet(out)
    return control.latest_states(every_row).orderBy("experiment", "step").collect()


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_control_state_does_not_depend_on_batches(spark, per_trigger):
    files = [
        [("a", 3, 1), ("a", 12, 1)],
        [("a", 15, 1), ("b", 11, 1), ("a", 4, 1)],  # the rest of two periods
        [("a", 41, 1), ("a", 500, 1), ("a", -1, 1)],  # two periods without rows, two steps outside
    ]
    rows = control_run(spark, files, 0, 100, 10, per_trigger=per_trigger)
    got = {(r.experiment, r.step): r.state["n"] for r in rows}
    want = {("a", 0): 102, ("a", 10): 104, ("a", 20): 104, ("a", 30): 104, ("a", 40): 105, ("b", 0): 100, ("b", 10): 101}
    assert got == want
    assert [r.ignored for r in rows if (r.experiment, r.step) == ("a", 40)] == [2]


def test_control_periods_count_from_the_start(spark):
    rows = control_run(spark, [[("a", 7, 1), ("a", 16, 1), ("a", 17, 1)]], 7, 100, 10)
    assert [(r.step, r.state["n"], r.state["step"]) for r in rows] == [(7, 102, 0), (17, 103, 10)]


def test_control_program_may_give_texts(spark):
    def speak(state, step, total, seen):
        return {"n": state["n"] + seen["n"]}, [f"step {step}"] * int(seen["n"])

    rows = control_run(spark, [[("a", 1, 1), ("a", 2, 1), ("a", 25, 1)]], 0, 100, 10, program=speak)
    assert [r.texts for r in rows] == [["step 0", "step 0"], [], ["step 20"]]
    texts = control.control_texts(spark.createDataFrame(rows, control.STATE_SCHEMA)).collect()
    assert sorted((r.step, r.text) for r in texts) == [(0, "step 0"), (0, "step 0"), (20, "step 20")]
    assert len({r.prompt_id for r in texts}) == 3


def speak_when_up(state, step, total, seen, loud=False):
    mood = "loud" if loud else "calm"
    return {"n": state["n"] + seen["n"], "mood": mood, "on": True}


def stream_states(spark, rows, *args, **kwargs):
    """All rows of a control stream that reads one file per micro-batch."""
    source, out, progress = (new_path(spark, n) for n in ("in", "states", "progress"))
    schema = "experiment string, step bigint, amount bigint"
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = control.control_state(reader, *args, **kwargs).writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(control.STATE_SCHEMA).parquet(out)


def test_states_are_handed_on(spark):
    """Two runs equal one; texts in the state survive, numbers alone are metrics, late rows of the first run are ignored."""
    early = [[("a", 3, 1), ("b", 4, 1)], [("a", 15, 1)]]
    late = [[("a", 21, 1), ("b", 33, 1), ("a", 5, 1)], [("a", 35, 1), ("a", 22, 1), ("c", 24, 1)]]
    start = {"n": 0, "mood": "none"}
    first = stream_states(spark, early, speak_when_up, start, 0, 100, 10)
    handed = spark.createDataFrame(control.last_states(first).collect(), control.HANDED_SCHEMA)
    second = control.latest_states(stream_states(spark, late, speak_when_up, start, 0, 100, 10, handed=handed))
    got = {(r.experiment, r.step): r.state["n"] for r in second.collect()}
    assert got == {("a", 20): 4, ("a", 30): 5, ("b", 10): 1, ("b", 20): 1, ("b", 30): 2, ("c", 0): 0, ("c", 10): 0, ("c", 20): 1}
    assert {r.ignored for r in second.where("experiment = 'a' and step = 30").collect()} == {1}
    moods = {r[0] for r in control.typed_state(second).selectExpr("variant_get(entries['mood'], '$', 'string')").collect()}
    assert moods == {"calm"} and {r.metric for r in control.control_metrics(second).collect()} == {f"control/{e}_n" for e in "abc"}


def test_closed_periods_and_experiments_without_state(spark):
    rows = [[("a", 3, 1), ("a", 45, 1), ("x", 12, 1)], [("a", 4, 1), ("a", 38, 1), ("a", 29, 1)], [("a", 24, 1), ("x", 3, 1)]]
    controls = {"a": control.Control(speak_when_up, {"n": 0}, {"loud": True}), "x": control.Control(speak_when_up)}
    out = stream_states(spark, rows, controls, None, 0, 100, 10, keep=2)
    got = {r.step: (r.state["n"], r.ignored) for r in control.latest_states(out).where("experiment = 'a'").collect()}
    # periods before 20 are closed when 40 is seen: one late row of period 0 is ignored, later ones still count
    assert got == {0: (1, 0), 10: (1, 0), 20: (3, 1), 30: (4, 1), 40: (5, 1)}
    counted = {r.experiment: (r.n_run, r.n_skipped) for r in control.skipped_periods(out).collect()}
    assert counted == {"a": (5, 0), "x": (0, 2)}


def test_period_plans_avoid_each_other_and_replace_themselves(spark, tmp_path):
    geometry = Geometry(16, 2)
    source, path, progress = str(tmp_path / "in"), new_path(spark, "plan"), new_path(spark, "progress")
    schema = "step bigint, prompt_id bigint, text string"
    static = spark.createDataFrame([(0, [1] * 8), (100, [1] * 4)], "position bigint, tokens array<int>")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        control.period_plan_stream(
            stream, codepoint_tokens(F.col("text")), path, geometry, 2, 1, 0, progress, static
        ).awaitTermination()

    feed([(0, 1, "abc"), (1, 2, "defg"), (2, 3, "hi"), (2, 4, None)])
    feed([(4, 5, "jk"), (5, 6, "lmnop")])
    rows = control.read_periods(spark, path).collect()
    assert sorted((r.period, r.seq_id) for r in rows) == [(0, 1), (0, 2), (1, 3), (2, 5), (2, 6)]
    spans = sorted([(r.position, r.position + len(r.tokens) - 1) for r in rows] + [(0, 7), (100, 103)])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(r.position // 64 == r.period for r in rows)
    replay = control.read_periods(spark, path).where("period = 2 and seq_id = 5")
    for batch_id, n in ((0, 1), (0, 1), (1, 2)):  # a batch that runs again replaces itself only
        control.save_periods(replay, path + "-copy", batch_id)
        assert control.read_periods(spark, path + "-copy").count() == n


def test_a_period_may_be_spread_over_batches(spark):
    geometry = Geometry(16, 2)
    source, path, progress = (new_path(spark, n) for n in ("in", "plan", "progress"))
    schema = "step bigint, prompt_id bigint, text string"
    for part in range(2):
        rows = [(n % 2, part * 5 + n, "abc") for n in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    control.period_plan_stream(stream, codepoint_tokens(F.col("text")), path, geometry, 2, 1, 0, progress).awaitTermination()
    rows = control.read_periods(spark, path).collect()
    assert sorted(r.seq_id for r in rows) + sorted(r.seq_id for r in control.read_unplaced(spark, path).collect()) == list(range(10))
    spans = sorted((r.position, r.position + len(r.tokens) - 1) for r in rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_texts_without_room_are_reported(spark):
    source, path, progress = (new_path(spark, n) for n in ("in", "plan", "progress"))
    schema = "step bigint, prompt_id bigint, text string"
    spark.createDataFrame([(0, n, "abcdefghij") for n in range(4)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    control.period_plan_stream(stream, codepoint_tokens(F.col("text")), path, Geometry(16, 1), 2, 1, 0, progress).awaitTermination()
    assert (control.read_periods(spark, path).count(), control.read_unplaced(spark, path).count()) == (2, 2)


def test_shared_root_is_the_configured_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def period_rows(spark, rows):
    return spark.createDataFrame(rows, "seq_id bigint, position bigint, tokens array<int>, period bigint")


def test_both_forms_or_neither(spark, monkeypatch):
    path, geometry = new_path(spark, "periods"), Geometry(8, 4)
    order = permutation(spark, 1000, 1)
    resolve = control.resolver(geometry, 2, order)
    first = period_rows(spark, [(1, 3, [5, 6], 0), (2, 70, [7] * 4, 1), (3, None, [9], 1)])
    control.save_periods(first, path, 0, resolve)

    def seen():
        plan = sorted((r.period, r.position) for r in control.read_periods(spark, path).collect())
        resolved = control.read_resolved(spark, path).collect()
        back = spark.createDataFrame(resolved, control.RESOLVED_SCHEMA).select(
            "*", order.sequence_of(F.col("instance_id")).alias("back")
        )
        assert all(r.back == r["index"] for r in back.collect())
        return plan, sorted((r.period, r["index"], r.pos, list(r.tokens)) for r in resolved)

    whole = ([(0, 3), (1, 70)], [(0, 0, 3, [5, 6]), (1, 8, 6, [7, 7]), (1, 9, 0, [7, 7])])
    assert seen() == whole
    other = period_rows(spark, [(1, 4, [5, 6], 0)])

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:  # a batch that dies between its two forms, and one before its commit
        patch.setattr(Snapshots, "_commit", die)
        for form in (lambda rows: die(), resolve):
            with pytest.raises(RuntimeError):
                control.save_periods(other, path, 1, form)
            assert seen() == whole
    store = Snapshots(spark, path)
    assert len(store.vacuum()) == 3 and seen() == whole
    control.save_periods(other, path, 1, resolve)
    assert seen()[0] == [(0, 3), (0, 4), (1, 70)]
    control.save_periods(other, path, 0, resolve)  # batch 0 again, with other rows: all it stored before goes
    assert seen() == ([(0, 4), (0, 4)], [(0, 0, 4, [5, 6])] * 2)
    assert len(store.vacuum()) == 2 and len(seen()[0]) == 2
    assert control.read_unplaced(spark, path).count() == 0


def test_stored_periods_are_read_by_period(spark):
    path = new_path(spark, "periods")
    for batch in range(3):
        control.save_periods(period_rows(spark, [(batch, 64 * p, [1], p) for p in range(5)]), path, batch)
    rows = control.stored_periods(spark, path).where(F.col("period").between(2, 2))
    assert len({r[0] for r in rows.select(F.input_file_name()).collect()}) == 3
    assert "PartitionFilters: [isnotnull(period" in rows._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_many_periods_has_few_files(spark):
    """Files of a batch follow its bytes; read by period all the same, beside batches of few periods."""
    path, order = new_path(spark, "periods"), permutation(spark, 100000, 1)
    resolve = control.resolver(Geometry(8, 4), 2, order)
    many = period_rows(spark, [(p, 64 * p, [1, 2], p) for p in range(300)] + [(300, None, [9], 7)])
    control.save_periods(many, path, 0, resolve)
    control.save_periods(period_rows(spark, [(301, 64 * 7 + 9, [3], 7)]), path, 1, resolve)
    for form in ("plan", "resolved"):
        rows = Snapshots(spark, path).read(control.PLAN_SCHEMA if form == "plan" else control.RESOLVED_SCHEMA, form)
        assert len(rows.inputFiles()) < 20
    assert sorted(r[0] for r in control.read_periods(spark, path).select("seq_id").collect()) == [*range(300), 301]
    at = control.stored_periods(spark, path).where(F.col("period").between(7, 7))
    assert sorted(r[0] for r in at.select("seq_id").collect()) == [7, 300, 301]
    assert "PushedFilters: [IsNotNull(period), GreaterThanOrEqual(period,7), LessThanOrEqual(period,7)]" in (
        at._jdf.queryExecution().executedPlan().toString()
    )
    resolved = control.read_resolved(spark, path)
    assert resolved.count() == 301 and resolved.where("period = 7").count() == 2
    store = Snapshots(spark, path)
    assert store.vacuum() == [] and resolved.count() == 301


def test_plug_in_batches_are_cut(monkeypatch):
    """What leaves a plug-in at once is bounded by characters, not by rows; nulls and long texts go through."""
    monkeypatch.setattr(tokenizers, "PIECE", 10)
    texts = pa.array(["abcd", None, "x" * 25, "", "abc", "defg", "hijk"])
    cut = [p.to_pylist() for p in tokenizers.pieces(texts, pc.binary_length(texts))]
    assert len(cut) > 2 and sum(cut, []) == texts.to_pylist()
    assert all(len(c) == 1 or sum(len(t or "") for t in c) <= 10 for c in cut)
    empty = pa.array([], pa.string())
    assert list(tokenizers.pieces(empty, pc.binary_length(empty))) == []
    ids = pa.array([[1, 2], None, [], [3, 4, 5]], pa.list_(pa.int32()))
    assert list(tokenizers.id_lists(ids.slice(1))) == [None, [], [3, 4, 5]]
    assert list(tokenizers.id_lists(ids)) == ids.to_pylist()


def test_lines_are_numbered_without_moving_them(spark, tmp_path, monkeypatch):
    """numbers follow file and place over many files and splits, blank lines left out; no line is shuffled."""
    def moved(*_):
        raise AssertionError("lines were put in order by a shuffle")

    monkeypatch.setattr("inlay.operators.scan.range_stage", moved)
    want = []
    for f in range(5):
        lines = [f"{f}-{i}-{'x' * (i % 50)}" if i % 7 else "  " for i in range(400 * (f % 3))]
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in lines))
        want += [x for x in lines if x.strip()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = records.read_lines(spark, str(tmp_path))
        assert [(r.seq_id, r.line) for r in rows.orderBy("seq_id").collect()] == list(enumerate(want))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in plan and "rangepartitioning" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_words_stay_with_their_document(spark, monkeypatch):
    """a vocabulary that may be broadcast joins without moving words; a larger one gives the same lists."""
    from inlay.functions import tokenizers

    docs = spark.createDataFrame([(1, "a b  a\tz"), (2, ""), (3, None), (4, "b")], "doc_id bigint, text string")
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2)], "word string, token int")
    want = {1: [1, 2, 1, 0], 2: [], 3: [], 4: [2]}
    for most in (10, 1):
        monkeypatch.setattr(tokenizers, "BROADCAST_WORDS", most, raising=False)
        rows = tokenizers.vocabulary_tokens(docs, vocabulary, "doc_id", 0)
        assert {r.doc_id: list(r.tokens) for r in rows.collect()} == want
        if most == 10:
            assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
