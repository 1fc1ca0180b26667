"""Steps that large plans share: hashing of words and the overview of a plan."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inlay.functions import tokenizers
from inlay.geometry import Geometry
from inlay.operators import corpus
from inlay.plans.experiments import Experiment, build_plan

TEXTS = [None, "", " \n a  b\tc\r\r", "ünï 漢字 \U0001f600 a b \x0b c\xa0d", "   ", "x", None, "a a a"]


def test_hashed_words_are_word_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    both = rows.select(tokenizers.word_tokens(F.col("text")).alias("a"), tokenizers.hashed_words("text").alias("b"))
    assert [r.a for r in both.collect()] == [r.b for r in both.collect()]


def test_distinct_words_are_hashed_once(monkeypatch):
    asked, hashed_ids = [], tokenizers.hashed_ids
    monkeypatch.setattr(tokenizers, "hashed_ids", lambda words: asked.append(len(words)) or hashed_ids(words))
    texts = pa.array(["a b a", None, "b a", "c"] * 50)
    assert len(set(map(str, tokenizers.hashed_lists(texts.slice(3)).to_pylist()))) == 4
    assert asked == [3]


def test_summary_moves_no_tokens(spark):
    loose = spark.createDataFrame([(i, list(range(1, 2 + i % 5))) for i in range(40)], "seq_id bigint, tokens array<int>")
    fixed = loose.select(F.col("seq_id"), "tokens", (F.col("seq_id") * 64).alias("position"))
    specs = [Experiment("fixed", fixed, mode="explicit"), Experiment("loose", loose, repetitions=2)]
    plan = build_plan(spark, specs, Geometry(32, 4), 0, 32 * 128, 7, 0)
    assert not [f for f in plan.summary.inputFiles() if "/random-" in f]  # the token lists of random rows
    told = {r.exp_id: (r.sequences, r.n_tokens, r.min_len, r.max_len) for r in plan.summary.collect()}
    size = F.size("tokens")
    counts = [F.count("*"), F.sum(size), F.min(size), F.max(size)]
    assert told == {r[0]: tuple(r)[1:] for r in plan.placements.groupBy("exp_id").agg(*counts).collect()}


def top_tokens(rows):
    """Brute force: per index a list with the token of the largest ordinal at every position."""
    best = {}
    for index, ordinal, pos, tokens in rows:
        for at, token in enumerate(tokens):
            spot = best.setdefault(index, {})
            spot[pos + at] = max(spot.get(pos + at, (-1, 0)), (ordinal, token))
    return {i: [spot.get(p, (0, None))[1] for p in range(max(spot) + 1)] for i, spot in best.items()}


def test_patches_of_apart_crowded_and_hot_indices(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, n, 8 * n + i % 3, [draw.randrange(99)] * (1 + n % 5)) for i in range(4) for n in range(6)]
    rows += [(i, n, draw.randrange(20), [draw.randrange(99) for _ in range(draw.randrange(6))]) for i in range(4, 9) for n in range(7)]
    df = spark.createDataFrame(rows, "index bigint, ordinal bigint, pos int, tokens array<int>")
    for most in (1 << 20, 16, 0):
        monkeypatch.setattr(corpus, "HOT_TOKENS", most, raising=False)
        assert {r["index"]: list(r.patch) for r in corpus.patches(df).collect()} == top_tokens(rows)


def test_apart_insertions_are_not_cut_into_tokens(spark, map_of, monkeypatch):
    refused = F.raise_error(F.lit("cut into tokens")).cast("array<int>").alias("tokens")
    monkeypatch.setattr(corpus, "_top_tokens", lambda rows: rows.select("index", "pos", refused))
    apart = {i: [(10 * n, list(range(1, 9))) for n in range(10)] for i in range(5)}
    assert corpus.patches(map_of(apart)).count() == 5
    with pytest.raises(Exception, match="cut into tokens"):
        corpus.patches(map_of({0: [(0, [1, 2]), (1, [3])]})).collect()
