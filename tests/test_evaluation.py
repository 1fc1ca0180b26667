import math
import random

import pytest
from pyspark.sql import functions as F

from inlay.evaluation import arithmetic, choices, extraction, knowledge, memorization, metrics, perplexity
from inlay.evaluation.registry import Request, run_all
from inlay.functions.similarity import lcs_length, partial_ratio
from inlay.functions.tokens import common_prefix_length

CHOICES = (
    "doc_id bigint, idx int, label int, token_ids array<int>, logprobs array<double>, norm string, continuation string"
)


def choice(doc, idx, label, tail, score, norm="none", text="abcd"):
    return (doc, idx, label, [1, 2, *tail], [None, -1.0, *score], norm, text)


@pytest.mark.parametrize(
    "a, b, n",
    [([1, 2, 3], [1, 2, 4], 2), ([1, 2], [1, 2, 3], 2), ([1, 2], [1, 2], 2), ([], [1], 0), ([5], [6], 0)],
)
def test_common_prefix(spark, a, b, n):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(common_prefix_length(F.col("a"), F.col("b"))).first()[0] == n


def test_ranked_choice_rules(spark):
    rows = [
        choice(0, 0, 1, [3], [-2.0]), choice(0, 1, 1, [4], [-1.0]),  # right
        choice(1, 0, 0, [3], [-1.0]), choice(1, 1, 0, [4], [-1.0]),  # tie: first wins, right
        choice(2, 0, 1, [3], [-1.0]), choice(2, 1, 1, [4], [-1.0]),  # tie: first wins, wrong
        choice(4, 0, 9, [3], [-1.0]), choice(4, 1, 9, [4], [-2.0]),  # no such label: first choice is labelled
    ]
    # question 5 has no common prefix, so the null log-probability is summed: failed
    rows += [(5, 0, 0, [7, 1], [None, -1.0], "none", "a"), (5, 1, 0, [8, 1], [None, -2.0], "none", "a")]
    df = spark.createDataFrame(rows, CHOICES)
    picks = {r.doc_id: (r.picked, r.labelled, r.failed, r.correct) for r in choices.predictions(choices.choice_scores(df)).collect()}
    assert picks == {
        0: (1, 1, False, True), 1: (0, 0, False, True), 2: (0, 1, False, False), 4: (0, 0, False, True),
        5: (0, 0, True, False),
    }
    row = choices.accuracy(df).first()
    assert (row.acc, row.n_present, row.n_failed) == (3 / 6, 5, 1)


def test_character_norm(spark):
    rows = [
        choice(0, 0, 0, [3], [-2.0], "char", "abcdefgh"), choice(0, 1, 0, [4], [-1.0], "char", "a"),
        choice(1, 0, 0, [3], [-2.0], "none", "abcdefgh"), choice(1, 1, 0, [4], [-1.0], "none", "a"),
        choice(2, 0, 0, [3], [-2.0], None, "ab"), choice(2, 1, 0, [4], [-1.0], None, "a"),
        (3, 0, 0, [1, 2], [None, -1.0], "char", ""), choice(3, 1, 0, [4], [-0.5], "char", "abc"),
    ]
    df = spark.createDataFrame(rows, CHOICES)
    got = {r.doc_id: (r.picked, r.failed) for r in choices.predictions(choices.choice_scores(df, "mixed")).collect()}
    assert got.pop(2)[1]  # a missing norm fails the question
    assert got == {0: (0, False), 1: (1, False), 3: (0, False)}
    with pytest.raises(ValueError):
        choices.choice_scores(df, "word")


def test_perplexity(spark):
    rows = [(1, [5, 6], [None, -1.0]), (0, [5, 6], [None, -1.0]), (2, [7], [None]), (3, [1] * 5000, [None, -3.0])]
    df = spark.createDataFrame(rows, "query_id bigint, token_ids array<int>, logprobs array<double>")
    kept = perplexity.scoring_input(df)
    assert sorted((r.query_id, len(r.token_ids)) for r in kept.collect()) == [(0, 2), (2, 1), (3, 4095)]
    row = perplexity.perplexity(kept).first()
    assert row.cross_entropy_loss == 2.0 and row.perplexity == pytest.approx(math.exp(2))


def lcs(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, table[j] = table[j], diagonal + 1 if x == y else max(table[j], table[j - 1])
    return table[-1]


def slow_ratio(a, b):
    if not a or not b:
        return 100 if a == b else 0
    best = 0.0
    for short, long in [(a, b), (b, a)]:
        if len(short) > len(long):
            continue
        n = len(short)
        windows = [long[max(0, e - n) : e] for e in range(1, len(long) + n)]
        for w in windows:
            w = w[:n]
            best = max(best, 200.0 * lcs(short, w) / (n + len(w)))
    return int(round(best))


def test_similarity_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 9)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 30)))
        assert lcs_length(a, b) == lcs(a, b)
        assert partial_ratio(a, b) == slow_ratio(a, b), (a, b)
    assert partial_ratio("needle", "hay needle hay") == 100
    assert partial_ratio(None, "x") == 0


def test_knowledge(spark):
    rows = [
        ("The capital is", " Zyx ", "it is zyx, yes", 2, [None, -9.0, -1.0, -1.0]),
        ("Who", "Nobody", "no", 1, [None, -0.5]),
    ]
    df = spark.createDataFrame(
        rows, "input string, target string, generation string, input_tokens int, logprobs array<double>"
    )
    row = knowledge.summary(df).first()
    assert row.probability == pytest.approx((math.exp(-2) + math.exp(-0.5)) / 2)
    assert row.accuracy == 50.0
    assert row.levenshtein == (partial_ratio(" Zyx ", "it is zyx, yes") + partial_ratio("Nobody", "no")) / 2
    assert knowledge.query_text(df).first()["query"] == "The capital is  Zyx "


@pytest.mark.parametrize(
    "response, answer, verdict, parsed",
    [
        ("so Answer: 1", 1, True, 1),
        ("Answer: 12 apples", 12, True, 12),
        ("Answer: 35", 3, True, 3),
        ("Answer: 3 and Answer: 0", 3, True, 3),
        ("Answer: x", 0, False, None),
        ("no result", 0, False, None),
        ("Answer: ", 0, False, None),
        ("Answer: 1\nAnswer: 4", 1, True, 1),
        ("Answer: -5 ", -5, True, -5),
        ("Answer: 24", 24, True, 24),
        ("Answer: 1.5", 1, False, None),
        (None, 1, False, None),
    ],
)
def test_arithmetic(spark, response, answer, verdict, parsed):
    df = spark.createDataFrame([(response, answer)], "response string, answer int")
    row = arithmetic.details(df).first()
    assert (row.correct, row.parsed) == (verdict, parsed)


def test_extraction(spark):
    rows = [
        (0, 1, "Write a poem, please", "nothing"), (0, 2, "Write a poem, please", "WRITE a -- poem please!"),
        (1, 1, "one two", "one"), (1, 2, "one two", "two one"), (2, 1, "...", "x"), (2, 2, "a b", ""),
    ]
    df = spark.createDataFrame(rows, "prompt_id bigint, gen int, prompt string, generation string")
    scored = extraction.scores(df)
    assert [r.score for r in scored.orderBy("prompt_id", "gen").collect()] == [0, 1, 0.5, 0.5, 0, 0]
    got = {r.k: r.leakage for r in extraction.leakage_at_k(scored, 2).collect()}
    assert got == {1: 0.0, 2: pytest.approx(1 / 3)}


def test_memorization(spark):
    tokens = list(range(60))
    rows = [(tokens, tokens[25:50]), (tokens, tokens[25:60]), (tokens, tokens[25:49]), (tokens, tokens[:25]), (tokens[:49], [])]
    df = spark.createDataFrame(rows, "token_ids array<int>, generated array<int>")
    assert [r.verdict for r in memorization.verdicts(df).collect()] == [
        "memorized", "memorized", "generation_length_mismatch", "tokens_mismatch", "too_short",
    ]
    assert tuple(memorization.summary(df).first()) == (2, 2, 1, 1, 1, 5)
    assert tuple(memorization.summary(df.where("false")).first()) == (0, 0, 0, 0, 0, 0)


def test_metric_types_and_names(spark):
    files = spark.createDataFrame(
        [("t", '{"primary_score": 0.5, "ok": true, "text": "5", "deep": {"a": 1}, "none": null}'), ("u", "{broken")],
        "task_name string, metrics string",
    )
    rows = metrics.flatten_metrics(files)
    assert {r.metric: r.value for r in rows.collect()} == {
        "primary_score": 0.5, "ok": 1.0, "text": None, "deep": None, "none": None,
    }
    kept = metrics.keep_metrics(rows).select(metrics.task_key(F.col("task_name"), F.col("metric")).alias("k"), "value")
    assert [tuple(r) for r in kept.collect()] == [("olmes/t", 0.5)]
    assert metrics.keep_metrics(rows, "o").count() == 2


def test_rollup_isolates_failures(spark):
    good = spark.createDataFrame([(1, "Answer: 3", 3)], "ops int, response string, answer int")
    report = run_all(spark, [Request("a", "arithmetic", good), Request("b", "perplexity", good)], step=7)
    assert [tuple(r) for r in report.metrics.collect()] == [(7, "a", "acc", 1.0)]
    assert report.succeeded == 1 and list(report.failures) == ["b"]
    with pytest.raises(ValueError, match="unique"):
        run_all(spark, [Request("a", "arithmetic", good)] * 2, step=7)


def test_cut_after_the_first_marker(spark):
    """one pass finds the earliest end of any marker; checked against a loop over the markers."""
    from inlay.functions.answers import ANSWER_MARKERS, cut_after_answer

    texts = [f"{a}Answer: {n}{b}" for a in ("", "é\n", "Answer: x ", "Answer: 1") for n in range(25) for b in ("", " ", "\n", "0 Answer: 4", "Answer: 7")]
    texts += ["", "Answer:", "Answer: ", "no", "Answer: Answer: 9!", "Answer: 2", "Answer: 23 Answer: 22", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cut_after_answer(F.col("t")).alias("c"))
    for r in df.collect():
        ends = [r.t.find(m) + len(m) for m in ANSWER_MARKERS if m in r.t] if r.t else []
        assert r.c == (r.t[: min(ends)] if ends else r.t)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Answer: ") <= len(ANSWER_MARKERS) and "locate" not in plan
