import itertools
import math
import zlib
from collections import Counter

import numpy as np

from inlay.llm import op6_hmm as op
from tests.llm.corpus import documents, frame, words


def test_scores(spark):
    rows = documents()
    df = frame(spark)
    coded, model, total = op.train(df, op.held_out(), states=3, passes=3)
    got = op.scored(coded, model, total).collect()
    assert len(got) == len(rows)
    tokens = {r[0]: [*words(r[1]), None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    seen = Counter(w for r in rows if not held[r[0]] for w in tokens[r[0]])
    n, v = sum(seen.values()), len(seen)
    classes = {w: int(_hash(w)) >> (64 - op.CLASS_BITS) for w in seen if w}
    in_class = Counter()
    distinct = Counter()
    for w, c in seen.items():
        if w:
            in_class[classes[w]] += c
            distinct[classes[w]] += 1
    for r in got:
        own = tokens[r.doc_id]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(seen[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        # the plain forward recursion, one token at a time
        state, score = model.start, 0.0
        for i, w in enumerate(own):
            k = op.END if w is None else int(_hash(w)) >> (64 - op.CLASS_BITS)
            state = (state if i == 0 else state @ model.moves) * model.emits[k]
            score += math.log10(state.sum())
            state = state / state.sum()
            if w is not None:
                score += math.log10((seen[w] + 0.5) / (in_class[k] + 0.5 * (distinct[k] + 1)))
        assert math.isclose(r.score, score, rel_tol=1e-9)


def _hash(word):
    import pyarrow as pa

    from inlay.llm.words import blocks, split

    return split(next(blocks(pa.array([word])))).hashes[0]


def small_model(states=2, seed=1):
    rng = np.random.default_rng(seed)
    emits = rng.random((op.CLASSES + 1, states))
    moves = rng.random((states, states))
    start = rng.random(states)
    share = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return op.Model(share(start, 0), share(rng.random(states), 0), share(moves, 1), share(emits, 0))


def test_likelihood_does_not_depend_on_runs():
    m = small_model(3)
    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 40, 333]
    x, ends = rng.integers(0, op.CLASSES + 1, sum(sizes)), np.cumsum(sizes)
    whole = op.log_likelihoods(x, ends, m, 1000)
    for length in (1, 3, 7):
        assert np.allclose(op.log_likelihoods(x, ends, m, length), whole, rtol=1e-10)
    total = sum(  # all paths of a short text
        m.start[p[0]] * m.emits[x[3], p[0]] * np.prod([m.moves[a, b] * m.emits[x[3 + i], b] for i, (a, b) in enumerate(zip(p, p[1:]), 1)])
        for p in itertools.product(range(3), repeat=5)
    )
    assert math.isclose(whole[2], math.log(total), rel_tol=1e-9)


def test_passes_raise_the_likelihood(spark):
    df = frame(spark)
    logs = []
    for passes in (1, 3, 6):
        coded, model, total = op.train(df, op.held_out(), states=3, passes=passes)
        logs.append(sum(r.score for r in op.scored(coded, model, total).collect() if not r.held_out))
    assert logs[0] < logs[1] < logs[2]


def test_expected_counts_equal_those_of_all_paths(monkeypatch):
    m = small_model(2, seed=6)
    sizes = [1, 4, 3, 5, 2]
    x, ends = np.random.default_rng(8).integers(0, 4, sum(sizes)), np.cumsum(sizes)
    begin, end, _, fresh = op.runs_of(ends, 3)
    want = [np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((op.CLASSES + 1, 2)), 0.0]
    for a, b, new in zip(begin, end, fresh):
        weight = {}
        for path in itertools.product(range(2), repeat=int(b - a)):
            p = (m.start if new else m.later)[path[0]]
            for i, state in enumerate(path):
                p *= m.emits[x[a + i], state] * (m.moves[path[i - 1], state] if i else 1)
            weight[path] = p
        whole = sum(weight.values())
        for path, p in weight.items():
            want[0 if new else 1][path[0]] += p / whole
            for i, state in enumerate(path):
                want[3][x[a + i], state] += p / whole
                if i:
                    want[2][path[i - 1], state] += p / whole
        want[4] += math.log(whole)
    for piece in (1 << 17, 4):
        monkeypatch.setattr(op, "PIECE", piece)
        got = op.expected_of_all(x, begin, end, fresh, m)
        assert all(np.allclose(g, w, rtol=1e-10) for g, w in zip(got, want))
    none = op.expected_of_all(x, begin[:0], end[:0], fresh[:0], m)
    assert none[3].shape == want[3].shape and not none[3].any()


def test_halves_round_to_eight_digits():
    values = np.random.default_rng(2).gamma(0.3, 1e4, 4000)
    got = op.from_halves(op.halves(values))
    assert (np.abs(got - values) <= values / 256).all() and op.halves(got) == op.halves(values)
    assert not op.from_halves(op.halves(np.zeros(3))).any()


def test_empty_table_and_all_held_out(spark):
    from pyspark.sql import functions as F

    df = frame(spark)
    coded, model, total = op.train(df.limit(0), op.held_out())
    assert op.scored(coded, model, total).count() == 0
    coded, model, total = op.train(df, F.lit(True))
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in op.scored(coded, model, total).collect())


def test_states_emit_words_not_classes(spark):
    from pyspark.sql import functions as F

    rows = documents()
    df = frame(spark)
    blocks_, model, total = op.train_words(df, op.held_out(), states=3, passes=2, word_passes=2)
    kept = blocks_.collect()
    table = {}
    for b in kept:
        hashes = np.frombuffer(b.hashes, np.uint64).tolist()
        emits = op.emissions([f.asDict() for f in b.found or []], model)
        assert len(emits) == len(hashes) + 1
        for h, e in zip(hashes, emits):
            assert np.allclose(table.setdefault(h, e), e, rtol=1e-12)
        end = emits[-1]
    own = {}
    for d, text, *_ in rows:
        own[d] = [*words(text), None]
    seen = {int(_hash(w)) for d in own if zlib.crc32(str(d).encode()) % 5 != 1 for w in own[d] if w}
    unknown = model.emits(np.zeros((1, 3)))[0]
    sums = sum(table[h] for h in seen) + end + unknown
    assert np.allclose(sums, 1, rtol=1e-4)
    by_class = {}
    for h in seen:
        by_class.setdefault(h >> (64 - op.CLASS_BITS), []).append(table[h] / table[h].sum())
    several = [x for x in by_class.values() if len(x) > 1]
    assert several and any(not np.allclose(x[0], x[1], rtol=0.05) for x in several)
    got = op.scored_words(blocks_, model, total).collect()
    plain = op.scored(*op.train(df, op.held_out(), states=3, passes=2)).collect()
    for r in got:
        state, score = model.start, 0.0
        for i, w in enumerate(own[r.doc_id]):
            state = (state if i == 0 else state @ model.moves) * (end if w is None else table[int(_hash(w))])
            score += math.log10(state.sum())
            state = state / state.sum()
        assert math.isclose(r.score, score, rel_tol=1e-6)
    fit = lambda found: sum(r.score for r in found if not r.held_out)
    assert len(got) == len(rows) and fit(got) > fit(plain)
    few = op.scored_words(*op.train_words(df, F.lit(True), passes=1)).collect()
    assert all(math.isclose(r.score, r.base_score, rel_tol=0.2) and math.isfinite(r.score) for r in few)
    assert op.scored_words(*op.train_words(df.limit(0), op.held_out(), passes=1)).count() == 0
