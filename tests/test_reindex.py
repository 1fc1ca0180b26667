import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from inlay.operators.reindex import crossings, flatten, nest, reindex
from tests.conftest import nested


def by_token(plan, chunk):
    """Cells token by token: what re-indexing must give, from the definition alone."""
    cells = {}
    for position in sorted(plan):
        pieces = {}
        for i, token in enumerate(plan[position]):
            index, pos = divmod(position + i, chunk)
            pieces.setdefault(index, (pos, []))[1].append(token)
        for index, piece in pieces.items():
            cells.setdefault(index, []).append(piece)
    return cells


@pytest.mark.parametrize("chunk", [1, 6, 7, 64])
def test_rows_at_every_place_of_a_chunk(plan_of, chunk):
    """Rows that begin and end at all places: inside, at either end, over one and over many borders, far out."""
    far = (1 << 45) // chunk * chunk
    plan, at = {}, 0
    for n in (2, 0, 5, 13, 1, 6, 30, 3):
        plan[at] = [100 * n + i for i in range(n)]
        plan[far + at] = list(range(n))
        at += n + 1
    assert nested(reindex(plan_of(plan), chunk)) == by_token(plan, chunk)


def test_empty_plan(plan_of, spark):
    assert reindex(spark.createDataFrame([], "position bigint, tokens array<int>"), 8).count() == 0


@pytest.mark.parametrize("chunk", [0, -1])
def test_chunk_must_be_positive(plan_of, chunk):
    with pytest.raises(ValueError, match="positive"):
        reindex(plan_of({1: [1]}), chunk)


def test_crossing_refused_without_split(plan_of):
    chunk = 20
    inside, over = {7: [1] * 13}, {27: [1] * 14}  # ends with its chunk, and one behind
    assert nested(reindex(plan_of(inside), chunk, split=False)) == {0: [(7, [1] * 13)]}
    with pytest.raises(Exception, match="crosses a boundary"):
        reindex(plan_of(over), chunk, split=False).collect()
    found = crossings(plan_of({**inside, **over}), chunk).collect()
    assert [(r.position, r["index"], r.pos, r.n_tokens) for r in found] == [(27, 1, 7, 14)]


def test_nested_pages_hold_everything(map_of):
    rows = map_of({7: [(i, [i]) for i in range(10)], 8: [(0, [1])]})
    pages = nest(rows, page=4)
    assert sorted((r["index"], r.page, len(r.insertions)) for r in pages.collect()) == [
        (7, 0, 4), (7, 1, 4), (7, 2, 2), (8, 0, 1),
    ]
    assert nested(flatten(pages)) == nested(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lengths=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)), min_size=1, max_size=20),
    chunk=st.integers(1, 9),
)
def test_pieces_join_to_the_plan(plan_of, lengths, chunk):
    plan, at = {}, 0
    for n, gap in lengths:
        plan[at] = list(range(at, at + n))
        at += n + gap + 1
    cells = {}
    for index, insertions in nested(reindex(plan_of(plan), chunk)).items():
        for pos, tokens in insertions:
            assert tokens and pos + len(tokens) <= chunk
            for i, token in enumerate(tokens):
                cells[index * chunk + pos + i] = token
    assert cells == {p + i: t for p, tokens in plan.items() for i, t in enumerate(tokens)}
