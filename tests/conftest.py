import pytest

from inlay.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def plan_of(spark):
    """A plan frame from ``{position: tokens}``."""

    def make(plan):
        return spark.createDataFrame(list(plan.items()), "position bigint, tokens array<int>")

    return make


@pytest.fixture
def map_of(spark):
    """Flat map rows from ``{index: [(pos, tokens), ...]}``."""

    def make(nested):
        rows = [
            (index, n, pos, tokens)
            for index, insertions in nested.items()
            for n, (pos, tokens) in enumerate(insertions)
        ]
        return spark.createDataFrame(rows, "index bigint, ordinal bigint, pos int, tokens array<int>")

    return make


def nested(rows):
    """Flat map rows back to ``{index: [(pos, tokens), ...]}``."""
    out = {}
    for row in sorted(rows.collect(), key=lambda r: (r["index"], r["ordinal"])):
        out.setdefault(row["index"], []).append((row["pos"], list(row["tokens"])))
    return out
