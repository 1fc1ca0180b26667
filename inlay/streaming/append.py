"""Continuous ingestion of insertion records into a stored index map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inlay.operators.index_map import IndexMap
from inlay.operators.reindex import reindex


def append_stream(plan: DataFrame, store: IndexMap, chunk: int, checkpoint: str) -> StreamingQuery:
    """Re-index every micro-batch of ``plan(position, tokens)`` and append it to ``store``.

    Each batch owns one write id, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = reindex(batch, chunk)
        store.append(rows, ["ordinal"], write_id=f"batch-{batch_id}")

    return (
        plan.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
