"""Structured Streaming into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.validate import ERRORS, with_errors
from millrace.sources.store import TableStore, WritePolicy


def stream_commit(
    stream: DataFrame,
    store: TableStore,
    table: str,
    checkpoint: str,
    name: str,
    policy: WritePolicy = WritePolicy.UPSERT,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    rejects: str | None = None,
    order_by: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Commit each micro-batch by the same rules as a batch commit.

    Rows that fail the table's schema go to the table ``rejects`` (with their
    errors), the others into ``table``. Each commit records the batch id in its
    log entry, under the name and the query id that Spark keeps in the checkpoint.
    So a batch delivered again after a failure changes nothing, while a new
    checkpoint under an old name, whose batches count from 0 again, is a stream of
    its own.
    """

    def commit_batch(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        options = {"source": f"{name}@{query_id}", "batch_id": batch_id}
        if rejects is None:
            store.commit_table(table, rows, policy=policy, order_by=order_by, **options)
            return
        # Validated once, then split; dropped again when the batch is done.
        checked = with_errors(rows, store.schema(table), clean=True).persist()
        try:
            bad = checked.filter(F.size(ERRORS) > 0).drop("_warnings")
            bad = bad.withColumn(ERRORS, F.to_json(ERRORS))
            store.commit_table(rejects, bad, policy=WritePolicy.APPEND, **options)
            good = checked.filter(F.size(ERRORS) == 0).drop(ERRORS, "_warnings")
            store.commit_table(table, good, policy=policy, order_by=order_by, **options)
        finally:
            checked.unpersist()

    writer = (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(commit_batch)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
