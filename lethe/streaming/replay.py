"""Ingest of a stream of labelled files, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lethe.operators.store import Store


def ingest_stream(store: Store, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch of (seq, subject, snapshot_id, path, data, file_class) to the store.

    The store keeps the last batch's number with its manifest, so a batch that is run again after a
    failure is ingested once.
    """

    def batch(frame: DataFrame, number: int) -> None:
        if store.tables.state.get("last_batch", -1) < number:
            if not frame.isEmpty():
                store.ingest(frame, state={"last_batch": number})

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
