"""Structured Streaming into a stored index: each micro-batch becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of (doc_id, name, text) into the store.

    A batch that is replayed after a failure is recognised by the ids that are
    already in the catalog, so it isn't indexed twice.
    """

    def save(batch: DataFrame, _: int) -> None:
        fresh = batch.join(store.docs().select("doc_id"), "doc_id", "left_anti")
        if not fresh.isEmpty():
            store.add(fresh)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
