"""Continuous ingest: each micro-batch of a change stream becomes one atomic batch of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelog.sources.store import KVStore


def ingest(stream: DataFrame, store: KVStore, order: str, checkpoint: str, name: str = "ingest", **trigger):
    """stream: (key, kind, value, order column). Returns the running query.

    The number of the last micro-batch is committed with its rows under ``name``, so one that is run again after a failure changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number > store.streams.get(name, -1):
            store.bulk_write(batch, order, (name, number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
