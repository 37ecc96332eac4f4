"""Vectors that keep arriving, added to a stored index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectorloom.operators.sizing import BROADCAST_LIMIT_BYTES
from vectorloom.sources import snapshots
from vectorloom.sources.index_store import FAN, index_compact, index_extend


def stream_index_append(
    arrivals: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    fan: int = FAN,
    keep_versions: int = 16,
    keep_s: float = 3600.0,
) -> StreamingQuery:
    """Add ``arrivals(part_id, vec_id, embedding)`` to the index stored at ``path``, whose centroids stay frozen.

    Each arrival is stored exactly once: a micro-batch is a batch addition whose name comes from the stream's
    checkpoint and the batch number, so a repeated one replaces itself, and streams with other checkpoints don't meet. The layout is the same
    whatever the size of the index, also when it outgrows a broadcast between two runs. ``trigger`` defaults
    to ``availableNow``. After each micro-batch additions are merged as soon as there are ``fan`` of a level, and what no
    version of the last ``keep_versions`` names goes when it is ``keep_s`` seconds old, so a long stream leaves few files.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index_extend(spark, path, batch, f"{stream}-{batch_id}", limit_bytes=limit_bytes)
        if index_compact(spark, path, fan):
            snapshots.vacuum(spark, path, keep_versions, keep_s)

    writer = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
