"""Vectors that arrive as a stream, inserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vecpack.sources.index import VectorIndex

def insert_stream(stream: DataFrame, index: VectorIndex, vector: str = "embedding") -> DataStreamWriter:
    """A writer that inserts each micro-batch of (vec_id, vector); set its checkpoint and trigger, and start it.

    A batch goes to a part of the index that has its number: one that comes again after a restart, wherever
    the driver was lost, replaces what it had written. Encoding needs no state. Compact between runs of the
    stream, not during one: a batch that was compacted can't be replaced.
    """

    def insert(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            index.insert(kept, vector, batch=f"stream-{index.generation}-{number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(insert)
