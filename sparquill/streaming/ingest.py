"""Ingestion by Structured Streaming: micro-batches are appended to a table, which is frozen into an index at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..index import SearchIndex
from ..operators.build import IndexOptions


def ingest(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append what the stream has now to a Parquet table. Called again with the same checkpoint, it goes on from there."""

    def append(batch: DataFrame, epoch: int) -> None:
        # One folder for each epoch, overwritten if the epoch is run again: nothing is taken twice.
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index_stream(stream: DataFrame, options: IndexOptions, table: str, checkpoint: str) -> SearchIndex:
    """An index of all documents that the table has after taking what the stream has now."""
    ingest(stream, table, checkpoint)
    return SearchIndex.from_dataframe(stream.sparkSession.read.parquet(table).drop("epoch"), options)
