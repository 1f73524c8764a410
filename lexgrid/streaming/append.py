"""Appending to a stored index from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexgrid.operators.index import positional, tokens


def append_positional(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds a segment folder of positional postings; a repeated batch replaces its own segment."""

    def add(batch: DataFrame, n: int) -> None:
        positional(tokens(batch)).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/segment={n}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
