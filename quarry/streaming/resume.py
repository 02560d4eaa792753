"""A streaming sink that can be run again: each batch adds only rows whose key isn't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.sources.records import append_new


def run_once(stream: DataFrame, path: str, checkpoint: str, key: str = "row_id") -> None:
    """Processes what is there; the anti-join by key makes a repeated batch harmless."""
    query = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch.dropDuplicates([key]), path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def jsonl_sink(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Records as they come, as JSON lines; what a checkpoint has seen isn't written again."""
    stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
