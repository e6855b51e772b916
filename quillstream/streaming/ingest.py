"""Scoring documents as they arrive.

Counting and segment verdicts are per document and keep no state across documents, so a stream of files is a
sequence of independent batches: no watermark, exactly once by batch id in the sink's path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def score_stream(docs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply ``work`` to each batch and write its rows under ``out/batch=<id>``; a repeated batch replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
