"""The same results for documents that arrive as a stream.

Documents are whole, so a micro-batch needs nothing from other ones: each is processed like a table. What is
told line by line or text by text (normalisation, headings, citations of a text) also runs on a streaming
DataFrame as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes work(batch) for each micro-batch of a stream of documents, in a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so each document counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
