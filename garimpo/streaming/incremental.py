"""Resumable processing: a folder of documents as a file stream, each file once, results appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.sources.files import decode, truncate

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def document_stream(spark: SparkSession, folder: str, max_chars: int | None = None, files_per_trigger: int = 10_000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    text = truncate(decode(F.col("content")), max_chars)
    return raw.select(F.substring_index("path", "/", -1).alias("doc_id"), text.alias("text")).filter(F.length("text") > 0)


def process_available(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``process`` over what is new since the last run and appends its rows; started again, it goes on where it stopped.

    A batch writes its own folder and overwrites it when it is tried again, so a
    lost driver or executor leaves no row twice.
    """

    def write(df: DataFrame, batch: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
