"""Files that arrive over time, through the same row-local steps. Nothing is remembered between files, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from docspark.pipeline import documents
from docspark.sources.files import binary_files, identified


def ingest(spark: SparkSession, folder: str, target: str, progress: str, limit: int = 800) -> StreamingQuery:
    """Appends the documents of each new file under `folder` to the parquet table `target`; ends when all files are done.

    `progress` is the folder of the query's checkpoint, on storage that the cluster shares.
    """
    files = identified(binary_files(spark, folder, streaming=True))
    out = documents(files, "text", "content", limit=limit).drop("content", "text")
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start()
