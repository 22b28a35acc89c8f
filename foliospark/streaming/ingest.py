"""Optional extension: incremental ingestion with Structured Streaming (the document model itself is batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import page_quality


def read_pages_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def score_pages(stream: DataFrame, sink: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Quality rows of arriving pages, appended to Parquet; `each` also sees every batch (a batch that is retried is written once)."""
    scored = page_quality(stream)
    w = scored.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each:
        return w.foreachBatch(each).start()
    return w.format("parquet").option("path", sink).outputMode("append").start()
