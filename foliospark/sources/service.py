"""Submit, status, manifest and page look-ups over a store of written results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from . import files


@dataclass
class Service:
    """A store below `base`: jobs/, manifests/ and pages/ as JSON."""

    spark: SparkSession
    base: str

    def _read(self, name: str, schema: str) -> DataFrame:
        at = files.safe_key(self.base, name)
        return self.spark.read.schema(schema).json(at) if files.exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def submit(self, uploads: DataFrame) -> DataFrame:
        """The verdict of each upload; admitted ones are queued."""
        v = files.upload_verdict(uploads)
        queued = v.where("reject_reason is null").select(F.col("filename").alias("document_id"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("pages_processed"), F.current_timestamp().alias("ts"), F.lit(0).cast("long").alias("event_id"))
        files.write_json(queued, files.safe_key(self.base, "jobs"), mode="append")
        return v

    def jobs(self) -> DataFrame:
        return self._read("jobs", "document_id string, status string, pages_processed bigint, ts timestamp, event_id bigint")

    def manifests(self) -> DataFrame:
        return self._read("manifests", "document_id string, page_count bigint, processed_pages bigint, failed_pages bigint, chapters bigint, sections bigint, chunks bigint, pages string")

    def status(self, asked: DataFrame, memory: DataFrame | None = None) -> DataFrame:
        job = manifest.latest_state(self.jobs())
        memory = memory if memory is not None else job.limit(0)
        return manifest.lookup_status(asked, job, memory, self.manifests())

    def page(self, document_id: str, number: int) -> DataFrame:
        return files.read_pages(self.spark, files.safe_key(self.base, "pages")).where((F.col("document_id") == document_id) & (F.col("page_number") == number))
