"""Pages that arrive as files, merged into the document table as a stream.

``availableNow`` handles what is there and stops, which is the batch ingest; a
processing-time trigger keeps on.  A micro-batch is merged whole, so a replay
after a failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pages
from ..operators.merge import Table

RAW = "url string, html string, fetched_at timestamp"


def raw_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge_pages(raw: DataFrame, table: Table, doc_type: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Parse streamed pages of one document type and merge each micro-batch into ``table``."""

    def merge(batch: DataFrame, _: int) -> None:
        made = pages.document_pages(pages.parse(batch), doc_type)
        table.merge(made.filter("error IS NULL AND doc_id <> ''"), order="fetched_at")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fetch_rates(raw: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pages and hosts per window of their fetch time; windows close ``late`` after the newest page."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    seen = raw.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window).alias("w"), host.alias("host")).agg(F.count("*").alias("pages"))
    return seen.select(F.col("w.start").alias("start"), "host", "pages")
