"""Page operators on streams.

The stateless operators (:func:`pagetable.operators.content.scrape`, internal links, extraction)
take a streaming frame as they are. This module adds what only a stream needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetable.sources.pages import PAGE_SCHEMA


def stream_pages(
    spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """Page files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def new_urls(pages: DataFrame, time: str, delay: str) -> DataFrame:
    """Each URL once within ``delay``: the stream form of a visited set, its state bounded."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, write Parquet to ``path`` and stop."""
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
