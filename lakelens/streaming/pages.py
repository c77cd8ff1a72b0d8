"""Pages as a stream: the extractor and the page checks are stateless, so they run on new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import checks, html
from ..sources.tables import raw_pages


def envelope_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """Envelopes of page files (page_id, url, html) as they arrive in a folder."""
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return checks.page_envelopes(checks.typed(html.extract_pages(raw_pages(stream))))
