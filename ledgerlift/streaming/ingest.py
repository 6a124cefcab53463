"""Incremental ingestion: new word files are folded into the results as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import WORDS


def stream_words(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the words in a directory of Parquet files; each file is read once."""
    return spark.readStream.schema(WORDS).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def process(words: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of whole files to a batch function; documents must not be split over files.

    The batch number makes writes repeatable: a batch that is run again after a failure has the same number."""
    return words.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
