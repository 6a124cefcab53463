"""Confidence of pages and documents, and the best of several OCR attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of all rows of a page but null, empty and exactly -1 ones; unreadable ones do not count."""
    told = F.when(~F.col("conf").isin("", "-1"), F.col("conf").try_cast("double"))
    return words.groupBy("doc_id", "page").agg(F.avg(told).alias("confidence"))


def document_confidence(pages: DataFrame) -> DataFrame:
    """Unweighted mean of a document's page confidences."""
    return pages.groupBy("doc_id").agg(F.avg("confidence").alias("average_confidence"))


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts joined by newlines in the order of pages."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))


def best_attempts(attempts: DataFrame, threshold: float | None) -> DataFrame:
    """The attempt that stands per document: a better one replaces an earlier one, up to the first that meets the threshold.

    Later attempts are made only while the best so far is below the threshold (null counts as 0); of attempts without
    any confidence the last one stands."""
    before = Window.partitionBy("doc_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.max("confidence").over(before), F.lit(0.0))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("attempt")) == 1
    made = first if threshold is None else first | (so_far < threshold)
    tried = attempts.withColumn("_made", made).where("_made")
    best = Window.partitionBy("doc_id").orderBy(F.col("confidence").desc_nulls_last(), F.when(F.col("confidence").isNull(), -F.col("attempt")).otherwise(F.col("attempt")))
    return tried.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_made")
