"""Words to lines, bands and pages: typed words are dealt by document, and nothing below a page is shuffled after that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from .flat import Lot, as_batch, band_rows, line_rows, lots, whole

LINES = "doc_id string, page int, block int, par int, line int, row int, left int, top int, right int, bottom int, text string"
BANDS = "doc_id string, page int, bands array<struct<left:int,top:int,right:int,bottom:int,text:string>>"


def typed(words: DataFrame) -> DataFrame:
    """Words with numeric geometry; rows that are no words (level 5), blank, or without readable numbers are dropped."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")).try_cast("double").cast("int")
    ids = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")).try_cast("int")
    read = words.where(has_text(F.col("text"))).select("doc_id", "page", "pos", "text", *[ids(c).alias(c) for c in ("level", "block", "par", "line")], *[whole(c).alias(c) for c in ("left", "top", "width", "height")])
    placed = read.where("level = 5 and block is not null and par is not null and line is not null and left is not null and top is not null and width is not null and height is not null")
    return placed.select("doc_id", "page", "pos", "text", "block", "par", "line", "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"), "height")


def lines_of(words: DataFrame) -> DataFrame:
    """One row per line: doc_id, page, block, par, line, row (place of its first word), text (words by left edge) and box."""
    word = F.struct("left", "pos", "text")
    box = [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")]
    grouped = typed(words).groupBy("doc_id", "page", "block", "par", "line").agg(F.min("pos").alias("row"), F.array_sort(F.collect_list(word)).alias("words"), *box)
    return grouped.withColumn("text", F.array_join("words.text", " ")).drop("words")


def rows_of(documents: DataFrame, *more: Column) -> DataFrame:
    """Documents that come whole, as an OCR plug-in reads them (doc_id, pages in order, each with page and words in order), for tasks that
    look at pages as flat arrays: a document is in one row, so nothing is shuffled or sorted, and a task holds a lot of rows at a time."""
    return documents.select("doc_id", *more, F.col("pages.page").alias("page"), F.col("pages.words").alias("words"))


def arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def whole_lines(documents: DataFrame) -> DataFrame:
    """What lines_of tells, of documents that come whole."""
    schema = arrow(LINES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot, _ in whole(batches):
            yield as_batch(lot, line_rows(lot), schema)

    return rows_of(documents).mapInArrow(read, LINES)


def banded(lot: Lot) -> pa.RecordBatch:
    starts, bands = band_rows(lot)
    return pa.RecordBatch.from_arrays([pa.array(lot.doc_ids, pa.string()), pa.array(lot.page_numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), bands)], ["doc_id", "page", "bands"])


def bands_of(words: DataFrame) -> DataFrame:
    """One row per page with words: doc_id, page and its vertical bands, by left edge, each with box and text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(banded, lots(batches))

    return typed(words).repartition("doc_id").sortWithinPartitions("doc_id", "page", "pos").mapInArrow(read, BANDS)


def whole_bands(documents: DataFrame) -> DataFrame:
    """The same of documents that come whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot, _ in whole(batches):
            yield banded(lot)

    return rows_of(documents).mapInArrow(read, BANDS)


def first_lines(pages: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, page, ord and text of the first n lines of each page's text."""
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n"), 1, n)
    return pages.select("doc_id", "page", F.posexplode(lines).alias("ord", "text"))


def limited(pages: DataFrame, pages_most: int = 30) -> DataFrame:
    """Pages up to the limit; the filter reaches the scan of a word or page table."""
    return pages.where(F.col("page") <= pages_most)
