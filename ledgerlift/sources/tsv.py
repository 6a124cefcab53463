"""OCR word tables: tab-separated text, one header line and one line per layout element, to typed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text

NUMBERS = {"level": "level", "page_num": "page_num", "block_num": "block", "par_num": "par", "line_num": "line", "word_num": "word", "left": "left", "top": "top", "width": "width", "height": "height"}


def rows_of(tsv: Column) -> Column:
    """Rows as maps from header to field, both text; blank lines and rows of another number of fields are dropped."""
    lines = F.filter(F.split(tsv, "\r\n|\r|\n"), has_text)
    header = F.split(F.get(lines, 0), "\t", -1)
    fields = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, "\t", -1)), lambda f: F.size(f) == F.size(header))
    return F.transform(fields, lambda f: F.map_from_arrays(header, f))


def parse(pages: DataFrame) -> DataFrame:
    """doc_id, page, tsv -> doc_id, page, pos and row (a map)."""
    return pages.select("doc_id", "page", F.posexplode(rows_of(F.col("tsv"))).alias("pos", "row"))


def words(parsed: DataFrame) -> DataFrame:
    """Rows as words in the engine's columns; unreadable numbers become null and are dropped with the words' geometry."""
    numbers = [F.coalesce(F.try_element_at("row", F.lit(k)), F.lit("0")).try_cast("double").cast("int").alias(v) for k, v in NUMBERS.items() if k != "page_num"]
    text = F.coalesce(F.try_element_at("row", F.lit("text")), F.lit("")).alias("text")
    return parsed.select("doc_id", "page", "pos", *numbers, F.try_element_at("row", F.lit("conf")).alias("conf"), text)
