"""The batch run as one lazy plan: words and roster in; updated roster, exceptions report and counters out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.confidence import document_text
from ..operators.extract import extract
from ..operators.index import classify, entries_of, index_notes, latest, unclassified
from ..operators.pages import limited
from ..operators.report import counters, exceptions, field_rows, per_row, upsert
from ..sources.config import Config
from ..sources.files import CACHE, fingerprinted, from_payload, scan_files
from ..sources.ocr import Reader, Settings, read_lacking
from ..sources.state import KeyedTable
from ..sources.tsv import words as words_of_rows


class Run(NamedTuple):
    """Results of a run; nothing is computed before one of them is written."""

    roster: DataFrame
    report: DataFrame
    counters: DataFrame
    results: DataFrame
    #: Paths of documents of which no company is told.
    unclassified: DataFrame | None = None


def run(roster: DataFrame, documents: DataFrame, pages: DataFrame, words: DataFrame, config: Config = Config(), work: str | None = None, failures: DataFrame | None = None) -> Run:
    """documents: doc_id, path, mtime; pages: doc_id, page, text; words as in schemas.WORDS; failures: doc_id, error of files that
    could not be read, whose notes tell so (documents of which no text is known are in no company's index).

    Only documents that some roster row needs are extracted: the index is cut to the roster's ids first. With `work`, a
    folder that all executors share, the results and the rows are written there once, and all that is asked for reads them."""

    def once(df: DataFrame, name: str) -> DataFrame:
        if work is None:
            return df
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    pages, words = limited(pages, config.page_limit), limited(words, config.page_limit)
    texts = documents.join(document_text(pages), "doc_id", "left")
    classified = once(classify(texts).drop("text"), "classified")
    newest = latest(entries_of(classified), config.year_preference)
    needed = newest.join(_keys(roster), "mb_key", "left_semi").select("doc_id").distinct()
    only = lambda df: df.join(needed, "doc_id", "left_semi")
    readable = needed if failures is None else needed.join(failures, "doc_id", "left_anti")
    results = once(extract(only(words), only(pages), readable, config.as_of_year, config.year_preference), "results")
    fields = field_rows(roster, newest, results, config.overwrite_nonempty, failures)
    rows = once(per_row(roster, fields, index_notes(classified, roster.select(F.col("mb").alias("mb_key"))), config.overwrite_nonempty), "rows")
    return Run(upsert(rows, config.overwrite_nonempty, config.clear_on_overwrite), exceptions(rows), counters(rows), results, unclassified(classified))


class Tables(NamedTuple):
    """What a run reads, and the files that could not be read."""

    documents: DataFrame
    pages: DataFrame
    words: DataFrame
    failures: DataFrame


def read_files(spark: SparkSession, directory: str, reader: Reader, config: Config, work: str, pattern: str = "*.pdf") -> Tables:
    """The tables of all files below a directory, read by a plug-in or taken from the cache below `work`, to which only what it lacked is added."""
    listing = fingerprinted(scan_files(spark, directory, pattern)).select("doc_id", "path", F.col("modificationTime").alias("mtime"))
    listing.write.mode("overwrite").parquet(f"{work}/listing")
    listing = spark.read.schema(listing.schema).parquet(f"{work}/listing")
    cache = KeyedTable(spark, f"{work}/cache", CACHE, ["key"])
    keys = listing.select(F.col("doc_id").alias("key"))
    settings = Settings(**(config.options | {"page_limit": config.page_limit}))
    fresh, failures = read_lacking(listing, cache.newest(keys), reader, settings, f"{work}/reading")
    cache.put(fresh, cache.next_batch())
    read = cache.newest(keys).select(F.col("key").alias("doc_id"), from_payload(F.col("payload")).alias("d"))
    pages = read.select("doc_id", F.explode("d.pages").alias("p"))
    words = pages.select("doc_id", F.col("p.page_number").alias("page"), F.posexplode("p.tsv").alias("pos", "row"))
    # Of files of equal content the last one tells path and time.
    documents = listing.groupBy("doc_id").agg(F.max(F.struct("mtime", "path")).alias("f")).select("doc_id", "f.path", "f.mtime")
    return Tables(documents, pages.select("doc_id", F.col("p.page_number").alias("page"), F.col("p.text").alias("text")), words_of_rows(words), failures)


def _keys(roster: DataFrame) -> DataFrame:
    from ..operators.index import roster_key

    return roster.where("mb <> ''").select(roster_key(F.col("mb")).alias("mb_key")).distinct()
