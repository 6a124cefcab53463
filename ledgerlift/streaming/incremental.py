"""The run as a stream: pages come in files, in any order and a document's pages over several of them; the roster is what
the batch run would make of all pages so far.

State is four keyed tables: pages as they came, each document's classification, companies' documents, and results of fields. A
batch reads only what its documents and their companies need: all pages of its documents are extracted anew, and the rows
of the companies that these belong or belonged to are told from the roster as given, never from what was filled in before.
So a batch that is killed and run again, with the same number, leaves the same tables. Numbers must not start anew on old state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.confidence import document_text
from ..operators.extract import RESULT, extract
from ..operators.index import classify, entries_of, index_notes, latest, roster_key
from ..operators.pages import limited
from ..operators.report import counters, exceptions, field_rows, per_row, upsert
from ..plans.pipeline import Run
from ..sources import tsv
from ..sources.config import Config
from ..sources.state import KeyedTable

#: A page as an OCR plug-in leaves it, with its file's path and time.
PAGES = "doc_id string, page int, path string, mtime timestamp, text string, tsv string"
DOCUMENTS = "doc_id string, mb_key string, forms array<string>, path string, mtime timestamp, period struct<label:string,year:int>"
ENTRIES = f"{DOCUMENTS}, gone boolean"
RESULTS = f"doc_id string, field string, result {RESULT}"
ROWS = (
    "row_index long, mb string, revenue bigint, assets bigint, capital_loss bigint, new_revenue bigint, new_assets bigint, new_capital_loss bigint, "
    "skipped int, missing_bu boolean, missing_bs boolean, missing_fields array<string>, notes array<string>"
)


def stream_pages(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the pages in a directory of Parquet files; each file is read once."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


class Incremental:
    """A run that goes on: `batch` takes in new pages, `outcome` tells roster, report and counters of all so far."""

    def __init__(self, roster: DataFrame, state: str, config: Config = Config()):
        self.roster, self.config, self.spark = roster, config, roster.sparkSession
        table = lambda name, *args: KeyedTable(self.spark, f"{state}/{name}", *args)
        self.pages = table("pages", PAGES, ["doc_id", "page"])
        self.documents = table("documents", DOCUMENTS, ["doc_id"])
        self.entries = table("entries", ENTRIES, ["mb_key", "doc_id"])
        self.results = table("results", RESULTS, ["doc_id", "field"])
        self.rows = table("rows", ROWS, ["row_index"])

    def start(self, pages: DataFrame, checkpoint: str) -> StreamingQuery:
        return pages.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def batch(self, pages: DataFrame, number: int) -> None:
        """Take in the pages of a batch; a page that came before is replaced. Run again, it leaves the same."""
        self.pages.put(limited(pages, self.config.page_limit).dropDuplicates(["doc_id", "page"]), number)
        own = self.pages.of_batch(number).select("doc_id").distinct()
        self.take_in(own, number)
        companies = self.entries.of_batch(number).select("mb_key").distinct()
        self.rows.put(self.told(companies), number)

    def take_in(self, own: DataFrame, number: int) -> None:
        """Classify and extract documents (doc_id) from all their pages."""
        pages = self.pages.newest(own)
        first = pages.groupBy("doc_id").agg(F.min_by(F.struct("path", "mtime"), "page").alias("f")).select("doc_id", "f.*")
        texts = first.join(document_text(pages), "doc_id")
        classified = classify(texts).select("doc_id", "mb_key", "forms", "path", "mtime", "period")
        self.documents.put(classified, number)
        now = self.documents.newest(own)
        # A document of which more pages tell another company is gone from the first one.
        before = self.documents.newest(own, before=number).where("mb_key is not null").select("doc_id", F.col("mb_key").alias("old"))
        moved = now.join(before, "doc_id").where(~F.col("mb_key").eqNullSafe(F.col("old"))).withColumn("mb_key", F.col("old")).drop("old").withColumn("gone", F.lit(True))
        self.entries.put(now.where("mb_key is not null").withColumn("gone", F.lit(False)).unionByName(moved), number)
        words = tsv.words(tsv.parse(pages.where("tsv is not null").select("doc_id", "page", "tsv")))
        self.results.put(extract(words, pages.select("doc_id", "page", "text"), now.select("doc_id"), self.config.as_of_year, self.config.year_preference), number)

    def told(self, companies: DataFrame) -> DataFrame:
        """Rows of the roster of the given companies (mb_key), from the documents that these have now."""
        documents = self.entries.newest(companies).where("not gone").drop("gone")
        newest = latest(entries_of(documents), self.config.year_preference)
        results = self.results.newest(newest.select("doc_id").distinct())
        roster = self.roster.withColumn("mb_key", roster_key(F.col("mb"))).join(companies, "mb_key", "left_semi").drop("mb_key")
        overwrite = self.config.overwrite_nonempty
        return per_row(roster, field_rows(roster, newest, results, overwrite), index_notes(documents), overwrite)

    def outcome(self) -> Run:
        """What the batch run would tell of all pages so far."""
        known, c = self.rows.newest(), self.config
        none = self.entries.newest().where("false").drop("gone")
        others = self.roster.join(known.select("row_index"), "row_index", "left_anti")
        untold = per_row(others, field_rows(others, latest(entries_of(none)), self.results.newest().where("false"), c.overwrite_nonempty), index_notes(none), c.overwrite_nonempty)
        rows = known.unionByName(untold.select(*known.columns))
        return Run(upsert(rows, c.overwrite_nonempty, c.clear_on_overwrite), exceptions(rows), counters(rows), self.results.newest())

    def compact(self, most: int = 8) -> None:
        """To be called between batches: bound the files that each bucket of the state has."""
        for table in (self.pages, self.documents, self.entries, self.results, self.rows):
            table.compact(most)
