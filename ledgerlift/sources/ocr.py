"""The seam for OCR: a plug-in reads files inside tasks, everything after its words is DataFrame work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..operators.confidence import best_attempts, document_confidence
from . import files as cached
from .tsv import rows_of

#: Files of a task, and tasks at most, whatever the number of files.
FILES, TASKS = 16, 20_000
#: What a plug-in gives per page; of a file that it fails on one row with the error alone.
READ = "doc_id string, page int, text string, tsv string, confidence double, dpi int, preprocessing_pipeline array<string>, error string"


class Settings:
    """Options for a plug-in, with the engine's defaults; unusable values fall back to these."""

    def __init__(self, **given):
        self.given = given
        whole = lambda v, least: int(v) if str(v).strip().isdigit() and int(v) >= least else None
        self.dpi = whole(given.get("dpi"), 1) or 300
        self.page_limit = whole(given.get("page_limit"), 1) or 30
        #: The first page that is asked for: a plug-in may begin there, and pages before it are passed over.
        self.first_page = whole(given.get("first_page"), 1) or 1
        #: Pages that a task reads of one file; all up to the limit if it is not given.
        self.pages_each = whole(given.get("pages_each"), 1) or self.page_limit
        try:
            self.confidence_threshold = float(given.get("confidence_threshold"))
        except (TypeError, ValueError):
            self.confidence_threshold = None
        if self.confidence_threshold is not None and self.confidence_threshold <= 0:
            self.confidence_threshold = None
        retries = given.get("dpi_retry") or []
        usable = [whole(d, 1) for d in (retries if isinstance(retries, (list, tuple)) else [retries])]
        self.dpi_retry = [d for d in dict.fromkeys(usable) if d and d != self.dpi]
        self.preprocessing = list(given.get("preprocessing") or [])
        self.enable_pdf_text = given.get("enable_pdf_text", True)

    def at(self, dpi: int) -> Settings:
        """The same settings at another resolution."""
        return Settings(**(self.given | {"dpi": dpi}))

    def between(self, first: int, last: int) -> Settings:
        """The same settings for some pages of a file."""
        return Settings(**(self.given | {"first_page": first, "page_limit": last}))


class Reader(Protocol):
    """A plug-in: pages of one file as (page, text, tsv, confidence, dpi, steps), made one by one in ascending order. Runs in tasks; raises on unreadable files.

    It is left after the last page that is wanted, so that no page beyond the limit is made."""

    def __call__(self, content: bytes, settings: Settings) -> Iterable[tuple]: ...


def open_bytes(path: str) -> bytes:
    """A file's bytes, from any store that Arrow reads, by its URI."""
    if path.startswith("file:"):
        with open(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file://") else path.removeprefix("file:"), "rb") as f:
            return f.read()
    store, inside = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_stream(inside) as f:
        return f.read()


def wanted_pages(reader: Reader, content: bytes, settings: Settings) -> Iterator[tuple]:
    """The pages of a file from the first to the last one wanted; the reader is not asked for more."""
    for page in reader(content, settings):
        if settings.first_page <= page[0] <= settings.page_limit:
            yield page
        if page[0] >= settings.page_limit:
            return


def read_pages(files: DataFrame, reader: Reader, settings: Settings, fetch: Callable[[str], bytes] = open_bytes) -> DataFrame:
    """READ rows of all files (doc_id, path), up to the page limit; a file that cannot be fetched or read gives its error.

    Only ids, paths and page ranges are dealt to tasks: a file's bytes are fetched in the task that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.string())
        names = ["doc_id", "page", "text", "tsv", "confidence", "dpi", "preprocessing_pipeline", "error"]
        for batch in batches:
            for doc_id, path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = [(doc_id, *page, None) for page in wanted_pages(reader, fetch(path), settings.between(first, last))]
                except Exception as error:  # noqa: BLE001 - an unreadable file is told, not a failed job
                    found = [(doc_id, *[None] * 6, f"{type(error).__name__}: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    limit, each = settings.page_limit, settings.pages_each
    ranges = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(min(a + each - 1, limit)).alias("last")) for a in range(1, limit + 1, each)])
    asked = files.select("doc_id", "path", F.explode(ranges).alias("r")).select("doc_id", "path", "r.first", "r.last")
    # A number of tasks of their own: rows are tiny, and their work is not.
    tasks = max(1, min(TASKS, -(-files.count() * len(range(1, limit + 1, each)) // FILES)))
    return asked.repartition(tasks, "doc_id", "first").mapInArrow(run, READ)


def read_documents(
    files: DataFrame, cache: DataFrame, reader: Reader, settings: Settings, work: str, layer: DataFrame | None = None, fetch: Callable[[str], bytes] = open_bytes
) -> tuple[DataFrame, DataFrame]:
    """The cache (key, path, payload, created_at) with all files (doc_id, path) that it lacked, and the failures (doc_id, error)."""
    fresh, failures = read_lacking(files, cache, reader, settings, work, layer, fetch)
    return cached.merged(cache, fresh), failures


def read_lacking(
    files: DataFrame, cache: DataFrame, reader: Reader, settings: Settings, work: str, layer: DataFrame | None = None, fetch: Callable[[str], bytes] = open_bytes
) -> tuple[DataFrame, DataFrame]:
    """Of the files (doc_id, path) that the cache (by key) lacks: rows for it (key, path, payload, created_at), and the failures (doc_id, error).

    Files are read at the first resolution, and those whose confidence stays below the threshold again at the next ones;
    the best attempt stands, with the files' own text (layer: doc_id, page, text) where there is some. Every attempt is
    written below `work`, a folder that all executors share, so that no file is read twice at one resolution."""
    spark = files.sparkSession
    # Only ids and paths are kept: the scan, with its fingerprints, is done once, and no file's bytes are moved.
    narrow = files.groupBy("doc_id").agg(F.min("path").alias("path"))
    cached.uncached(narrow, cache).drop("key").write.mode("overwrite").parquet(f"{work}/todo")
    todo = paths = spark.read.schema("doc_id string, path string").parquet(f"{work}/todo")
    attempts, failures = [], []
    for n, dpi in enumerate([settings.dpi, *(settings.dpi_retry if settings.confidence_threshold else [])]):
        read_pages(todo, reader, settings.at(dpi), fetch).write.mode("overwrite").parquet(f"{work}/attempt-{n}")
        made = spark.read.parquet(f"{work}/attempt-{n}").withColumn("attempt", F.lit(n))
        failures.append(made.where("error is not null").select("doc_id", "error"))
        # A file that fails in one of its page ranges has failed.
        attempts.append(made.where("error is null").join(failures[-1].select("doc_id").distinct(), "doc_id", "left_anti"))
        if settings.confidence_threshold:
            sure = document_confidence(attempts[-1]).where(F.coalesce(F.col("average_confidence"), F.lit(0.0)) >= settings.confidence_threshold)
            todo = todo.join(sure.select("doc_id"), "doc_id", "left_anti")
    pages = attempts[0]
    for more in attempts[1:]:
        pages = pages.unionByName(more)
    told = pages.groupBy("doc_id", "attempt").agg(F.avg("confidence").alias("confidence"))
    best = best_attempts(told, settings.confidence_threshold).select("doc_id", "attempt", F.col("confidence").alias("average_confidence"))
    kept = pages.join(best, ["doc_id", "attempt"])
    kept = with_text_layer(kept, layer) if layer is not None and settings.enable_pdf_text else kept.withColumn("replaced", F.lit(False))
    page = F.struct(F.col("page").alias("page_number"), "text", rows_of(F.col("tsv")).alias("tsv"), "confidence", "dpi", "preprocessing_pipeline")
    documents = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("p"))), lambda a, b: a["page"] - b["page"]).alias("held"), text_source(F.col("replaced")).alias("text_source"), F.first("average_confidence").alias("average_confidence"))
    own = F.transform("held", lambda h: h["p"])
    document = F.struct(F.array_join(F.transform(own, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"), "text_source", "average_confidence", own.alias("pages"))
    fresh = documents.join(paths, "doc_id").select(F.col("doc_id").alias("key"), "path", cached.to_payload(document).alias("payload"), F.current_timestamp().alias("created_at"))
    failed = failures[0]
    for more in failures[1:]:
        failed = failed.unionByName(more)
    return fresh, failed.groupBy("doc_id").agg(F.min("error").alias("error"))


def with_text_layer(pages: DataFrame, layer: DataFrame) -> DataFrame:
    """Pages whose text is replaced by the file's own text where that is not blank: doc_id, page, text."""
    given = layer.select("doc_id", "page", F.col("text").alias("layer"))
    joined = pages.join(given, ["doc_id", "page"], "left")
    own = F.coalesce(has_text(F.col("layer")), F.lit(False))
    return joined.withColumn("replaced", own).withColumn("text", F.when(own, F.col("layer")).otherwise(F.col("text"))).drop("layer")


def text_source(replaced: Column) -> Column:
    """As an aggregate over a document's pages: which source its text comes from."""
    some, all_ = F.count_if(replaced), F.count("*")
    return F.when(some == 0, "tesseract").when(some == all_, "pdfplumber").otherwise("pdfplumber+tesseract")
