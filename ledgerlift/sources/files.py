"""Document files: recursive scan, content fingerprints, and the cache of what has been read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload of a read document in the cache.
PAYLOAD = (
    "struct<text:string,text_source:string,average_confidence:double,pages:array<struct<page_number:int,text:string,"
    "tsv:array<map<string,string>>,confidence:double,dpi:int,preprocessing_pipeline:array<string>>>>"
)
#: The cache of read documents.
CACHE = "key string, path string, payload string, created_at timestamp"


def scan_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length and content of all files below a directory that match (case counts)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)


def fingerprint(length: Column, modified: Column, content: Column) -> Column:
    """SHA-1 of size, whole-second time and bytes."""
    as_bytes = lambda c: c.cast("long").cast("string").cast("binary")
    return F.sha1(F.concat(as_bytes(length), as_bytes(F.unix_timestamp(modified)), content))


def fingerprinted(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_id", fingerprint(F.col("length"), F.col("modificationTime"), F.col("content")))


def cache_key(doc_id: Column, config: str = "") -> Column:
    """The cache's key: the content's fingerprint, and that of the settings it was read with unless these are not to count."""
    return F.concat_ws(":", doc_id, F.lit(config)) if config else doc_id


def uncached(files: DataFrame, cache: DataFrame, config: str = "") -> DataFrame:
    """The files that must still be read: no row of the cache has their key."""
    keyed = files.withColumn("key", cache_key(F.col("doc_id"), config))
    return keyed.join(cache.select("key"), "key", "left_anti")


def to_payload(document: Column) -> Column:
    return F.to_json(document)


def from_payload(payload: Column) -> Column:
    """A cached document; a missing text source is tesseract, missing page fields are null."""
    read = F.from_json(payload, PAYLOAD)
    return read.withField("text_source", F.coalesce(read["text_source"], F.lit("tesseract")))


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows (key, path, payload, created_at) in place of older ones of the same key."""
    both = cache.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    newest = F.struct(F.col("_age"), -F.unix_micros(F.col("created_at").cast("timestamp")))
    columns = [c for c in cache.columns if c != "key"]
    return both.groupBy("key").agg(F.min_by(F.struct(*columns), newest).alias("row")).select("key", "row.*")
