"""Keyed tables that are written batch by batch: the rows of a key that a later batch brings stand in place of earlier ones.

A table is Parquet in partitions by a hash of its bucket columns and by batch number. A batch overwrites only the partitions
(bucket, batch) that it has rows in: all other ones keep their files, a batch that is run again replaces what its first
attempt left, and a reader that looks a few keys up reads their buckets alone. Compaction brings all batches of a bucket
before its last one together.

In paths, batch n has the number 2 n + 1, and what has been brought together of all batches before it 2 n: so the last
batch can still be run again, or be looked before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Buckets of a table; as many numbers, at most, come to the driver.
BUCKETS = 64


class KeyedTable:
    """A table (schema) at a path, keyed by `keys`; rows of equal `bucket` columns, the first key if not told, lie together."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], bucket: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.bucket, self.buckets = spark, path.rstrip("/"), keys, bucket or keys[:1], buckets
        self.schema = StructType.fromDDL(schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.bucket]), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _all(self) -> DataFrame:
        stored = StructType([*self.schema.fields, StructField("_bucket", IntegerType()), StructField("_batch", LongType())])
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(self.path)

    def next_batch(self) -> int:
        """A number for a batch that comes after all that are there; told from the names of partitions."""
        last = self._all().agg(F.max("_batch")).first()[0]
        return 0 if last is None else last // 2 + 1

    def put(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's rows; of rows with equal keys in it one must stand."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self._bucket(), F.lit(2 * batch + 1).cast("long").alias("_batch"))
        # One task for each bucket, so that each partition is one file.
        self._write(named.repartition("_bucket"))

    def _write(self, named: DataFrame) -> None:
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(self.path)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows that have the bucket columns."""
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]

    def of_batch(self, batch: int) -> DataFrame:
        """The rows that a batch brought."""
        return self._all().where(F.col("_batch") == 2 * batch + 1).select(*self.schema.names)

    def newest(self, of: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The rows that stand; with `of`, those whose bucket columns are among its rows; with `before`, as they stood before a batch."""
        held = self._all()
        if before is not None:
            held = held.where(F.col("_batch") < 2 * before + 1)
        if of is not None:
            held = held.where(F.col("_bucket").isin(self.touched(of))).join(of.select(*self.bucket).distinct(), self.bucket, "left_semi")
        # The newest batch of each key is found on narrow rows; wide values are moved once.
        last = held.groupBy(*self.keys).agg(F.max("_batch").alias("_batch"))
        return held.join(last, [*self.keys, "_batch"]).select(*self.schema.names)

    def compact(self, most: int = 8) -> None:
        """Bring the batches before the last one together in buckets of more than `most` (two at least). Whoever reads in between finds every row."""
        sizes = self._all().groupBy("_bucket").agg(F.countDistinct("_batch").alias("n"), F.max("_batch").alias("last")).where(F.col("n") > max(most, 2)).collect()
        if not sizes:
            return
        last_of = F.create_map(*[x for r in sizes for x in (F.lit(r["_bucket"]), F.lit(r["last"]))])
        held = self._all().where(F.col("_bucket").isin([r["_bucket"] for r in sizes])).withColumn("_last", last_of[F.col("_bucket")]).where("_batch < _last")
        newest = held.groupBy(*self.keys).agg(F.max("_batch").alias("_batch"))
        whole = held.join(newest, [*self.keys, "_batch"]).select(*self.schema.names, "_bucket", (F.col("_last") - 1).alias("_batch"))
        self._write(whole.repartition("_bucket"))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for r in sizes:
            for status in fs.listStatus(hadoop(f"{self.path}/_bucket={r['_bucket']}")):
                name = status.getPath().getName()
                if name.startswith("_batch=") and int(name.removeprefix("_batch=")) < r["last"] - 1:
                    fs.delete(status.getPath(), True)
