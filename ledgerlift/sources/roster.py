"""The roster of companies and its results: CSV (as spreadsheet programs write it, with quoted line breaks and doubled quotes) or Parquet, and workbooks where openpyxl can be imported."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import roster_id
from ..functions.vocabulary import ID_HEADERS
from ..schemas import RESULTS


class UnsupportedRosterError(ValueError):
    """A roster in a format that cannot be read."""


def key_of(header: str) -> str:
    return "".join(c for c in header.lower() if not c.isspace() and c not in ".:;-")


def id_column(columns: list[str]) -> str:
    """The first column whose header names the company id."""
    wanted = {key_of(h) for h in ID_HEADERS}
    for name in columns:
        if key_of(name) in wanted:
            return name
    raise ValueError("no column of company ids among " + ", ".join(columns))


def result_columns(raw: DataFrame) -> dict[str, str]:
    """For each result the column that holds it: by its header, or by its plain name."""
    found = {}
    for key, header in RESULTS.items():
        for name in raw.columns:
            if key_of(name) in (key_of(header), key_of(key)):
                found[key] = name
    return found


def numbered(raw: DataFrame) -> DataFrame:
    """raw, read from text files, with `_row`: the number of each row in the sheet, the header being row 1.

    Rows are counted by the blocks of the files, in their order; the counts' prefix sums are one row a block."""
    placed = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    row = (F.col("_before") + F.col("_id") - F.col("_first") + 2).alias("_row")
    return placed.join(blocks, ["_path", "_start"]).select(row, *[F.col(f"`{c}`") for c in raw.columns])


def quoted_records(lines: DataFrame) -> DataFrame:
    """_path, record (from 1 in each file) and text of the records of CSV files, read as lines (value, with `_metadata`).

    A line begins a record if the quotes before it in its file are even in number. Files stay split into blocks: quotes and records
    are summed up by block, prefix sums over blocks (one row each) tell how a block begins, and only a block's lines are put in order
    together. Empty lines between records are none."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    placed = placed.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    block, inside = ["_path", "_start"], Window.partitionBy("_path", "_start").orderBy("_id")
    along = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)

    def with_sums(rows: DataFrame, value: str, out: str) -> DataFrame:
        """rows with `out`: the sum of a value over the lines before in the file."""
        sums = rows.groupBy(*block).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum")
        here = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("_here", here).join(sums, block).withColumn(out, F.col("_before") + F.col("_here")).drop("_before", "_here")

    parted = with_sums(placed, "_quotes", "_open").withColumn("_free", F.col("_open") % 2 == 0).where("not _free or value <> ''")
    told = with_sums(parted.withColumn("_begins", F.col("_free").cast("int")), "_begins", "_done")
    ordered = F.array_sort(F.collect_list(F.struct("_start", "_id", "value")))
    return told.groupBy("_path", (F.col("_done") + F.col("_begins")).alias("record")).agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("text"))


def from_records(spark: SparkSession, records: DataFrame) -> DataFrame:
    """The rows of quoted_records as columns under the first file's headers, and `_row`; every file has a header."""
    first = records.where("record = 1").orderBy("_path").first()
    headers = next(csv.reader(io.StringIO(first.text.removeprefix("\ufeff")), delimiter=";")) if first else []
    names = [h or f"_c{i}" for i, h in enumerate(headers)]
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = records.groupBy("_path").agg((F.max("record") - 1).alias("_n")).select("_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    read = F.from_csv("text", ", ".join(f"{quoted(n)} string" for n in names) or "_c0 string", {"sep": ";", "quote": '"', "escape": '"'})
    return records.where("record > 1").join(F.broadcast(files), "_path").select((F.col("_before") + F.col("record")).alias("_row"), read.alias("r")).select("_row", "r.*")


def from_table(raw: DataFrame, row_index: str = "_row") -> DataFrame:
    """row_index, raw_value, mb and the results of any table with a column of company ids and one of row numbers."""
    held = result_columns(raw)
    name = id_column([c for c in raw.columns if c != row_index])
    results = [(F.col(f"`{held[k]}`").try_cast("bigint") if k in held else F.lit(None).cast("bigint")).alias(k) for k in RESULTS]
    return raw.select(F.col(row_index).cast("long").alias("row_index"), F.col(f"`{name}`").cast("string").alias("raw_value"), roster_id(F.col(f"`{name}`")).alias("mb"), *results)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a roster as they stand, and `_row`, by the file's suffix: .csv, .parquet (with its own `_row`, or in order of reading) or .xlsx."""
    if path.endswith(".xls"):
        raise UnsupportedRosterError("convert the workbook to .xlsx, CSV or Parquet first")
    if path.endswith(".xlsx"):
        spark.dataSource.register(WorkbookSource)
        return spark.read.format("roster_workbook").load(path)
    if not path.endswith(".parquet"):
        lines = spark.read.text(path)
        # Without a quote in it every line is a record.
        if not lines.where(F.col("value").contains('"')).isEmpty():
            return from_records(spark, quoted_records(lines))
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, sep=";")
    return raw if "_row" in raw.columns else numbered(raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The roster of a file: row_index, raw_value, mb and the results."""
    return from_table(sheet(spark, path))


def filled(raw: DataFrame, results: DataFrame) -> DataFrame:
    """A sheet (with `_row`) with its result columns, under their own headers, taken from results (row_index, revenue, ...); the others as they were."""
    held = {name: key for key, name in result_columns(raw).items()}
    joined = raw.select("_row", F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != "_row"]).alias("sheet")).join(results.select(F.col("row_index").alias("_row"), *RESULTS), "_row", "left")
    columns = [F.col(held[c]).alias(RESULTS[held[c]]) if c in held else F.col("sheet")[c].alias(c) for c in raw.columns if c != "_row"]
    return joined.select("_row", *columns, *[F.col(k).alias(h) for k, h in RESULTS.items() if k not in held.values()])


def write(table: DataFrame, path: str) -> None:
    """A filled sheet in the order of its rows, to a new path: CSV or Parquet. Sorted by ranges, not in one task."""
    ordered = table.orderBy("_row")
    if path.endswith(".parquet"):
        ordered.write.mode("overwrite").parquet(path)
    else:
        ordered.drop("_row").write.mode("overwrite").csv(path, header=True, sep=";", escape='"')


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one sheet

    def read(self, partition: InputPartition):
        import openpyxl

        rows = openpyxl.load_workbook(self.path, read_only=True, data_only=True).active.iter_rows(min_row=2, values_only=True)
        for i, row in enumerate(rows, 2):
            cells = [None if c is None else str(c) for c in row[: len(self.columns)]]
            yield (i, *cells, *[None] * (len(self.columns) - len(cells)))


class WorkbookSource(DataSource):
    """The active sheet of an .xlsx workbook as text, with `_row`, the number of each row in the sheet."""

    @classmethod
    def name(cls) -> str:
        return "roster_workbook"

    def headers(self) -> list[str]:
        import openpyxl

        first = next(openpyxl.load_workbook(self.options["path"], read_only=True).active.iter_rows(max_row=1, values_only=True), ())
        return [str(h) if h is not None else f"_{i}" for i, h in enumerate(first)]

    def schema(self) -> str:
        return ", ".join(["_row int", *[f"`{h}` string" for h in self.headers()]])

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.headers())
