"""Roster, results, conditional upsert, exceptions report and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import MESSAGES, told as message
from ..functions.text import has_text
from ..schemas import RESULTS
from .extract import success
from .index import roster_key

FORM_OF = {"revenue": "bu", "assets": "bs", "capital_loss": "bs"}
NO_NOTES = "array<string>"


def has_value(c: Column) -> Column:
    return has_text(c.cast("string"))


def missing_documents(roster: DataFrame, latest: DataFrame) -> DataFrame:
    """Roster rows and forms without a document: row_index, mb, form_type."""
    forms = roster.where("mb <> ''").select("row_index", "mb", roster_key(F.col("mb")).alias("mb_key"), F.explode(F.array(F.lit("bu"), F.lit("bs"))).alias("form_type"))
    return forms.join(latest.select("mb_key", "form_type"), ["mb_key", "form_type"], "left_anti").drop("mb_key")


def notes_of(result: Column) -> Column:
    """Errors, then warnings, as text: LEVEL code: message (k=v, ...) with keys sorted."""

    def told(level: str, messages: Column) -> Column:
        def one(m: Column) -> Column:
            pairs = F.array_join(F.transform(F.array_sort(F.map_entries(m["context"])), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ", ")
            return F.concat(F.lit(f"{level} "), m["code"], F.lit(": "), m["message"], F.when(F.size(m["context"]) > 0, F.concat(F.lit(" ("), pairs, F.lit(")"))).otherwise(F.lit("")))

        return F.transform(messages, one)

    return F.concat(told("ERROR", result["errors"]), told("WARNING", result["warnings"]))


def field_rows(roster: DataFrame, latest: DataFrame, results: DataFrame, overwrite: bool, failures: DataFrame | None = None) -> DataFrame:
    """One row per roster row with an id and needed field: value (accepted ones only), notes and missing.

    A document without results has failed; failures (doc_id, error) may tell why."""
    needed = F.array_compact(F.array(*[F.when(F.lit(overwrite) | ~F.coalesce(has_value(F.col(k)), F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(k).alias("field"), F.lit(FORM_OF[k]).alias("form_type"))) for i, k in enumerate(RESULTS)]))
    rows = roster.where("mb <> ''").select("row_index", "mb", roster_key(F.col("mb")).alias("mb_key"), F.explode(needed).alias("n")).select("row_index", "mb", "mb_key", "n.*")
    found = rows.join(latest.select("mb_key", "form_type", "doc_id", "path"), ["mb_key", "form_type"], "left").join(results.select("doc_id", "field", "result"), ["doc_id", "field"], "left")
    found = found.join(failures.select("doc_id", "error"), "doc_id", "left") if failures is not None else found.withColumn("error", F.lit(None).cast("string"))
    absent = F.array(message("no_document", F.upper("form_type"), F.col("mb")))
    unread = F.array(message("ocr_failed", F.coalesce("path", "doc_id"), F.coalesce("error", F.lit("no result"))))
    notes = F.when(F.col("doc_id").isNull(), absent).when(F.col("result").isNull(), unread).otherwise(notes_of(F.col("result")))
    value = F.when(F.coalesce(success(F.col("result")), F.lit(False)), F.col("result.value"))
    # Both fields of a form share the note that its document is missing.
    return found.select("row_index", "mb", "ord", "field", "form_type", value.alias("value"), notes.alias("notes"), F.col("doc_id").isNull().alias("undocumented"), value.isNull().alias("missing"))


def per_row(roster: DataFrame, fields: DataFrame, index_notes: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """One row per roster row: new values, skipped, missing forms and fields, and all notes in order."""
    first_of_form = ~F.col("undocumented") | (F.col("field") != "capital_loss") | ~F.col("assets_too")
    both = fields.withColumn("assets_too", F.max(F.col("field") == "assets").over(_row_form()))
    kept = both.withColumn("notes", F.when(first_of_form, F.col("notes")).otherwise(F.array().cast(NO_NOTES)))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "notes")))
    told = kept.groupBy("row_index").agg(
        *[F.max(F.when(F.col("field") == k, F.col("value"))).alias(f"new_{k}") for k in RESULTS],
        F.max((F.col("form_type") == "bu") & F.col("missing")).alias("missing_bu"),
        F.max((F.col("form_type") == "bs") & F.col("missing")).alias("missing_bs"),
        F.array_sort(F.collect_set(F.when(F.col("missing"), F.col("field")))).alias("missing_fields"),
        F.flatten(F.transform(ordered, lambda n: n["notes"])).alias("field_notes"),
    )
    out = roster.join(told, "row_index", "left")
    # Index notes are keyed by ids without leading zeros; the roster's id is taken as it is, so ids with leading zeros find none.
    out = out.join(index_notes.select(F.col("mb_key").alias("mb"), F.col("notes").alias("index_notes")), "mb", "left") if index_notes is not None else out.withColumn("index_notes", F.lit(None).cast(NO_NOTES))
    none = F.array().cast(NO_NOTES)
    blank = F.col("mb") == ""
    skipped = sum((F.when(F.coalesce(has_value(F.col(k)), F.lit(False)) & ~F.lit(overwrite), 1).otherwise(0) for k in RESULTS), F.lit(0))
    return out.select(
        "row_index", "mb", *RESULTS, *[f"new_{k}" for k in RESULTS],
        F.when(blank, 0).otherwise(skipped).alias("skipped"),
        F.coalesce("missing_bu", F.lit(False)).alias("missing_bu"),
        F.coalesce("missing_bs", F.lit(False)).alias("missing_bs"),
        F.coalesce("missing_fields", none).alias("missing_fields"),
        F.when(blank, F.array(F.lit(MESSAGES["no_id"]))).otherwise(F.concat(F.coalesce("index_notes", none), F.coalesce("field_notes", none))).alias("notes"),
    )


def _row_form():
    from pyspark.sql import Window

    return Window.partitionBy("row_index", "form_type")


def upsert(rows: DataFrame, overwrite: bool = False, clear: bool = False) -> DataFrame:
    """The roster with new values: into empty cells only, or over all if overwrite.

    With clear, overwriting a row that got any value empties the cells of fields that got none."""
    updates = sum((F.when(F.col(f"new_{k}").isNotNull(), 1).otherwise(0) for k in RESULTS), F.lit(0))

    def cell(k: str) -> Column:
        old, new = F.col(k), F.col(f"new_{k}")
        if overwrite:
            return F.when(updates > 0, new if clear else F.coalesce(new, old)).otherwise(old)
        return F.when(F.coalesce(has_value(old), F.lit(False)), old).otherwise(new)

    return rows.select("row_index", "mb", *[cell(k).alias(k) for k in RESULTS])


def exceptions(rows: DataFrame) -> DataFrame:
    """The report: rows with anything missing or noted, as text."""
    shown = rows.where("missing_bu or missing_bs or size(missing_fields) > 0 or size(notes) > 0")
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return shown.select(
        "row_index", F.when(F.col("mb") == "", "<missing>").otherwise(F.col("mb")).alias("MB"), yes("missing_bu").alias("missing_bu"), yes("missing_bs").alias("missing_bs"),
        F.array_join(F.array_sort(F.array_distinct("missing_fields")), ",").alias("missing_fields"), F.array_join("notes", " | ").alias("notes"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """The report as one CSV file. A report is one line per exception; only here its rows are put in order in one task."""
    report.orderBy("row_index").drop("row_index").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True, escape='"', emptyValue="", lineSep="\r\n")


def summary(counted: dict) -> str:
    """What a run did, from its counters, as two lines of text."""
    told = MESSAGES["summary"].format(**counted)
    missing = ", ".join(f"{k}:{counted[f'missing_{k}']}" for k in RESULTS if counted[f"missing_{k}"])
    return told + ("\n" + MESSAGES["missing_fields"].format(missing) if missing else "")


def counters(rows: DataFrame) -> DataFrame:
    """Run counters in one row."""
    written = sum((F.when(F.col(f"new_{k}").isNotNull(), 1).otherwise(0) for k in RESULTS), F.lit(0))
    missing = [F.count_if(F.array_contains("missing_fields", k)).alias(f"missing_{k}") for k in RESULTS]
    return rows.agg(
        F.count("*").alias("rows_total"), F.count_if(F.col("mb") != "").alias("rows_with_mb"), F.count_if(written > 0).alias("rows_with_updates"),
        F.coalesce(F.sum(written), F.lit(0)).alias("values_written"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("values_skipped"), *missing,
    )
