"""What is told of results, in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentences of errors, warnings, notes and summaries, as reports must have them.
MESSAGES = {
    "value_not_found": "No numeric value detected next to the anchor",
    "anchor_definition_missing": "Anchor definition is not available",
    "no_pages": "OCR result does not contain any pages",
    "anchor_not_found": "Anchor text was not located in the OCR output",
    "column_not_found": "Year columns could not be detected on the anchor page",
    "column_fallback_used": "Preferred year column missing; using fallback column",
    "capital_formula": "Value derived from capital AOP 0401 using the prescribed formula",
    "direct_row": "Value read directly from the loss row (AOP 0401)",
    "capital_extraction_failed": "Capital based derivation failed; using direct loss row",
    "neither_source": "Neither the capital formula nor the direct loss row produced a value",
    "no_value": "No value supplied",
    "above_maximum": "Value {} exceeds the permitted maximum of {}",
    "below_minimum": "Value {} is below the permitted minimum of {}",
    "negative": "Negative value is not permitted: {}",
    "bad_integer": "Invalid integer component in '{}'",
    "bad_fraction": "Invalid decimal component in '{}'",
    "fraction": "Non-integer value encountered: '{}'",
    "out_of_range": "Value out of range: '{}'",
    "no_digits": "No digits detected in '{}'",
    "duplicates": "Multiple {} forms detected for MB {}. Selection is based on period and modification time. Candidates: {}",
    "unknown_form": "Unable to determine form type for {} (MB {})",
    "no_document": "No {} PDF found for MB {}",
    "ocr_failed": "OCR failed for {}: {}",
    "no_id": "Excel row is missing Матични број",
    "summary": "Processed {rows_total} rows ({rows_with_mb} with Матични број). Updated {rows_with_updates} rows, wrote {values_written} values (skipped {values_skipped} existing).",
    "missing_fields": "Missing fields: {}",
}


def told(name: str, *values: Column) -> Column:
    """A message with columns in its gaps; null if one of them is."""
    pieces = MESSAGES[name].split("{}")
    return F.concat(F.lit(pieces[0]), *[c for v, piece in zip(values, pieces[1:], strict=True) for c in (v.cast("string"), F.lit(piece))])
