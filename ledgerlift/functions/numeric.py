"""Locale-formatted whole numbers: one column expression from raw text to value, normalised text and error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import told
from .text import bind, strip

RESULT = "struct<value:bigint,normalized:string,error:string>"


def parse(raw: Column, allow_negative: bool = True, min_value: int | None = None, max_value: int | None = None) -> Column:
    """struct(value, normalized, error): value or error is null.

    Blank text is 0 and null an error. One pair of parentheses, and signs before and after, negate. Of comma and dot
    the rightmost is the decimal separator, unless it occurs again, is followed by exactly three digits, or ends the
    text; all other ones are dropped. The fraction must be zero. Numbers beyond a long are an error of their own."""

    def result(value: Column, error: Column) -> Column:
        return F.struct(value.cast("bigint").alias("value"), value.cast("string").alias("normalized"), error.cast("string").alias("error"))

    def failed(name: str, *values: Column) -> Column:
        return result(F.lit(None), told(name, *values))

    def checked(value: Column) -> Column:
        out = result(value, F.lit(None))
        if max_value is not None:
            out = F.when(value > max_value, failed("above_maximum", value, F.lit(max_value))).otherwise(out)
        if min_value is not None:
            out = F.when(value < min_value, failed("below_minimum", value, F.lit(min_value))).otherwise(out)
        if not allow_negative:
            out = F.when(value < 0, failed("negative", value)).otherwise(out)
        return out

    def split(s: Column) -> Column:
        """Of text without signs and spaces: whole part and fraction (null if none), separators dropped."""
        last = F.regexp_extract(s, r"([,.])[^,.]*$", 1)
        tail = F.regexp_extract(s, r"[,.]([^,.]*)$", 1)
        once = F.length(s) - F.length(F.replace(s, last, F.lit(""))) == 1
        decimal = (last != "") & once & (tail != "") & ~tail.rlike("^[0-9]{3}$")
        whole = F.when(decimal, F.regexp_replace(s, r"[,.][^,.]*$", "")).otherwise(s)
        return F.struct(F.regexp_replace(whole, "[,.]", "").alias("whole"), F.when(decimal, tail).alias("fraction"))

    def number(parts: Column, sign: Column) -> Column:
        whole, fraction = parts["whole"], parts["fraction"]
        value = whole.try_cast("bigint") * sign
        return (
            F.when(~whole.rlike("^[0-9]+$"), failed("bad_integer", raw))
            .when(fraction.isNotNull() & ~fraction.rlike("^[0-9]+$"), failed("bad_fraction", raw))
            .when(fraction.isNotNull() & ~fraction.rlike("^0+$"), failed("fraction", raw))
            .when(~F.regexp_replace(whole, "^0+", "").rlike("^[0-9]{0,18}$"), failed("out_of_range", raw))
            .otherwise(bind(value, checked))
        )

    def signed(text: Column) -> Column:
        enclosed = text.rlike(r"(?s)^\(.*\)$")
        inner = strip(F.when(enclosed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text))
        leading = bind(inner, lambda t: F.struct(strip(F.regexp_replace(t, r"^[+\-−]", "")).alias("text"), F.when(t.rlike(r"^[\-−]"), -1).otherwise(1).alias("sign")))

        def rest(lead: Column) -> Column:
            body = F.replace(strip(F.regexp_replace(lead["text"], r"[+\-−]$", "")), F.lit(" "), F.lit(""))
            sign = lead["sign"] * F.when(lead["text"].rlike(r"[\-−]$"), -1).otherwise(1) * F.when(enclosed, -1).otherwise(1)
            return bind(F.struct(body.alias("body"), sign.alias("sign")), lambda b: F.when(~b["body"].rlike("[0-9]"), failed("no_digits", raw)).otherwise(bind(split(b["body"]), lambda p: number(p, b["sign"]))))

        return bind(leading, rest)

    clean = strip(F.translate(raw, "\u00a0\u2013\u2014", " --"))
    return F.when(raw.isNull(), failed("no_value")).otherwise(bind(clean, lambda t: F.when(t == "", checked(F.lit(0).cast("bigint"))).otherwise(signed(t))))


def parse_with(raw: Column, min_value: Column, max_value: Column) -> Column:
    """The same with bounds that are columns; a null bound is none."""

    def bounded(found: Column) -> Column:
        value = found["value"]
        message = F.when(value < min_value, told("below_minimum", value, min_value))
        message = message.when(value > max_value, told("above_maximum", value, max_value))
        return bind(message, lambda m: F.when(m.isNull(), found).otherwise(F.struct(F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("normalized"), m.alias("error"))))

    return bind(parse(raw), bounded)
