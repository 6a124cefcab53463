"""Text functions on columns. All patterns spell Unicode out: Spark's own trim knows the space alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and the Cyrillic letters that look like them, pair by pair.
LATIN = "ABCEHhKkMmOPTtXYaceopxyJj"
CYRILLIC = "АВСЕНнКкМмОРТтХУасеорхуЈј"

# Names of forms and periods.
PERIODS = {"текућа": "current", "tekuca": "current", "current": "current", "pret": "previous", "прет": "previous", "previous": "previous"}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\u001C-\u001F]+|[\s\u001C-\u001F]+$", "")


def has_text(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"(?U)[^\s\u001C-\u001F]")


def fold(c: Column) -> Column:
    """Latin letters that look like Cyrillic ones become those."""
    return F.translate(c, LATIN, CYRILLIC)


def numeric_like(c: Column) -> Column:
    return c.rlike(r"(?U)[\d\-−()+]")


def lone_digits(c: Column) -> Column:
    """The first four digits without digits beside them, or an empty text."""
    return F.regexp_extract(c, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)


def token(c: Column) -> Column:
    """Folded, lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(fold(c)), r"[^\p{L}\p{N}]", "")


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s.:;\-]+", "")


def roster_id(c: Column) -> Column:
    """Digits of a roster cell, zeros kept."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\D", "")


def index_id(c: Column) -> Column:
    """Digits without leading zeros; only zeros stay as they are, and a text without digits too."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(bare != "", bare).when(digits != "", digits).otherwise(c)


def form_type(c: Column) -> Column:
    name = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(name.isin("bu", "bs"), name).when(name.contains("uspeh"), "bu").when(name.contains("stanj"), "bs").when(name == "", "unknown").otherwise(name)


def period_label(c: Column) -> Column:
    """The label of a period, unknown names as they are, blank ones null."""
    name = F.lower(strip(c))
    found = F.when(name == "", F.lit(None).cast("string")).otherwise(name)
    for spelt, label in PERIODS.items():
        found = F.when(name == spelt, F.lit(label)).otherwise(found)
    return found


#: A run of digits that is an id.
ID = r"(?<![0-9])([0-9]{8,9})(?![0-9])"


def document_id(text: Column) -> Column:
    """The first run of 8 or 9 digits, as an index id; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), ID, 1)
    return F.when(found != "", index_id(found))


def without_ids(text: Column) -> Column:
    """A text with a space for each run of 8 or 9 digits."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ID, " ")


def index_year(text: Column) -> Column:
    """The largest number 20dd in a text, wherever it stands; null if there is none."""
    years = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(20[0-9]{2})"), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def standalone_years(text: Column) -> Column:
    """All numbers of exactly four digits from 2000 on in a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y >= 2000)


def region(box: Column, width: int, height: int) -> Column:
    """left, top, width and height of four numbers, clipped to an image: corners if the last two lie beyond the first two, else a size."""

    def clipped(b: Column) -> Column:
        corners = (b[2] > b[0]) & (b[3] > b[1])
        wide = F.greatest(F.when(corners, F.least(b[2], F.lit(width)) - b[0]).otherwise(b[2]), F.lit(1))
        high = F.greatest(F.when(corners, F.least(b[3], F.lit(height)) - b[1]).otherwise(b[3]), F.lit(1))
        left, top = F.greatest(F.lit(0), F.least(b[0], F.lit(width - 1))), F.greatest(F.lit(0), F.least(b[1], F.lit(height - 1)))
        return F.struct(left.alias("left"), top.alias("top"), F.least(wide, F.lit(width) - left).alias("width"), F.least(high, F.lit(height) - top).alias("height"))

    return bind(F.transform(box, lambda x: F.bround(x).cast("int")), clipped)
