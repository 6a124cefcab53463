"""Year columns and the row-code column of pages, carried forward along the pages of a document."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import MESSAGES
from ..functions.text import standalone_years
from ..functions.vocabulary import CODE_COLUMN_TOKENS, YEAR_PATTERNS, YEAR_SYNONYMS
from ..schemas import COLUMN
from .flat import Band, Lot, token
from .labels import parts

LABELS = ("current", "previous")
PATTERNS = {label: re.compile(p, re.IGNORECASE) for label, p in YEAR_PATTERNS.items()}
#: The spellings of a year column's header as tokens.
SPELT = {label: [[t for t in map(token, v.split()) if t] for v in YEAR_SYNONYMS[label]] for label in LABELS}
#: Tokens without which no header stands on a page: beginnings of spellings, parts of patterns; of the code column the name and its letters.
FIRST_TOKENS = frozenset(v[0] for spelt in SPELT.values() for v in spelt)
PARTS = tuple(p for pattern in YEAR_PATTERNS.values() for p in parts(pattern))
CODE_NAMES = frozenset(CODE_COLUMN_TOKENS)
CODE_TOKENS = CODE_NAMES | frozenset(c for t in CODE_COLUMN_TOKENS for c in t)
#: What a word can be of, as bits: any header; the first of a year's header in words, by label; the row codes' header; a row's label.
HEADS, CODES, PARTIAL = 1, 2, 4
FIRST = {"current": 8, "previous": 16}
FIRST_OF = {t: sum(FIRST[label] for label in LABELS if any(v[0] == t for v in SPELT[label])) for t in FIRST_TOKENS}


#: Earlier years are none of a document's: a number that equals one is an amount like any other.
LEAST_YEAR = 2000


class YearColumn(NamedTuple):
    """A year or row-code column, in the order of schemas.COLUMN."""

    page: int
    label: str
    left: int
    top: int
    right: int
    bottom: int
    text: str | None


def heads_a_column(text: str, its_token: str) -> bool:
    """Whether a word can be of a year's header in words or of the row codes' header."""
    if its_token in FIRST_TOKENS or its_token in CODE_TOKENS:
        return True
    low = text.lower()
    return any([p in low for p in PARTS])


def topmost(found: Iterable[YearColumn]) -> YearColumn | None:
    """The column of smallest top, the first of equal ones."""
    return min(found, key=lambda c: c.top, default=None)


def kind_of(text: str, its_token: str) -> int:
    """What a word of this text can be of, but for row labels."""
    return HEADS * heads_a_column(text, its_token) | CODES * (its_token in CODE_TOKENS) | FIRST_OF.get(its_token, 0)


def run_at(tokens: list[str], wanted: list[str]) -> int | None:
    """Place of the first run of tokens equal to wanted."""
    if wanted[0] not in tokens:
        return None
    return next((i for i in range(len(tokens) - len(wanted) + 1) if tokens[i : i + len(wanted)] == wanted), None)


def dates_of(year: int) -> dict[str, str]:
    """The numbers that head the columns of a document's year: none if that year, told by no document, is before all that count."""
    return {"current": str(year), "previous": str(year - 1)} if year >= LEAST_YEAR else {}


def year_column(label: str, page: int, year: int, bands: list[Band], lot: Lot, numbers: list[tuple[int, str]], texts: bool = True) -> YearColumn | None:
    """The column of one label on a page: its header in words, or the year's number, whichever is higher.

    bands are those that can hold a header, numbers the page's words with four lone digits, and the text of their lines. The text of
    a header's band is told if `texts`."""
    number = dates_of(year).get(label)
    left, top, right, bottom = (lot.held[c] for c in ("left", "top", "right", "bottom"))
    by_tokens = []
    spelt = [*SPELT[label], [number]] if number else SPELT[label]
    for band in bands:
        if not band.kinds & FIRST[label]:
            continue
        named, names = band.named
        for wanted in spelt:
            at = run_at(names, wanted)
            if at is not None:
                own = named[at : at + len(wanted)]
                by_tokens.append(YearColumn(page, label, min([left[w] for w in own]), min([top[w] for w in own]), max([right[w] for w in own]), max([bottom[w] for w in own]), band.text if texts else None))
                break
    header = topmost(by_tokens) or topmost(YearColumn(page, label, *b.box, b.text) for b in bands if PATTERNS[label].search(b.text))
    in_lines = [YearColumn(page, label, left[w], top[w], right[w], bottom[w], text) for w, text in numbers if number and lot.year_digits[w] == number]
    return topmost([header, *in_lines] if header else in_lines)


def code_column(page: int, bands: list[Band], lot: Lot) -> YearColumn | None:
    """The column of row codes: a band with its header's token, or its three letters one below the other."""

    def holds(band: Band) -> bool:
        _, names = band.named
        stacked = ["".join(names[i : i + 3]) for i in range(len(names)) if len(names[i]) == 1 and all([len(t) == 1 for t in names[i : i + 3]])]
        return not CODE_NAMES.isdisjoint([*names, *stacked])

    def may_hold(band: Band) -> bool:
        own = [lot.tokens[w] for w in band.words]
        return not CODE_NAMES.isdisjoint(own) or sum([len(t) == 1 for t in own]) >= 3

    return topmost([YearColumn(page, "aop", *b.box, b.text) for b in bands if b.kinds & CODES and may_hold(b) and holds(b)])


class Carried:
    """The columns that hold on the pages of a document, page by page: a page with any year column uses its own ones only."""

    def __init__(self):
        self.doc_id: str | None = None
        self.columns: dict[str, YearColumn | None] | None = None
        self.codes: YearColumn | None = None

    def on(self, doc_id: str, own: dict[str, YearColumn | None], codes: YearColumn | None) -> tuple[dict[str, YearColumn | None] | None, YearColumn | None]:
        if doc_id != self.doc_id:
            self.__init__()
            self.doc_id = doc_id
        if any(own.values()):
            self.columns = own
        self.codes = codes or self.codes
        return self.columns, self.codes


def reference_years(pages: DataFrame, as_of_year: int) -> DataFrame:
    """doc_id and year: the largest standalone number from 2000 on in a document's text, else as_of_year."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.max(F.array_max(standalone_years(F.col("text")))), F.lit(as_of_year)).alias("year"))


def center(span: tuple) -> float:
    """The middle of anything with left and right edges."""
    return (span.left + span.right) / 2.0


def bounds(chosen: YearColumn, other: YearColumn | None, anchor_right: int, line_right: int) -> tuple[float, float]:
    """left and right of the strip that belongs to a column, halfway to its neighbour or extended."""
    wide = max(chosen.right - chosen.left, 1)
    extension, middle = max(wide * 1.5, 80.0), center(chosen)
    left, right = chosen.left - extension, max(chosen.right + extension, float(line_right))
    if other and center(other) < middle:
        left = (center(other) + middle) / 2.0
    if other and center(other) > middle:
        right = (center(other) + middle) / 2.0
    left = max(left, float(anchor_right))
    return left, right if right > left else left + max(float(wide), extension / 2.0)


def chosen_of(columns: dict[str, YearColumn | None] | None, preferred: str) -> tuple[YearColumn | None, YearColumn | None]:
    """The preferred column, else the first there is; and its neighbour."""
    if columns:
        for label in (preferred, *LABELS):
            if columns.get(label):
                return columns[label], columns["previous" if label == "current" else "current"]
    return None, None


def select_column(columns: Column, preferred: str) -> Column:
    """struct(column, warning): the preferred column, else the first there is with a warning."""
    spare = [label for label in LABELS if label != preferred]
    available = F.concat_ws(", ", *[F.when(columns[label].isNotNull(), F.lit(f"'{label}'")) for label in LABELS])
    listed = F.concat(F.lit("["), available, F.lit("]"))

    def warned(code: str, text: str, *context: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"), F.create_map(*context, F.lit("preferred"), F.lit(preferred), F.lit("available_columns"), listed).alias("context"))

    def chosen(label: str, warning: Column) -> Column:
        return F.struct(columns[label].alias("column"), warning.alias("warning"))

    none = F.lit(None).cast("struct<code:string,message:string,context:map<string,string>>")
    missing = warned("column_not_found", MESSAGES["column_not_found"])
    out = F.struct(F.lit(None).cast(COLUMN).alias("column"), missing.alias("warning"))
    for label in reversed(spare):
        fallback = warned("column_fallback_used", MESSAGES["column_fallback_used"], F.lit("selected"), F.lit(label))
        out = F.when(columns[label].isNotNull(), chosen(label, fallback)).otherwise(out)
    if preferred in LABELS:
        out = F.when(columns[preferred].isNotNull(), chosen(preferred, none)).otherwise(out)
    return out
