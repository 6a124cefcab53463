"""Pages laid out by hand, one per behaviour, each at several places of the sheet and with several amounts, and what a field gives.

A page is a list of lines (top, words); words are "left:text" or "left-right:text", else 52 wide; all are 18 high. {a} is the amount."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerlift.functions.vocabulary import FIELDS, Field
from ledgerlift.operators.extract import extract, page_features, page_words, read_fields
from ledgerlift.schemas import WORDS

NOW, BEFORE = "610:текуће 672:године", "820:претходне 882:године"
REVENUE, ASSETS, LOSS = "30:Poslovni 95:prihodi", "30:Ukupna 95:aktiva", "30:Gubitak 95:iznad 160:visine 225:kapitala"
CAPITAL = "30-44:А. 55:КАПИТАЛ 300:AOP 360:0401"
#: name: (pages, field, value of the amount, column, codes of warnings)
CASES = {
    "amount_in_two_words": ([[(25, NOW), (90, f"{REVENUE} 612-640:{{a}} 648-676:014")]], "revenue", lambda a: a * 1000 + 14, "current", []),
    "both_columns": ([[(25, f"{NOW} {BEFORE}"), (90, f"{REVENUE} 630:{{a}} 850:77")]], "revenue", lambda a: a, "current", []),
    "amount_nearer_the_other_column": ([[(25, f"{NOW} {BEFORE}"), (90, f"{REVENUE} 850:{{a}}")]], "revenue", lambda a: a, "current", []),
    "words_of_one_line_in_any_order": ([[(25, NOW), (90, f"630:{{a}} {REVENUE}")]], "revenue", lambda a: a, "current", []),
    "empty_cell": ([[(25, NOW), (90, ASSETS)]], "assets", lambda a: 0, "current", []),
    "only_a_number_before_the_label": ([[(25, NOW), (90, "10-40:{a} 200:Poslovni 265:prihodi")]], "revenue", lambda a: a, "current", []),
    "only_the_other_year": ([[(25, BEFORE), (90, f"{REVENUE} 840:{{a}}")]], "revenue", lambda a: a, "previous", ["column_fallback_used"]),
    "sum_of_codes_after_the_amount": ([[(25, NOW), (90, f"{REVENUE} 420:АОП077 480-492:+ 500:АОП081 640:{{a}}")]], "revenue", lambda a: a, "current", []),
    "row_codes_in_their_column": ([[(25, "330:AOP"), (90, f"{REVENUE} 330:1001 640:{{a}}")]], "revenue", lambda a: a, None, ["column_not_found"]),
    "row_codes_below_stacked_letters": ([[(20, "332-350:А"), (50, "333-351:О"), (80, f"332-350:П {NOW}"), (150, f"{REVENUE} 330-372:1001 640:{{a}}")]], "revenue", lambda a: a, "current", []),
    "label_over_lines": ([[(25, NOW), (90, "30:Губитак"), (118, "32:изнад"), (146, "31:висине"), (174, "30:капитала 640:{a}")]], "loss_row", lambda a: a, "current", []),
    "amount_on_a_line_of_its_own": ([[(25, NOW), (90, LOSS), (95, "640:{a}")]], "loss_row", lambda a: a, "current", []),
    "letters_of_two_scripts": ([[(25, NOW), (90, "30:УKУПHА 95:АKTИВА 640:{a}")]], "assets", lambda a: a, "current", []),
    "label_with_a_hyphen": ([[(25, NOW), (90, "30-150:пословни-приходи 640:{a}")]], "revenue", lambda a: a, "current", []),
    "code_without_label": ([[(25, f"330:АОП {NOW}"), (140, "330:1001 640:{a}")]], "revenue", lambda a: a, "current", []),
    "columns_of_an_earlier_page": ([[(25, NOW)], [(25, "30:даље")], [(90, f"{REVENUE} 640:{{a}}")]], "revenue", lambda a: a, "current", []),
    "columns_of_its_own_page": ([[(25, NOW)], [(25, "430:текуће 492:године"), (90, f"{REVENUE} 440:{{a}} 640:31")]], "revenue", lambda a: a, "current", []),
    "years_as_headers": ([[(25, "400:2041 640:2042"), (90, f"{REVENUE} 405:19 640:{{a}}")]], "revenue", lambda a: a, "current", []),
    "first_page_that_tells": ([[(25, NOW), (90, f"{REVENUE} 640:{{a}}")], [(90, f"{REVENUE} 640:55")]], "revenue", lambda a: a, "current", []),
    "capital_below_zero": ([[(25, NOW), (90, f"{CAPITAL} 620:({{a}})")]], "capital_loss", lambda a: a, "current", ["diagnostic_value_source"]),
    "capital_above_zero": ([[(25, NOW), (90, f"{CAPITAL} 640:{{a}}")]], "capital_loss", lambda a: 0, "current", ["diagnostic_value_source"]),
    "loss_row_instead_of_capital": ([[(25, NOW), (90, f"{LOSS} 640:{{a}}")]], "capital_loss", lambda a: a, "current", ["capital_extraction_failed", "diagnostic_value_source"]),
}
FAILURES = {
    "no_pages": ([], "revenue", ["no_pages"]),
    "no_label": ([[(25, NOW), (90, "30:нешто 95:друго 640:{a}")]], "revenue", ["anchor_not_found"]),
    "neither_column_nor_number": ([[(90, REVENUE)]], "revenue", ["column_not_found", "value_not_found"]),
    "below_the_least_value": ([[(25, NOW), (90, f"{ASSETS} 640:-{{a}}")]], "assets", ["value_normalization_failed"]),
    "fraction": ([[(25, NOW), (90, f"{REVENUE} 640:{{a}},5")]], "revenue", ["value_normalization_failed"]),
    "nothing_for_the_derived_field": ([[(25, NOW), (90, "30:ништа")]], "capital_loss", ["anchor_not_found", "anchor_not_found"]),
    "label_that_is_not_defined": ([[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], "unknown", ["anchor_definition_missing"]),
}
#: (across, down, amount) of the variants.
VARIANTS = ((0, 0, 463), (141, 37, 905), (8, 260, 118))


def words_of(doc: str, pages: list, across: int = 0, down: int = 0, amount: int = 463) -> list[tuple]:
    rows = []
    for page, lines in enumerate(pages, 1):
        pos = 0
        for number, (top, line) in enumerate(lines, 1):
            for word in line.split():
                left, right, text = re.fullmatch(r"(\d+)(?:-(\d+))?:(.+)", word).groups()
                width = int(right) - int(left) if right else 52
                rows.append((doc, page, pos, 5, 1, 1, number, pos, int(left) + across, top + down, width, 18, "91", text.format(a=amount)))
                pos += 1
    return rows


@pytest.fixture(scope="module")
def results(spark):
    every = {f"{name}/{i}": (case[0], v) for name, case in (CASES | FAILURES).items() for i, v in enumerate(VARIANTS)}
    words = spark.createDataFrame([r for name, (pages, v) in every.items() for r in words_of(name, pages, *v)], WORDS)
    pages = words.groupBy("doc_id", "page").agg(F.array_join(F.collect_list("text"), "\n").alias("text"), F.lit(None).cast("double").alias("confidence"))
    docs = spark.createDataFrame([(n,) for n in every], "doc_id string")
    others = read_fields(page_words(words, pages, 2024), docs, pages, [FIELDS["loss_row"], Field("unknown", "bu", "nowhere")])
    return {(r.doc_id, r.field): r.result for r in extract(words, pages, docs, 2024).unionByName(others).collect()}


@pytest.mark.parametrize("name", CASES)
def test_value(results, name):
    _, field, value, label, warnings = CASES[name]
    for i, (_, _, amount) in enumerate(VARIANTS):
        found = results[f"{name}/{i}", field]
        assert (found.value, found.column_label, [w.code for w in found.warnings], found.errors) == (value(amount), label, warnings, [])


@pytest.mark.parametrize("name", FAILURES)
def test_failure(results, name):
    _, field, errors = FAILURES[name]
    for i in range(len(VARIANTS)):
        found = results[f"{name}/{i}", field]
        assert found.value is None and [e.code for e in found.errors] == errors


def test_columns_of_pages(spark):
    layouts = {"stacked": [[(15, "500:текућа"), (47, "503:година")]], "years": [[(30, "210:2033 470:2034")]], "latin": [[(12, "75:TEKUCA 140:GODINA")]], "none": [[(12, "75:само 140:речи")]]}
    words = spark.createDataFrame([r for name, pages in layouts.items() for r in words_of(name, pages)], WORDS)
    pages = words.groupBy("doc_id", "page").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    found = {r.doc_id: r["columns"] for r in page_features(words, pages, 2034).collect()}
    assert (found["stacked"].current.left, found["stacked"].current.top, found["stacked"].current.bottom, found["stacked"].previous) == (500, 15, 65, None)
    assert (found["years"].current.left, found["years"].previous.left) == (470, 210)
    assert found["latin"].current.right == 192 and found["none"] is None


def test_a_page_of_600_words(spark):
    """A page as large as a real one: its columns and the one labelled row are found among 28 rows of other text."""
    rows = [(80 + 30 * i, " ".join(f"{30 + 40 * k}-{60 + 40 * k}:{'реч' if k < 10 else 'x'}" for k in range(21))) for i in range(28)]
    rows[17] = (rows[17][0], f"{REVENUE} 640:{{a}}")
    words = spark.createDataFrame(words_of("full", [[(25, NOW), *rows]]), WORDS)
    pages = words.groupBy("doc_id", "page").agg(F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence"))
    found = {r.field: r.result for r in extract(words, pages, words.select("doc_id").distinct(), 2024).collect()}
    assert found["revenue"].value == 463 and found["assets"].value is None
