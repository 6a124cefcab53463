"""Documents that stand for others of the same words and places: few pages are looked at, and each tells its own numbers."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlift.functions.vocabulary import FIELDS
from ledgerlift.operators import extract, flat
from ledgerlift.operators.columns import LEAST_YEAR
from ledgerlift.operators.labels import labels_of
from ledgerlift.plans import statements as st
from ledgerlift.plans.queries import QUERIES

from .test_queries import SF
from .test_whole import WHOLE, same

KEYS = ("bs_capital_aop0401", "bs_loss", "bu_revenue")
TEXTS = ["Пословни", "приходи", "1001", "0401", "A.", "КАПИТАЛ", "Губитак", "изнад", "висине", "капитала", "Текућа", "година", "Претходна", "АОП", "x", " y ", "", None]
NUMBERS = ["7", "12", "3.400", "-7", "(5)", "12,00", "10401", "94010", "1001", "000", "1.000", "2042", "2.041", "(2042)", "2041", "1990", "3+4", "5=5", "-", "()", "401-", "123456789012345678901", " 8", "4 ", "６"]


@pytest.fixture(scope="module")
def repeated(spark):
    """Twelve layouts, each of forty documents that differ in their numbers."""
    dice, rows = random.Random(5), []
    for layout in range(12):
        looks = []
        for page in range(1, dice.randrange(1, 3) + 1):
            looks.append([(5, 1, dice.randrange(2), dice.randrange(4), dice.randrange(0, 800, 40), dice.randrange(0, 120, 20), 36, 20, dice.choice([*TEXTS, 1, 1, 1, 1, 1, 1])) for _ in range(dice.choice((12, 25)))])
        for n in range(40):
            held = [[(*w[:-1], dice.choice(NUMBERS[:6] if dice.random() < 0.9 else NUMBERS) if w[-1] == 1 else w[-1]) for w in page] for page in looks]
            rows.append((f"d{dice.randrange(10**6):06d}-{layout}-{n}", [(i, "\n".join(w[-1] or "" for w in page), page) for i, page in enumerate(held, 1)]))
    dice.shuffle(rows)
    whole = spark.createDataFrame(rows, WHOLE).repartition(2).cache()
    paged = whole.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    return whole, paged.select("doc_id", "page", F.posexplode("words").alias("pos", "w")).select("doc_id", "page", "pos", "w.*"), paged.select("doc_id", "page", "text")


def batch_of(documents, year=1990):
    table = extract.dated(documents, year).toArrow()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], schema=table.schema)


def test_each_tells_its_own_numbers(repeated):
    whole, words, paged = repeated
    assert len(flat.alike(batch_of(whole), labels_of(KEYS).digits, LEAST_YEAR).standing) < whole.count() * 0.7
    for year, preferred in ((1990, "current"), (2042, "previous")):
        told = extract.whole_fields(whole, list(FIELDS.values()), year, preferred)
        same(told, extract.read_fields(extract.page_words(words, paged, year), whole, paged, list(FIELDS.values()), preferred))
        assert told.where("result.value is not null").select("result.value").distinct().count() > 5


def test_few_pages_of_orders_are_looked_at(spark):
    """multiline_anchor's and extract_capital_loss's own documents: of all orders a few in a hundred stand for themselves."""
    docs = st.orders(spark, SF)
    rows = batch_of(st.statements(docs))
    like = flat.alike(rows, labels_of(KEYS).digits, LEAST_YEAR)
    assert rows.num_rows == docs.count() and len(like.standing) < 0.15 * rows.num_rows
    looked = [lot for *_, lot, _ in flat.whole_alike([rows], labels_of(KEYS).digits, LEAST_YEAR)]
    assert sum(len(lot.doc_ids) for lot in looked) < 0.2 * rows.num_rows


def test_what_stands_for_itself(spark):
    word = lambda text, left=20, line=1: (5, 1, 1, line, left, 40, 36, 20, text)
    page = lambda *words: [(1, "", list(words))]
    rows = [("first", page(word("x"))), ("a", page(word("12"))), ("b", page(word("3.400"))), ("c", page(word("12", 21))), ("d", page(word("12", line=2))), ("e", page(word("9401"))), ("f", page(word("3+4"))), ("g", page(word("-"))), ("h", [(2, "", [word("12")])]), ("i", page(word("12"))), ("i", page(word("12"))), ("j", page(word("2042"))), ("k", page(word("(77)"))), ("last", page(word("12")))]
    documents = spark.createDataFrame(rows, WHOLE).coalesce(1)

    def told(year):
        like = flat.alike(batch_of(documents, year), labels_of(KEYS).digits, LEAST_YEAR)
        return [rows[like.standing[n]][0] for n in like.of]

    assert told(1990) == ["first", "a", "a", "c", "d", "e", "f", "g", "h", "i", "i", "a", "a", "last"]
    assert told(2042)[11:13] == ["j", "a"] and told(2043)[11:13] == ["j", "a"] and told(2044)[11:13] == ["a", "a"]
    assert len(flat.alike(batch_of(documents), labels_of(KEYS).digits, LEAST_YEAR).standing) == 11


def test_columns_are_carried_within_an_id_only(spark):
    """Rows of one id carry columns along; what stands for others between them does not."""
    heads = [(5, 1, 1, 1, 440, 40, 36, 20, "Текућа"), (5, 1, 1, 1, 480, 40, 36, 20, "година")]
    rows = [("a", [(1, "", heads)]), ("b", [(1, "", [(5, 1, 1, 1, 20, 40, 36, 20, "Пословни"), (5, 1, 1, 1, 60, 40, 36, 20, "приходи"), (5, 1, 1, 1, 760, 40, 36, 20, "5")])])]
    documents = spark.createDataFrame([rows[0], ("a", [(2, "", rows[1][1][0][2])]), *[(f"b{i}", rows[1][1]) for i in range(4)], ("a", rows[1][1])], WHOLE).coalesce(1)
    found = extract.whole_results(documents, [FIELDS["revenue"]], 1990).select("doc_id", "revenue.value", "revenue.column_label").collect()
    assert [(r.value, r.column_label) for r in found] == [(None, None), (5, "current")] + [(5, None)] * 5



def test_the_loss_row_waits(spark, repeated):
    """capital_loss from both fields, without the row's result being computed for every document."""
    whole, _, _ = repeated
    fields = [FIELDS["capital"], FIELDS["loss_row"]]
    told = extract.whole_loss(whole, fields, 1990)
    both = extract.whole_results(whole, fields, 1990).cache()
    same(told, both.select("doc_id", extract.loss_above_capital(F.col("capital"), F.col("loss_row")).alias("capital_loss")))
    assert both.where("capital.value is null").count() and "AS loss_row" not in QUERIES["extract_capital_loss"](spark, SF)._jdf.queryExecution().executedPlan().toString()
