"""Documents that come whole in a row: the same results as from tables of words, and plans that deal no words."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlift.functions.vocabulary import FIELDS
from ledgerlift.operators import clusters, extract, pages
from ledgerlift.plans.queries import QUERIES

from .test_queries import SF

WHOLE = "doc_id string, pages array<struct<page:int,text:string,words:array<struct<level:int,block:int,par:int,line:int,left:int,top:int,width:int,height:int,text:string>>>>"
TEXTS = ["Пословни", "приходи", "1001", "0059", "Укупна", "актива", "A.", "КАПИТАЛ", "0401", "Текућа", "година", "Претходна", "2042", "2041", "АОП", "12", "3.400", "-7", "(5)", "x", " y ", "", " ", None]


@pytest.fixture(scope="module")
def both(spark):
    """Documents of random words, with blanks, other levels, empty pages and no pages: whole, and as tables of words and pages."""
    dice, rows = random.Random(11), []
    for doc in range(120):
        held = []
        for page in range(1, dice.randrange(0, 4) + 1):
            words = [
                (dice.choice((5, 5, 5, 4)), 1, dice.randrange(2), dice.randrange(5), dice.randrange(0, 800, 20), dice.randrange(0, 120, 8), dice.randrange(5, 90), dice.choice((0, 18, 20)), dice.choice(TEXTS))
                for _ in range(dice.choice((0, 1, 12, 30)))
            ]
            held.append((page, "\n".join(w[-1] or "" for w in words), words))
        rows.append((f"d{doc:03d}", held))
    whole = spark.createDataFrame(rows, WHOLE).cache()
    paged = whole.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    return whole, paged.select("doc_id", "page", F.posexplode("words").alias("pos", "w")).select("doc_id", "page", "pos", "w.*"), paged.select("doc_id", "page", "text")


def same(one, other):
    told = lambda df: sorted(map(str, df.select(*one.columns).collect()))
    assert told(one) == told(other) and one.count()


def test_lines_bands_and_clusters(both):
    whole, words, _ = both
    same(pages.whole_lines(whole), pages.lines_of(words))
    same(pages.whole_bands(whole), pages.bands_of(words))
    same(clusters.whole_clusters(whole), clusters.cluster_rows(words))


def test_features_and_fields(both):
    whole, words, paged = both
    same(extract.whole_features(whole, 2040), extract.page_features(words, paged, 2040))
    for year, preferred in ((2040, "current"), (1990, "previous")):
        told = extract.whole_fields(whole, list(FIELDS.values()), year, preferred)
        same(told, extract.read_fields(extract.page_words(words, paged, year), whole, paged, list(FIELDS.values()), preferred))
        assert told.where("result.value is not null").count() > 20 and told.where("size(result.errors) > 0").count() > 20


@pytest.mark.parametrize("name", "extract_revenue extract_assets extract_capital_loss multiline_anchor aop_fallback fallback_column year_columns carry_forward lines_from_words numeric_clusters column_bands".split())
def test_orders_alone_are_dealt(spark, name):
    """One exchange, of orders; no sort, and no aggregate that holds words."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and not re.search(r"\bSort\b|Aggregate|Join|Window", plan)
    assert re.search(r"FileScan", plan[plan.index("Exchange") :]) and not re.search(r"Generate|MapInArrow", plan[plan.index("Exchange") :])
