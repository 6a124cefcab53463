"""Repeated and invalid rows of searches and mixes, and the bounds and plain scores of language ID."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from ledgerlift.llm import lang_id, mixing, topk_search

from . import brute

NAN, INF = float("nan"), float("inf")


def test_valid_rows_ask_whatever_repeats_their_id(spark):
    valid = [(50, [0.1, 0.2]), (100, [0.3, -0.1]), (1, [0.5, 0.5]), (2, [-0.5, 0.25])]
    invalid = [(50, [None, 0.2]), (50, [-INF, 0.0]), (50, None), (100, [NAN, -5.0]), (100, [-1e30, 0.0]), (150, [INF, 1.0]), (200, None)]
    got = topk_search.top_k(spark.createDataFrame(valid + invalid, "vec_id long, embedding array<double>").repartition(3), every=50, k=2).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in valid}
    want = set()
    for q in (50, 100):
        best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:2]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("ids", ["null", "one", "pairs"])
def test_mixes_of_repeated_ids_keep_their_target(spark, ids):
    """2000 rows of 10 words in three sources: however ids repeat, each source comes within one document of its target."""
    doc_id = {"null": "CAST(NULL AS LONG)", "one": "7L", "pairs": "id div 2"}[ids]
    docs = spark.range(0, 2000, 1, 3).selectExpr(f"{doc_id} AS doc_id", "concat('w', id % 900, repeat(' x', 9)) AS text", "array('a', 'b', null)[id % 3] AS source", "id AS row", "1 AS taken")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    plan = {r.source: r.target for r in mixing.mix(docs.drop("row"), labels).select("source", "target").distinct().collect()}
    whole = mixing.mixed(docs, labels)
    assert whole.columns == docs.columns
    got = whole.collect()
    for source, target in plan.items():
        assert abs(10 * sum(r.source == source for r in got) - target) <= 10
    assert max(Counter(r.row for r in got).values()) <= 2


def test_the_sample_of_a_language_is_bounded(monkeypatch):
    monkeypatch.setattr(lang_id, "SLOTS", 40)
    rows = [("a", i, b"\0" * 20, b"") for i in range(5)] + [("b", 0, b"\0" * 200, b""), ("b", 1, b"\0" * 2, b"")]
    assert [(r[0], r[1]) for r in lang_id.within(iter(rows), 2)] == [("a", 0), ("a", 1), ("b", 0)]


def test_predictions_against_plain_scores(spark, monkeypatch):
    """Scores of every text by its n-grams one by one: relative frequency times IDF times weight, and a softmax of the sums."""
    train = [(i, w, t) for i, (w, t) in enumerate([("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chien et le chat")] * 20)]
    docs = spark.createDataFrame(train, "doc_id long, lang string, text string")
    model = lang_id.fit(docs)
    texts = ["the", "und die", "le chat et", "", None, "123", "é", "katze dog " * 50]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        codes = lang_id.codes_of(text)
        slots = [int(lang_id.ngram_slots(codes[a : a + n])[n - 1][0]) for n in range(1, lang_id.ORDERS + 1) for a in range(len(codes) - n + 1)]
        sums = sum((model.table[s].astype(float) for s in slots), np.zeros(len(model.languages)))
        p = lang_id.softmax(lang_id.SCALE * sums / len(slots) + model.bias)
        assert got[i] == (model.languages[int(p.argmax())], pytest.approx(p.max()))
    monkeypatch.setattr(lang_id, "CELLS", 30)
    for text in texts[:3]:
        assert model.best(text)[1] == pytest.approx(got[texts.index(text)][1])
    assert brute.words("A b") == ["a", "b"]
