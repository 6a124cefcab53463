"""Near-duplicates and line links at their edges: no candidates, batches of one row, repeated ids, colliding words, common templates."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlift.llm import line_dedup, lm_scoring, minhash
from ledgerlift.llm.shingles import SHORT, portions, shingle_sets, word_hashes

from . import brute

DOCS = "doc_id long, text string"


def by_rows(given: list[tuple], percent: int) -> Counter:
    """(doc_id, component) of every row, rows being documents of their own; a component's id is its smallest doc_id."""
    sets = [brute.shingles(t) for _, t in given]
    root = list(range(len(given)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if brute.alike(sets[i], sets[j], percent):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(given):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((given[i][0], least.get(find(i))) for i in range(len(given)))


def unrelated(n: int, words: int = 40) -> list[tuple]:
    return [(i, " ".join(f"w{i}x{k}" for k in range(words))) for i in range(n)]


def test_portions_of_an_empty_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])
    assert list(portions(batch, 0)) == []


@pytest.mark.parametrize(
    "given",
    [
        unrelated(3),
        [*unrelated(40), (40, unrelated(1)[0][1])],
        [*unrelated(3), (3, unrelated(1)[0][1] + " tail")],
        [(1, None), (2, ""), (3, " \t")],
        [(5, " ".join(f"a{i}" for i in range(200))), (5, " ".join(f"b{i}" for i in range(60))), (9, " ".join(f"b{i}" for i in range(61)))],
        [(None, "n " * 7), (None, " ".join(f"b{i}" for i in range(60))), (9, " ".join(f"b{i}" for i in range(61)))],
    ],
    ids=["unrelated", "one equal pair", "one near pair", "no words", "repeated id", "null ids"],
)
def test_tables_without_candidates_and_with_repeats(spark, given):
    docs = spark.createDataFrame(given, DOCS).repartition(3)
    got = minhash.link(docs, 80).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == by_rows(given, 80)
    kept = Counter(i for i, c in by_rows(given, 80).elements() if c is None or i == c)
    assert Counter(r.doc_id for r in minhash.keep_first(docs, 80).collect()) == kept


def test_batches_of_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        given = [*unrelated(30), (30, unrelated(1)[0][1] + " tail"), (31, None)]
        got = minhash.link(spark.createDataFrame(given, DOCS), 80).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == by_rows(given, 80)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("percent", [80, 85])
def test_random_families(spark, percent):
    """Families of edited texts of many lengths, some ids repeated, against all pairs."""
    dice = random.Random(percent)
    given = []
    for family in range(25):
        base = [f"f{family}w{dice.randrange(400)}" for _ in range(dice.choice([5, 12, 40, 120]))]
        for _ in range(dice.randrange(1, 9)):
            own = list(base)
            for _ in range(dice.randrange(0, 4)):
                own[dice.randrange(len(own))] = f"new{dice.randrange(50)}"
            own = own[: max(1, len(own) - dice.randrange(0, 6))] + ["common tail of all"] * dice.randrange(0, 2)
            given.append((dice.randrange(120), " ".join(own)))
    got = minhash.link(spark.createDataFrame(given, DOCS).repartition(3), percent).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == by_rows(given, percent)


def doubled(steps: int) -> tuple[str, str]:
    """Two words of 2 ** steps letters with the same polynomial modulo 2 ** 64, whatever its base, from 2048 letters on."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_take_for_equal(spark):
    a, b = doubled(11)
    h, n = word_hashes(pa.array([a, b, a.upper(), "x" * SHORT, "x" * (SHORT + 1)]))
    assert h[0] != h[1] and h[0] == h[2] and len(set(h.tolist())) == 4 and n.tolist() == [1] * 5
    given = [(1, a), (2, b), (3, a + " " + b)]
    docs = spark.createDataFrame(given, DOCS)
    assert {r.component_id for r in minhash.link(docs, 85).collect()} == {1, 2, 3}
    assert {r.doc_id: r.removed for r in line_dedup.decide(docs).collect()} == {1: [], 2: [], 3: []}
    scored = {r.doc_id: r.n_known for r in lm_scoring.score(docs, docs.where("doc_id = 1")).collect()}
    assert scored == {1: 2, 2: 1, 3: 2}


def test_pieces_of_texts_hash_like_whole_ones():
    text = " ".join(f"word{i}" for i in range(60_000))
    h, _ = word_hashes(pa.array([text]))
    alone, _ = word_hashes(pa.array([f"word{i}" for i in range(60_000)]))
    assert (h == alone).all() and len(np.unique(h)) == 60_000
    assert len(shingle_sets(pa.array([text]))[0]) == 60_000 - 4


def plain_removed(given: list[tuple]) -> dict[int, list[int]]:
    seen: list[set] = []
    out = {}
    for i, text in given:
        out[i] = []
        for place, line in enumerate(text.split("\n")):
            own = brute.shingles(line)
            if any(brute.alike(own, s, 80) for s in seen):
                out[i].append(place)
            if own:
                seen.append(own)
    return out


def test_random_lines(spark):
    """Lines cut from few long ones, so that prefixes meet at many lengths, against all pairs."""
    dice = random.Random(5)
    bases = [[f"b{k}w{i}" for i in range(dice.choice([14, 30, 60, 90]))] for k in range(12)]
    given = []
    for doc in range(60):
        lines = []
        for _ in range(4):
            own = list(dice.choice(bases))
            cut = dice.randrange(0, 8)
            own = own[cut // 2 : len(own) - cut]
            if dice.random() < 0.3:
                own[dice.randrange(len(own))] = f"x{dice.randrange(9)}"
            lines.append(" ".join(own))
        given.append((doc, "\n".join(lines)))
    got = line_dedup.decide(spark.createDataFrame(given, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.removed for r in got} == plain_removed(given)


def test_parts_of_tokens_that_no_two_lines_share(spark, monkeypatch):
    """Tokens dealt to very many parts, most of them without a hit."""
    monkeypatch.setattr(line_dedup, "COMPARED", 8)
    given = [(i, "\n".join([f"a{i} b{i} c{i} d{i} e{i} f{i}", "one line that two of the documents have in common"])) for i in range(60)]
    got = line_dedup.decide(spark.createDataFrame(given, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.removed for r in got} == plain_removed(given)
    alone = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(60)]
    assert line_dedup.decide(spark.createDataFrame(alone, DOCS)).where("size(removed) > 0").count() == 0


def test_log_like_lines_take_time_in_proportion(spark):
    """Lines of 14 words that differ in the first two are linked with nothing, and are not compared pair by pair."""

    def seconds(n: int) -> float:
        docs = spark.range(0, n, 1, 4).selectExpr("id AS doc_id", "concat('t', id, ' u', id, ' a b c d e f g h i j k l') AS text")
        began = time.time()
        assert line_dedup.decide(docs).where("size(removed) > 0").count() == 0
        return time.time() - began

    seconds(1000)
    few, many = seconds(5000), seconds(40_000)
    assert many < 5 * max(few, 2)


def test_template_documents_take_time_in_proportion(spark):
    """Documents that share 74 % of their words are linked with nothing, and are not compared pair by pair."""

    def seconds(n: int) -> float:
        own = "concat_ws(' ', transform(sequence(1, 20), k -> concat('o', id, 'x', k)))"
        docs = spark.range(0, n, 1, 4).selectExpr("id AS doc_id", f"concat({own}, ' ', concat_ws(' ', transform(sequence(1, 100), k -> concat('c', k)))) AS text")
        began = time.time()
        assert minhash.link(docs, 80).where("not kept").count() == 0
        return time.time() - began

    seconds(1000)
    few, many = seconds(2000), seconds(16_000)
    assert many < 5 * max(few, 2)
