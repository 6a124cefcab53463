"""The Merkle manifest against a plain version, its forests' sum, and proofs of tampered rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from ledgerlift.llm import lang_id, merkle, queries

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, row int, part int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree: list[list[str]], i: int) -> list[tuple[list[str], int]]:
    return [(level[(j := i >> 3 * n) // 8 * 8 : j // 8 * 8 + 8], j % 8) for n, level in enumerate(tree[:-1])]


def plain(rows: list[tuple]) -> Counter:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    top = levels([built[k][-1][0] for k in names])
    out: Counter = Counter()
    for n, k in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            steps = way(built[k], i) + way(top, n)
            bad = zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 0 and r[4] is not None
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])) if bad else digest
            for run, at in steps:
                now = h(*run[:at], now, *run[at + 1 :])
            proof = h(*(d for run, at in steps for j, d in enumerate(run) if j != at))
            out[r[0], digest, built[k][-1][0], top[-1][0], proof, now, now == top[-1][0]] += 1
    return out


def manifest(docs):
    return Counter(map(tuple, merkle.manifest(docs, tampered=lang_id.remainder(3) == 0).collect()))


def test_against_a_plain_version(spark, monkeypatch):
    dice = random.Random(2)
    texts = [*brute.TEXTS, "Case MATTERS", "no capitals", "é Ünïcode É"]
    rows = [(i, dice.choice(["web", None, ""]), dice.choice(["en"] * 9 + ["de", None, "", "ßx"]), dice.choice([None, 5]), dice.choice(texts)) for i in range(700)]
    rows += [rows[3], (None, None, None, None, None), (None, "a", None, 1, "ID-LESS"), (11, "other", "en", 2, "Repeated ID"), (-4, "neg", "lone", 1, "Lone Leaf")]
    given = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS).repartition(5)
    want = plain(rows)
    assert manifest(given) == want
    # Blocks of 8 leaves and forests of a few leaves: every step over block and task borders is taken.
    monkeypatch.setattr(merkle, "BLOCK", 1)
    monkeypatch.setattr(merkle, "FAN", 2)
    assert manifest(given.repartition(9)) == want


def test_small_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none).count() == 0
    one = (7, "s", "en", 3, "Abc")
    got = merkle.manifest(spark.createDataFrame([(*one, "x", "y", 1, 2)], DOCS)).collect()[0]
    assert got.root == got.subroot == got.leaf == leaf(one, "Abc") and got.proof_sha256 == h() and got.verified
    nine = [(i, "s", "en", 3, "t") for i in range(9)]
    assert manifest(spark.createDataFrame([(*r, "x", "y", 1, 2) for r in nine], DOCS)) == plain(nine)


def test_the_sum_of_forests_is_associative():
    dice = random.Random(7)
    leaves = [(tree, 0, i, h(tree, str(i)), n) for tree, n in (("a", 1), ("b", 8), ("c", 77), ("d", 520)) for i in range(n)]
    want = {}
    for tree, n in (("a", 1), ("b", 8), ("c", 77), ("d", 520)):
        want[tree] = levels([h(tree, str(i)) for i in range(n)])[-1][0]
    for _ in range(20):
        dice.shuffle(leaves)
        cut = sorted(dice.sample(range(len(leaves)), 6))
        parts = [leaves[a:b] for a, b in zip([0, *cut], [*cut, len(leaves)])]
        forests = []
        for part in parts:
            forest = merkle.Forest(99)
            forest.add(part)
            forests.append(forest.open() + forest.resolved())
        while len(forests) > 1:
            i = dice.randrange(len(forests) - 1)
            forest = merkle.Forest(99)
            rows = forests.pop(i) + forests.pop(i)
            forest.add(r[:5] for r in rows if not r[5])
            forests.insert(i, forest.open() + forest.resolved() + [r for r in rows if r[5]])
        assert {r[0]: r[3] for r in forests[0]} == want and all(r[5] for r in forests[0])


def test_tampering_shows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    honest = merkle.manifest(docs)
    assert honest.where("not verified").count() == 0
    changed = merkle.manifest(docs.withColumn("n_chars", F.when(F.col("doc_id") == 17, -1).otherwise(F.col("n_chars"))))
    assert {r.root for r in honest.select("root").distinct().collect()}.isdisjoint({r.root for r in changed.select("root").distinct().collect()})


def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(duckdb.sql(queries.SQL["op12_merkle"]).fetchall())
    assert Counter(map(tuple, queries.op12_merkle(spark, SF).collect())) == want
