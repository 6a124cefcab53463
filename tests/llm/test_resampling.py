"""Importance resampling against a plain version: features, gains, scores and ranks, on nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from ledgerlift.llm import queries, resampling

from . import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text: str | None) -> tuple[list[str], int]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words + [" ".join(p) for p in zip(words, words[1:])], len(words)


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % 10_000


def plain(docs: list[tuple], target: list[str | None], percent: int = 25, least: int = 20) -> list[tuple]:
    s = Counter(bucket(g) for _, text in docs for g in grams(text)[0])
    t = Counter(bucket(g) for text in target for g in grams(text)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text in docs:
        own, words = grams(text)
        weight = sum(gain(bucket(g)) for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))[: percent * sum(r[4] for r in rows) // 100]
    ranks: dict[tuple, list[int]] = {}
    for n, r in enumerate(drawn, 1):
        ranks.setdefault(r[:4], []).append(n)
    return [(*r[:4], ranks[r[:4]].pop() if r[4] and ranks.get(r[:4]) else None) for r in rows]


def test_against_a_plain_version(spark, monkeypatch):
    given = brute.rows([*brute.TEXTS, "tie " * 30, "a-b_c ÄÖ ß é1 2x" * 9, *[f"topic {i} words of the target " * 8 for i in range(40)]])
    given.append((None, "no id but words " * 10, *given[0][2:]))
    docs = spark.createDataFrame(given, brute.SCHEMA).repartition(3)
    target = ["words of the target", None, "", "topic 3 words"]
    want = Counter(plain([(r[0], r[1]) for r in given], target))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, bench)
    assert Counter(map(tuple, got.collect())) == want
    drawn = resampling.draw(docs, bench)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(i for i, *_, rank in want.elements() if rank)
    none = docs.where("false")
    assert resampling.resample(none, bench).count() == 0 and resampling.draw(none, bench).count() == 0
    every = resampling.resample(docs, bench.where("false"), percent=100, least_words=0).collect()
    assert sorted(r.rank for r in every) == list(range(1, len(given) + 1))


def test_texts_longer_than_a_stretch_count_like_whole_ones(monkeypatch):
    texts = [" ".join(f"w{i % 37}" for i in range(500)), None, "one", "two words", " ".join(f"w{i % 11}" for i in range(90))]

    def counts() -> Counter:
        out: Counter = Counter()
        for _, _, found in resampling.stretches(pa.array(texts)):
            for buckets, size, places in found:
                assert size.sum() == len(places)
                out.update(dict(zip(buckets.tolist(), [0] * len(buckets), strict=True)))
                for b, n in zip(buckets.tolist(), size.tolist(), strict=True):
                    out[b] += n
        return +out

    want = Counter(bucket(g) for t in texts for g in grams(t)[0])
    assert counts() == want
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(resampling, "STRETCH", size)
        assert counts() == want
    monkeypatch.setattr(resampling, "ORDER", 4)
    longer = Counter(bucket(" ".join(w)) for t in texts for k in range(1, 5) for w in zip(*(grams(t)[0][: grams(t)[1]][j:] for j in range(k))))
    assert counts() == longer


def test_suffix_array_sorts_whole_suffixes():
    rng = np.random.default_rng(1)
    ids, text = rng.integers(0, 3, 200), np.sort(rng.integers(0, 9, 200))
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), 199)
    left = last[np.searchsorted(last, np.arange(200))] - np.arange(200) + 1
    order = resampling.suffix_array(ids, left, 64)
    suffix = [ids[i : i + left[i]].tolist() for i in order]
    assert suffix == sorted(suffix) and sorted(order) == list(range(200))
    lcp = resampling.common_prefixes(ids, left, order, 64)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(suffix, suffix[1:])]


def test_hot_scores_are_ranked_by_ranges(spark):
    """A third of the rows are one row: equal scores, ranks without gaps."""
    docs = spark.range(0, 3000, 1, 6).selectExpr("if(id % 3 = 0, -1, id) AS doc_id", "if(id % 3 = 0, repeat('same ', 30), concat(repeat('t ', 30), id)) AS text")
    got = resampling.resample(docs, docs.limit(3), percent=60).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1801))
    ordered = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in ordered] == sorted((-r.score, r.doc_id) for r in ordered)


def test_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = Counter(duckdb.sql(queries.SQL["op11_resampling"]).fetchall())
    assert Counter(map(tuple, queries.op11_resampling(spark, SF).collect())) == want
