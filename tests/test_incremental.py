"""The run as a stream against the batch run: split documents, late pages, killed and repeated batches; and keyed tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerlift.plans.pipeline import run
from ledgerlift.sources.config import Config
from ledgerlift.sources.state import KeyedTable
from ledgerlift.streaming import incremental

from .test_geometry import ASSETS, CAPITAL, NOW, REVENUE, words_of

HEADER = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
#: doc: (texts of pages, lines of pages, amount)
DOCS = {
    "old": (["12345678 биланс успеха 2020"], [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], 111),
    "new": (["12345678 bilans uspeha 2021"], [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], 222),
    "bs": (["12345678 биланс стања 2021", "наставак"], [[(25, NOW), (60, f"{ASSETS} 640:{{a}}")], [(120, f"{CAPITAL} 640:-70")]], 333),
    "moved": (["87654321 биланс успеха 2021", "12345678 2022"], [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")], [(10, "5:нешто")]], 444),
    "unknown": (["11112222 ништа"], [[(10, "5:нешто")]], 1),
}
ROSTER = [(2, "12345678", "12345678", None, None, None), (3, "87654321", "87654321", 5, None, None), (4, "11112222", "11112222", None, None, None), (5, "", "", None, None, None), (6, "99999999", "99999999", None, None, 9)]


def rows() -> dict[tuple[str, int], tuple]:
    out = {}
    for doc, (texts, pages, amount) in DOCS.items():
        words = words_of(doc, pages, amount=amount)
        for page, text in enumerate(texts, 1):
            tsv = HEADER + "".join("\t".join(map(str, (r[3], page, *r[4:13], r[13]))) + "\n" for r in words if r[1] == page)
            out[doc, page] = (doc, page, f"in/{doc}.pdf", None, text, tsv)
    return out


def batch_run(spark, given: list[tuple], config: Config):
    pages = spark.createDataFrame(given, incremental.PAGES)
    words = incremental.tsv.words(incremental.tsv.parse(pages.select("doc_id", "page", "tsv")))
    docs = pages.groupBy("doc_id").agg(F.min("path").alias("path"), F.min("mtime").alias("mtime"))
    roster = spark.createDataFrame(ROSTER, "row_index long, raw_value string, mb string, revenue long, assets long, capital_loss long")
    return roster, run(roster, docs, pages.select("doc_id", "page", "text"), words, config)


def told(outcome) -> tuple:
    rows_ = lambda df: sorted(map(tuple, df.collect()), key=str)
    return rows_(outcome.roster), rows_(outcome.report), rows_(outcome.counters)


def test_a_stream_of_split_documents_and_a_killed_batch(spark, tmp_path, monkeypatch):
    config, every = Config(as_of_year=2021), rows()
    files = [[("old", 1), ("bs", 2)], [("moved", 2), ("unknown", 1)], [("new", 1), ("bs", 1)], [("moved", 1), ("old", 1)]]
    for n, keys in enumerate(files):
        spark.createDataFrame([every[k] for k in keys], incremental.PAGES).coalesce(1).write.parquet(str(tmp_path / f"made-{n}"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        part = next(p for p in os.listdir(tmp_path / f"made-{n}") if p.endswith(".parquet"))
        os.rename(tmp_path / f"made-{n}" / part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    roster, want = batch_run(spark, list(every.values()), config)
    going = incremental.Incremental(roster, str(tmp_path / "state"), config)
    stream = lambda: going.start(incremental.stream_pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "check"))

    # Killed in batch 2, after its pages, classifications and results are written and before its rows are.
    whole, batches = incremental.Incremental.told, []

    def killed(self, companies):
        batches.append(1)
        if len(batches) == 3:
            raise RuntimeError("killed")
        return whole(self, companies)

    monkeypatch.setattr(incremental.Incremental, "told", killed)
    with pytest.raises(Exception, match="killed"):
        stream().awaitTermination()
    stream().awaitTermination()
    assert len(batches) == 5  # one batch twice
    assert told(going.outcome()) == told(want)
    going.compact(2)
    assert told(going.outcome()) == told(want)
    # The last batch once more, by hand: nothing changes.
    again = spark.createDataFrame([every[k] for k in files[3]], incremental.PAGES)
    going.batch(again, 3)
    assert told(going.outcome()) == told(want)


def test_before_any_page(spark, tmp_path):
    roster, want = batch_run(spark, [], Config())
    assert told(incremental.Incremental(roster, str(tmp_path / "state")).outcome()) == told(want)


def files_of(path) -> dict[str, float]:
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "key string, payload string", ["key"], buckets=8)
    rows_ = lambda pairs: spark.createDataFrame(pairs, "key string, payload string")
    assert table.newest().count() == 0 and table.newest(rows_([("a", None)])).count() == 0
    table.put(rows_([(f"k{i}", "first") for i in range(50)]), 0)
    first = files_of(tmp_path / "t")
    table.put(rows_([("k7", "second"), ("new", None)]), 1)
    second = files_of(tmp_path / "t")
    assert first.items() <= second.items() and len(second) - len(first) <= 2
    want = {f"k{i}": "first" for i in range(50)} | {"k7": "second", "new": None}
    assert {r.key: r.payload for r in table.newest().collect()} == want
    assert {r.key: r.payload for r in table.newest(rows_([("k7", ""), ("none", "")])).collect()} == {"k7": "second"}
    assert {r.key: r.payload for r in table.newest(before=1).collect()} == {f"k{i}": "first" for i in range(50)}
    # The same batch again replaces its own files alone.
    table.put(rows_([("k7", "second"), ("new", None)]), 1)
    assert first.items() <= files_of(tmp_path / "t").items() and {r.key: r.payload for r in table.newest().collect()} == want
    # Compaction touches buckets of more than two batches only, and the last batch can be run again after it.
    for n in (2, 3, 4):
        table.put(rows_([("k7", f"batch {n}")]), n)
    before = files_of(tmp_path / "t")
    table.compact(2)
    after, want = files_of(tmp_path / "t"), want | {"k7": "batch 4"}
    assert {r.key: r.payload for r in table.newest().collect()} == want
    assert {r.key: r.payload for r in table.newest(before=4).collect()} == want | {"k7": "batch 3"}
    of_k7 = os.path.dirname(os.path.dirname(next(p for p in before if "_batch=9" in p)))
    assert {p: t for p, t in before.items() if not p.startswith(of_k7)}.items() <= after.items()
    assert {os.path.basename(os.path.dirname(p)) for p in after if p.startswith(of_k7)} == {"_batch=8", "_batch=9"}
    table.put(rows_([("k7", "batch 4")]), 4)
    assert {r.key: r.payload for r in table.newest().collect()} == want
