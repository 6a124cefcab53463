"""Importance resampling towards a target's n-gram distribution, with word-id suffix arrays.

Features are all runs of 1 to ORDER consecutive words, each hashed to one of BUCKETS buckets; a bucket's gain is the log ratio
of its frequency in the target and in the documents, and a document's weight is the mean gain of its features.

1. A task takes lots of texts, gives their words ids, and sorts the places of all words by the words that follow them: a
   suffix array of word ids, refined by prefix doubling until it tells ORDER words apart. Neighbours whose common prefix
   has k words or more form runs; a run is one distinct k-gram of the lot, however often it occurs. Runs of k words lie
   inside runs of k - 1, so a run is hashed once, by going on from the hash of the run around it.
2. Counting: a run adds its length to its bucket. Tasks hand on at most BUCKETS sums for each lot.
3. Scoring: the gain of a run's bucket is scattered back to the places of its suffixes, and summed up by document.
4. Drawing: weights get Gumbel noise by a hash of doc_id, so that the highest sums are a sample without replacement by
   weight. The scores, whole numbers of a range of fewer than 200,000 values, are counted to find the last one that can be drawn;
   what is not below it is sorted by ranges and numbered by the ranges' prefix counts, so that no task holds all.

Texts longer than a lot are taken in stretches of STRETCH words. Defined results: null texts have no words; a null doc_id is the empty
text in the hash, and comes first among ties; repeated rows count and are drawn one by one; with no target all
gains tell the documents' own frequencies; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .shingles import LOWER, bytes_of, hash_spans, portions

BUCKETS, ORDER = 10_000, 2
#: Bytes of text of a lot, and words that are sorted together.
LOT, STRETCH = 8_000_000, 1_500_000
#: Bytes of words: digits, letters, and everything beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    IN_WORD[ord(_first) : ord(_last) + 1] = True
IN_WORD[128:] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in small letters; first byte, byte after the last, and text of each word."""
    data, bounds = bytes_of(column)
    inside = IN_WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    cut = cut[inside[cut - 1] & inside[cut]]
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return LOWER[data], starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the `depth` ids from each on; `left` is the number of ids up to the end of a place's text, shorter suffixes first."""
    rank, known = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while known < depth:
        ahead = np.zeros(len(ids), dtype=np.int64)
        goes_on = np.flatnonzero(left > known)
        ahead[goes_on] = rank[goes_on + known] + 1
        rank = rank * (len(ids) + 1) + ahead
        known *= 2
        if known < depth:
            rank = np.unique(rank, return_inverse=True)[1]
    return np.argsort(rank)


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, how many words, up to `depth`, it has in common with the one before it."""
    lcp = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[alive - 1], order[alive]
        alive = alive[(left[a] > k) & (left[b] > k)]
        a, b = order[alive - 1] + k, order[alive] + k
        alive = alive[ids[a] == ids[b]]
        lcp[alive] += 1
    return lcp


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words k: the buckets of the runs, their lengths, and the places (below `own`) of their suffixes, run by run.

    Words from `own` on only end n-grams that begin before them."""
    ids = hash_spans(data, starts, ends)
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    left = last[np.searchsorted(last, np.arange(len(text)))] - np.arange(len(text)) + 1
    order = suffix_array(ids, left, ORDER)
    lcp = common_prefixes(ids, left, order, ORDER)
    held = data.tobytes()
    before = np.zeros(len(order), dtype=np.int64)  # the hash of the k - 1 words from each suffix on
    for k in range(1, ORDER + 1):
        long = left[order] >= k
        first = np.flatnonzero(long & (lcp < k))
        at = order[first] + k - 1
        glue = b" " if k > 1 else b""
        words = [glue + held[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        hashes = np.fromiter(map(zlib.crc32, words, before[first].tolist()), np.int64, len(words))
        length = np.add.reduceat(long.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
        before[np.flatnonzero(long)] = np.repeat(hashes, length)
        places = order[long]
        mine = places < own
        size = np.add.reduceat(mine.astype(np.int64), np.cumsum(length) - length) if len(first) else length
        yield hashes % BUCKETS, size, places[mine]


def stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, int, Iterator]]:
    """(text of each word, number of words of its own, runs) of stretches of a column of texts; each reaches ORDER - 1 words into the next."""
    data, starts, ends, text = words_of(column)
    for a in range(0, len(starts), STRETCH):
        b = min(a + STRETCH, len(starts))
        c = min(b + ORDER - 1, len(starts))
        lo, hi = starts[a], ends[c - 1]
        yield text[a:b], b - a, runs(data[lo:hi], starts[a:c] - lo, ends[a:c] - lo, text[a:c], b - a)


def profile(texts: DataFrame) -> tuple[int, np.ndarray]:
    """All features of the texts, and how many fall into each bucket: BUCKETS numbers, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in portions(batch, 0, LOT):
                for _, _, found in stretches(part.column(0)):
                    for bucket, size, _ in found:
                        np.add.at(total, bucket, size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return int(out.sum()), out


def gains(source: tuple[int, np.ndarray], target: tuple[int, np.ndarray]) -> np.ndarray:
    """1000 times the log of how much more frequent each bucket is in the target than in the source, rounded down."""
    (s_all, s), (t_all, t) = source, target
    ratio = lambda a, b: (float(b) + 1) * float(s_all + BUCKETS) / ((float(a) + 1) * float(t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise by a hash of doc_id, times 1000, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """_row, doc_id, n_words, n_features, weight and score of every row; `docs` may bring its own numbers of rows as `_row`."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2, LOT):
                n, words, total = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
                for text, own, found in stretches(part.column(2)):
                    words += np.bincount(text, minlength=part.num_rows)
                    each, many = np.zeros(own, dtype=np.int64), np.zeros(own, dtype=np.int64)
                    for bucket, size, places in found:
                        each[places] += np.repeat(gain[bucket], size)
                        many[places] += 1
                    np.add.at(total, text, each)
                    np.add.at(n, text, many)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                score = weight + np.fromiter((noise(i, seed) for i in part.column(1).to_pylist()), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, (words, n, weight, score))], ["_row", "doc_id", "n_words", "n_features", "weight", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id().alias("_row")
    return docs.select(row, "doc_id", "text").mapInArrow(scored, f"_row long, doc_id {key}, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in the given order (which must tell all rows apart), by ranges of it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(offsets), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank; of the documents with least_words words, `percent` % are drawn."""
    return ranked(docs.select("doc_id", "text"), target, percent, least_words, seed).drop("_row")


def ranked(docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """The same with _row, the number of each row."""
    rows = stored(weigh(docs, gains(profile(docs), profile(target)), seed), "scores")
    able = F.col("n_words") >= least_words
    counts = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    so_far = np.cumsum(counts.column("n").to_numpy())
    wanted = percent * int(so_far[-1]) // 100 if len(so_far) else 0
    out = ["_row", "doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*out, none)
    cut = counts.column("score")[int(np.searchsorted(so_far, wanted))].as_py()
    over = able & (F.col("score") >= cut)
    first = numbered(rows.where(over).select(*out), [F.col("score").desc(), F.col("doc_id"), F.col("_row")], "rank")
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    return first.select(*out, rank).unionByName(rows.where(~over).select(*out, none))


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """The drawn documents, all columns."""
    given = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("given")), "given")
    found = ranked(given.select("_row", "given.doc_id", "given.text"), target, percent, least_words, seed).where("rank is not null")
    return given.join(found.select("_row"), "_row", "left_semi").select("given.*")
