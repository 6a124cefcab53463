"""Numeric clusters: runs of number-like words, and the choice among them next to an anchor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numeric_like, strip
from .anchors import Anchor, Page
from .columns import YearColumn, bounds, center
from .flat import as_batch, whole
from .flat import cluster_rows as islands
from .pages import arrow, rows_of

MARGIN = 8
CODE_MARGIN = 3


class Cluster(NamedTuple):
    text: str
    left: int
    right: int
    words: list[int]


def formula_like(text: str) -> bool:
    return "+" in text or "=" in text or "АОП" in text.upper()


def clusters_of(page: Page, words: list[int]) -> list[Cluster]:
    """Clusters of words (ties keep their order): a number-like word starts a new one after another kind of word, a wide gap, or in another row."""
    held, numeric, clean = page.lot.held, page.lot.numeric, page.lot.clean
    left, right, top, height = (held[c] for c in ("left", "right", "top", "height"))
    groups: list[list[int]] = []
    before = None
    for w in page.by_place(words):
        if not numeric[w]:
            before = None
            continue
        if before is not None:
            high = max(height[before], height[w])
            gap = max(15, int(max(high, 1) * 1.5))
        if before is None or left[w] - right[before] > gap or abs(top[w] - top[before]) > high:
            groups.append([])
        groups[-1].append(w)
        before = w
    return [Cluster(" ".join([clean[w] for w in g]), min([left[w] for w in g]), max([right[w] for w in g]), g) for g in groups]


def locate(page: Page, anchor: Anchor, chosen: YearColumn | None, other: YearColumn | None, codes: YearColumn | None) -> tuple[list[str], list[str]]:
    """Texts of the numbers next to an anchor: candidates in order of preference, and all clusters."""
    kept, found = located(page, anchor, chosen, other, codes)
    return [c.text for c in kept], [c.text for c in found]


def located(page: Page, anchor: Anchor, chosen: YearColumn | None, other: YearColumn | None, codes: YearColumn | None) -> tuple[list[Cluster], list[Cluster]]:
    """The clusters that locate tells the texts of."""
    held, numeric = page.lot.held, page.lot.numeric
    left, right = held["left"], held["right"]
    anchor_right = max((right[w] for w in anchor.words if not numeric[w]), default=anchor.right)
    threshold = anchor_right - 5
    if anchor.fallback and codes:
        threshold = min(threshold, codes.right + MARGIN)
    ids = held["id"]
    own = {ids[w] for w in anchor.words}
    every = anchor.words + [w for w in page.near(anchor.top, anchor.bottom) if right[w] >= threshold and ids[w] not in own]
    found = []
    if chosen:
        least, most = bounds(chosen, other, anchor_right, anchor.right)
        least, most = least - MARGIN, most + MARGIN
        inside = lambda w: right[w] >= least and left[w] <= most and (least <= (left[w] + right[w]) / 2.0 <= most or left[w] >= least and right[w] <= most)
        found = clusters_of(page, [w for w in every if inside(w)])
    found = found or clusters_of(page, every)
    return candidates(found, anchor, threshold, chosen, codes), found


def candidates(found: list[Cluster], anchor: Anchor, threshold: int, chosen: YearColumn | None, codes: YearColumn | None) -> list[Cluster]:
    """Clusters right of the label and outside of the row codes, if there are any, nearest to the column first."""

    def off_codes(clusters: list[Cluster]) -> list[Cluster]:
        return [c for c in clusters if not codes or center(c) < codes.left - CODE_MARGIN or center(c) > codes.right + CODE_MARGIN]

    kept = [c for c in found if c.right >= threshold] or found
    freed = off_codes(kept) or off_codes(found) or kept

    def key(c: Cluster) -> tuple:
        if chosen:
            return formula_like(c.text), abs(center(c) - center(chosen)), abs(c.left - center(chosen)), c.left
        return formula_like(c.text), c.left < anchor.right, abs(c.left - anchor.right), c.left

    return sorted(freed, key=key)


def breaks(before: Column, word: Column) -> Column:
    """Whether a number-like word starts a new cluster after another: a wide gap, or another row."""
    high = F.greatest(before["height"], word["height"])
    gap = F.greatest(F.lit(15), F.floor(F.greatest(high, F.lit(1)) * 1.5).cast("int"))
    return (word["left"] - before["right"] > gap) | (F.abs(word["top"] - before["top"]) > high)


def cluster_rows(words: DataFrame) -> DataFrame:
    """All numeric clusters of all pages as rows, by windows: doc_id, page, cluster, text, left, right.

    A word's cluster depends on its predecessor alone, so lag and a running sum number the islands exactly."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "left", "pos")
    placed = words.withColumns({"right": F.col("left") + F.col("width"), "numeric": numeric_like(F.col("text"))})
    before = F.lag(F.struct("right", "top", "height", "numeric")).over(order)
    joined = placed.withColumn("before", before)
    new = ~F.coalesce(F.col("before.numeric"), F.lit(False)) | breaks(F.col("before"), F.struct("left", "top", "height"))
    numbered = joined.withColumn("island", F.sum(F.when(F.col("numeric") & new, 1).otherwise(0)).over(order)).where("numeric")
    word = F.struct("top", "left", "pos", strip(F.col("text")).alias("text"))
    grouped = numbered.groupBy("doc_id", "page", "island").agg(F.array_sort(F.collect_list(word)).alias("words"), F.min("left").alias("left"), F.max("right").alias("right"))
    return grouped.select("doc_id", "page", F.col("island").cast("int").alias("cluster"), F.array_join("words.text", " ").alias("text"), "left", "right")


CLUSTERS = "doc_id string, page int, cluster int, text string, left int, right int"


def whole_clusters(documents: DataFrame) -> DataFrame:
    """What cluster_rows tells, of documents that come whole."""
    schema = arrow(CLUSTERS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot, _ in whole(batches, every=True):
            yield as_batch(lot, islands(lot), schema)

    return rows_of(documents).mapInArrow(read, CLUSTERS)
