"""Exact dedup with a heavy-hitter split, in DataFrame functions alone.

1. Every text is normalised (ASCII white space deleted) and hashed once into a narrow stored table.
2. A frequent-items sketch (Misra-Gries counters, mergeable, fixed size) finds the digests that may be frequent.
3. Their exact sizes and winners are computed by a map-side combined aggregate (at most HOT rows) and broadcast:
   rows of frequent digests are decided where they are, without a shuffle.
4. The rows that are left hold no large group, and go through an ordinary shuffle by digest: groups of several rows are
   summed up map-side, stored, and joined back.

Defined results: a null text is the empty text; a null doc_id loses against any other; of repeated rows one stays;
an empty table gives no rows; other columns of the table are ignored by `decide` and kept by `drop_duplicates`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, text_of

#: Most digests that the sketch reports, of four times as many counters: a digest with over 1/HOT of the rows is never missed.
HOT = 1024


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text_of(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points of the text), digest and a row number that tells repeated rows apart; stored."""
    text = F.col("text")
    return stored(
        docs.select(
            "doc_id",
            F.length(text_of(text)).alias("n"),
            F.sha2(normalised(text).cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "fingerprints",
    )


def frequent(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """The digests that may hold over 1/hot of the rows: at most `hot` rows."""
    sketch = prints.agg(F.expr(f"approx_top_k(digest, {hot}, {4 * hot})").alias("top"), F.count("*").alias("rows"))
    found = sketch.select("rows", F.explode("top").alias("top"))
    return found.where((F.col("top.count") > 1) & (F.col("top.count") * hot >= F.col("rows"))).select(F.col("top.item").alias("digest"))


def decide(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; and n, the code points of its text."""
    prints = fingerprints(docs)
    best = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    winners = (
        prints.join(F.broadcast(frequent(prints, hot)), "digest")
        .groupBy("digest")
        .agg(F.min(best).alias("best"), F.count("*").alias("size"))
    )
    split = prints.join(F.broadcast(stored(winners, "winners")), "digest", "left")
    rest = split.where(F.col("size").isNull()).drop("best", "size")
    groups = stored(rest.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("size")).where("size > 1"), "groups")
    rest = rest.join(groups, "digest", "left").withColumns({"best": F.coalesce("best", best), "size": F.coalesce("size", F.lit(1))})
    return (
        split.where(F.col("size").isNotNull())
        .unionByName(rest)
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "n",
        )
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Of rows with the winner's doc_id and text one stays."""
    kept = decide(docs.select("doc_id", "text")).where("kept").select("doc_id", "n", "text_sha256")
    # The winner is the longest of its group, then of smallest doc_id: repeated rows of it are equal in text up to white space.
    text = F.col("given.text")
    keyed = docs.select(F.struct("*").alias("given")).withColumns({"digest": F.sha2(normalised(text).cast("binary"), 256), "size": F.length(text_of(text))})
    same = (keyed["digest"] == kept["text_sha256"]) & (keyed["size"] == kept["n"])
    found = keyed.join(kept, same & F.col("given.doc_id").eqNullSafe(kept["doc_id"]), "left_semi")
    copies = stored(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if copies.isEmpty():
        return found.select("given.*")
    repeated = F.col("given.doc_id").eqNullSafe(copies["doc_id"])
    once = found.join(copies, repeated, "left_anti")
    again = found.join(copies, repeated, "left_semi").withColumn("id", F.col("given.doc_id")).dropDuplicates(["id", "digest"]).drop("id")
    return once.unionByName(again).select("given.*")
