"""Mixing sources to target weights, in DataFrame functions alone.

Each source gets a target of words: its weight's share of the budget, capped at `most` times its size, the excess
shared again by weight among the others (water-filling, in closed form over the sorted caps). A source takes all
its documents floor(target / size) times; what is then missing is filled by Efraimidis-Spirakis sampling without
replacement: a document of quality weight w has the key u ** (1 / w), u uniform by a hash of doc_id and text, and the
largest keys are taken until their words reach the rest of the target.

The order is never sorted as a whole. Keys fall into ranges by -log(key), which is exponential with the rate of the
quality weight: no range holds a larger part than weight / BUCKETS of the documents of a weight. The words of each
(source, range) are summed map-side, prefix sums find the range in which a source reaches its target, ranges before it
are taken whole, and only the rows of that one range (at most 1 / 2048 of a source) are sorted.

Defined results: a null text has no words and takes none; null is a source of its own, ranked last; a null or
unlabelled doc_id has quality weight 1; repeated rows count as documents of their own, with equal keys if their texts
are equal too (then they are not split over ranges); if no source has words, all targets are 0; an empty table gives no
rows. Only doc_id, text and source are read. Sources are few: their targets are worked out over all of them in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, text_of, unit, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Ranges for each unit of -log(key).
BUCKETS = 4096
SEED = 20
#: Quality weight of documents labelled good, bad, and not at all.
GOOD, BAD, PLAIN = 2.0, 0.5, 1.0


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> and target. One row per source in and out; source_size is a long, null is a source."""
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(ranked) - 1) % len(weights))
    cap = F.col("source_size") * most
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # Along the order of cap / weight, sources up to the first whose cap is above the level are capped; that level holds for all later ones.
    water = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(everything)["level"]
    return (
        sizes.withColumns({"weight": weight, "cap": cap})
        .withColumns({"level": level, "place": F.row_number().over(fill)})
        .withColumn("water", water)
        .select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double")).alias("target"))
    )


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every document, and its `row` if it has one; stored, as it is read several times."""
    quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") > 0, GOOD).when(F.col("_quality") <= 0, BAD).otherwise(PLAIN)
    key = F.pow(F.col("u"), 1.0 / weight)
    row = ["row"] if "row" in docs.columns else []
    narrow = docs.select(*row, "doc_id", "source", word_count(text_of("text")).alias("size"), unit(F.col("doc_id"), F.col("text"), seed=SEED).alias("u"))
    return stored(narrow.join(quality, "doc_id", "left").select(*row, "doc_id", "source", "size", key.alias("key")), "mix")


def range_of(key: Column) -> Column:
    return F.floor(-F.log(key) * BUCKETS).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, split: bool = True) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; and source, epochs (whole rounds of its source).

    With `split`, the document at which a source reaches its target gives only the words still missing; without, it is
    taken whole if that brings the source nearer to its target, and else not."""
    row = ["row"] if "row" in docs.columns else []
    docs = features(docs, labels)
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights, share, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-plan")
    hint = small(plan)
    # The key range in which each source reaches the rest of its target.
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = docs.groupBy("source", range_of(F.col("key")).alias("range")).agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("words").over(along), F.lit(0)))
    edge = ranges.join(hint.select(F.col("source").alias("_source"), "rest"), F.col("source").eqNullSafe(F.col("_source")))
    edge = edge.where("start <= rest and start + words > rest").select("_source", F.col("range").alias("edge"), "start")
    full = plan.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    full = small(stored(full.withColumnRenamed("source", "_source"), "mix-edges"))
    known = docs.join(full, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("range", range_of(F.col("key")))
    # Without an edge the rest takes the whole source, or nothing.
    edge_at = F.coalesce(F.col("edge"), F.when((F.col("rest") > 0), F.lit((1 << 31) - 1)).otherwise(F.lit(-1)))
    clear = known.where(F.col("range") != edge_at).withColumn("extra", F.when(F.col("range") < edge_at, F.col("size")).otherwise(F.lit(0)))
    sorted_ = Window.partitionBy("source").orderBy(F.col("key").desc(), "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(sorted_), F.lit(0))
    last = F.least(F.col("size"), F.greatest(left, F.lit(0)))
    if not split:
        last = F.when((left > 0) & (left * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    at_edge = known.where(F.col("range") == edge_at).withColumn("extra", last)
    return clear.unionByName(at_edge).select(
        *row, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "source", "epochs"
    )


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as many times as the mix takes it whole, with the columns of docs.

    A document without words changes no budget; it stays once."""
    given = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("given")), "mix-docs")
    plan = mix(given.select("row", "given.doc_id", "given.text", "given.source"), labels, split=False, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    plan = plan.select("row", times.alias("times")).where("times > 0")
    return given.join(plan, "row").select("given", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("given.*")
