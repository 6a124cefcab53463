"""Sharding by balanced label propagation: linked documents gather in shards of equal counts.

Links are given as groups (here: equal texts). Each linked document starts in a shard by hash; documents of one group
that start there fall into at most PIECES blocks. In every round an aggregate join tells each block how many of its group's documents each
shard holds, blocks propose to move, proposals are ranked by the neighbours won, and prefix sums accept them up to a
quota. Rounds alternate. In the first kind, blocks wish for the shard with most neighbours among those with room, and
each shard admits what it has room for. In the second, they wish for the shard with most neighbours of all, and each
two shards exchange as many documents as want to go both ways, so that full shards can trade. Ties fall by another
hash each round, so that wishes left over in one direction meet others in the next. Within a group all moves of a round
go to one shard that holds no fewer, so cut links only fall; rounds end when two in a row move almost nothing.
An exchange can differ by less than one block each way; an overfull shard takes in less next time, and the final
numbering holds every shard to its share. Documents without links then fill the shards up, so that counts differ by
one at most; they cut nothing wherever they go. A group too large for a shard is spread over few shards, block by block.

Only totals per shard and per pair of shards reach the driver. Numbers within a shard come from bucketed prefix sums, so no
task ever holds a shard.

Defined results: null texts have size 8 and are one group; repeated rows are documents of their own; a null doc_id
is hashed like any other; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, running_total, stored, text_of

SHARDS = 24
#: Most rounds, and the share of the linked documents below which a round counts as having moved nothing.
ROUNDS = 20
STILL = 0.001
#: Blocks of one group that start in one shard.
PIECES = 16
#: Buckets in which documents are numbered.
BUCKETS = 1024


def features(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group (a digest of the text) and a hash that orders documents; stored."""
    text = text_of("text").cast("binary")
    group = F.md5(F.concat(F.when(F.col("text").isNull(), F.lit("0")).otherwise(F.lit("1")).cast("binary"), text))
    return stored(
        docs.select(
            "doc_id",
            (F.octet_length(text_of("text")) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            group.alias("group"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h"),
        ),
        "shard-docs",
    )


def bucket_of(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def loads(state: DataFrame, shards: int) -> list[int]:
    """Documents of each shard: one row a shard comes to the driver."""
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def longs(values: list[int], at: Column) -> Column:
    """The value at a place of a short list."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def exchanges(wishes: DataFrame, over: list[int]) -> list[int]:
    """By from * shards + to: how many documents may go that way, as many as want to come back less what `to` holds too much."""
    shards = len(over)
    wanted = {(r["shard"], r["to"]): r["n"] for r in wishes.where("moves").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
    return [max(0, min(wanted.get((i, j), 0), wanted.get((j, i), 0)) - over[j]) for i in range(shards) for j in range(shards)]


def propagate(blocks: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """blocks (group, part, n) -> stored (group, part, n, shard): groups gather under the shards' quotas."""
    shards, names = len(quota), ["group", "part", "n", "shard"]
    state = stored(blocks.withColumn("shard", F.col("part") % shards), "shard-state")
    load, still = loads(state, shards), 0
    for turn in range(rounds):
        trade = turn % 2 == 1
        room = [max(0, q - n) for q, n in zip(quota, load, strict=True)]
        toss = F.xxhash64("group", "shard", F.lit(turn))
        near = state.groupBy("group", "shard").agg(F.sum("n").alias("near"), F.max("n").alias("block"))
        # The shard that holds most of a group, of all or among those with room for a block; ties fall apart by a hash.
        open_ = near if trade else near.where(longs(room, F.col("shard")) >= F.col("block"))
        best = open_.groupBy("group").agg(F.max(F.struct("near", toss.alias("toss"), "shard")).alias("best"))
        best = best.select("group", F.col("best.near").alias("most"), F.col("best.toss").alias("tie"), F.col("best.shard").alias("to"))
        here = near.drop("block").withColumnsRenamed({"near": "here", "shard": "at"})
        told = state.join(best, "group", "left").join(here, (state["group"] == here["group"]) & (state["shard"] == here["at"])).drop(here["group"], here["at"])
        gains = (F.col("most") > F.col("here")) | ((F.col("most") == F.col("here")) & (F.col("tie") > toss))
        told = told.withColumn("moves", F.coalesce((F.col("to") != F.col("shard")) & gains, F.lit(False)))
        rank = (F.lit(64) - F.floor(F.log2(F.col("most").cast("double")))).cast("int") * 64 + F.pmod(F.xxhash64("group"), F.lit(64)).cast("int")
        wishes = stored(told.select("group", "part", "n", "shard", "moves", "to", rank.alias("rank")), "shard-wishes")
        if trade:
            most = longs(exchanges(wishes, [max(0, n - q) for q, n in zip(quota, load, strict=True)]), F.col("shard") * shards + F.col("to"))
        else:
            most = longs(room, F.col("to"))
        # Blocks larger than the whole quota stay, so that they block nothing behind them.
        fits = F.col("moves") & (F.col("n") <= most)
        ranked = running_total(wishes.where(fits), ["shard", "to"] if trade else ["to"], "rank", [F.col("group"), F.col("part")], "n", "before")
        went = F.col("before") + F.col("n") <= most
        moved = ranked.withColumns({"went": went, "shard": F.when(went, F.col("to")).otherwise(F.col("shard"))})
        stay = wishes.where(~F.coalesce(fits, F.lit(False))).withColumn("went", F.lit(False))
        after = stored(stay.select(*names, "went").unionByName(moved.select(*names, "went")), "shard-state")
        discard(wishes, state)
        state, load = after, loads(after, shards)
        gone = after.where("went").agg(F.sum("n")).first()[0] or 0
        still = still + 1 if gone <= STILL * sum(load) else 0
        if still == 2:
            break
    return state


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`rows`), shard, slot (from 0 in its shard), grown_shard (null)."""
    docs = features(docs)
    total = docs.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stored(docs.groupBy("group").count().where("count > 1").select("group"), "shard-groups")
    split = docs.join(groups.withColumn("linked", F.lit(True)), "group", "left")
    part = F.pmod(F.col("h"), F.lit(shards * PIECES)).cast("int")
    linked = split.where("linked").withColumn("part", part)
    state = propagate(linked.groupBy("group", "part").agg(F.count("*").alias("n")), quota, rounds)
    placed = linked.join(state.select("group", "part", "shard"), ["group", "part"])
    placed = placed.withColumns({"bucket": bucket_of(F.shiftright("h", 12)), "one": F.lit(1)})
    order = [F.col("h"), F.col("doc_id")]
    most = longs(quota, F.col("shard"))
    placed = stored(running_total(placed, ["shard"], "bucket", order, "one", "slot").withColumn("fits", F.col("slot") < most).drop("linked", "part", "one"), "shard-linked")
    held = [min(n, q) for n, q in zip(loads(state, shards), quota, strict=True)]
    ends = [sum(quota[: s + 1]) - sum(held[: s + 1]) for s in range(shards)]
    # Documents without links, and what a shard could not hold, fill the gaps in one gapless order.
    loose = split.where(F.col("linked").isNull()).withColumn("bucket", bucket_of(F.shiftright("h", 12)))
    names = ["doc_id", "size", "text_crc32", "h", "bucket"]
    loose = loose.select(*names).unionByName(placed.where("not fits").select(*names)).withColumn("one", F.lit(1))
    loose = running_total(loose, [], "bucket", order, "one", "place")
    shard = F.lit(0)
    for end in ends[:-1]:
        shard = shard + F.when(F.col("place") >= end, 1).otherwise(0)
    start = longs([h - (ends[s - 1] if s else 0) for s, h in enumerate(held)], F.col("shard"))
    loose = loose.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") + start)
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    out = placed.where("fits").select(*names).unionByName(loose.select(*names))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
