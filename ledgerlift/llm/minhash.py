"""Near-duplicates by fast similarity sketching, banding and exact verification.

Rows with equal shingle sets are one class from the start; classes are the nodes of all that follows. Classes that share
a band of their sketches become candidates, and every link is confirmed on the full sets. No step emits all pairs of a
group:

1. Star: in each band bucket every class is compared with one hub only, the class with the smallest share of shingles
   that no other candidate holds. Linked families collapse into components here.
2. Bound: the shingles that a class shares with any candidate bound what it can share with one; a class that cannot
   reach the similarity with any partner of a possible size is done.
3. Prefix join: classes that are still in a bucket with another component are compared by the exact rule for
   overlaps: ordered by rarity, two linked sets share a shingle in their prefixes. The smaller set of a pair needs a
   short prefix only, the larger one a longer one, and both meet by shingle and size; so a shingle of very many classes
   joins those alone whose rarer shingles leave a link open. Only pairs of different components are joined, and on
   each shingle the most frequent component is never joined with itself.

Defined results: null and empty texts are linked with nothing; rows that repeat a doc_id are documents of their own, and
a component's id is the smallest doc_id of its rows; a row of null doc_id is kept only if its component has no id; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .components import components
from .shingles import M1, lists, mix, portions, shingle_sets
from .sketching import sketch

WIDTH = 5
COORDINATES, BANDS, ROWS = 128, 25, 5
#: Most bits of the filter that tells which documents' sets are needed: 16 MB.
FILTER_BITS = 1 << 27
#: Classes that a task remembers, so as to give out the set of each once; emptied beyond.
MEMO = 250_000


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """[len(sets), BANDS] hashes of ROWS sketch coordinates each, told apart by band."""
    k = sketch(sets, COORDINATES)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = out * M1 + k[:, np.arange(BANDS) * ROWS + r]
    return mix(out * M1 + np.arange(BANDS, dtype=np.uint64))


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (a hash of doc_id and text), n (shingles), class (a digest of the set; null if empty) and bands; stored."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                sets = shingle_sets(part.column(2), width)
                own = iter(bands([s for s in sets if len(s)]))
                rows = [next(own) if len(s) else np.zeros(0, dtype=np.uint64) for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], n, pa.array(map(digest, sets), pa.binary()), lists(rows)], ["doc_id", "mark", "n", "class", "bands"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", mark_of(), "text").mapInArrow(made, f"doc_id {key}, mark long, n long, class binary, bands array<long>"), "sketches")


def mark_of() -> Column:
    """Tells a row again by its id and text."""
    return F.xxhash64("doc_id", "text").alias("mark")


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """x (class), n and s (array of shingle hashes), one row per class, of at least the rows whose mark is in `wanted`; stored.

    A bit filter of bounded size goes to the workers; rows that pass it by chance do no harm."""
    bits = 1 << 16
    rows = wanted.count()
    while bits < 16 * rows and bits < FILTER_BITS:
        bits *= 2
    slot = lambda c: F.pmod(c, F.lit(bits)).cast("int")
    words = wanted.select(slot(F.col("mark")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("v")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            at = batch.column(1).to_numpy().astype(np.int64)
            batch = batch.filter(pa.array((shared.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in portions(batch, 0):
                if len(seen) > MEMO:
                    seen.clear()
                fresh = {}
                for own in shingle_sets(part.column(0), width):
                    name = digest(own)
                    if name is not None and name not in seen:
                        seen.add(name)
                        fresh[name] = own
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()), pa.array([len(s) for s in fresh.values()], pa.int64()), lists(list(fresh.values()))], ["x", "n", "s"])

    read = docs.where("text is not null").select("text", slot(mark_of()).alias("slot"))
    return stored(read.mapInArrow(made, "x binary, n long, s array<long>").dropDuplicates(["x"]), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) those with 100 * intersection >= percent * union, on full sets; stored."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                p, q = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    key = sets.schema["x"].dataType.simpleString()
    first, second = sets.select("x", F.col("s").alias("sx")), sets.select(F.col("x").alias("y"), F.col("s").alias("sy"))
    both = pairs.join(first, "x").join(second, "y").select("x", "y", "sx", "sy")
    return stored(both.mapInArrow(confirm, f"x {key}, y {key}").distinct(), "links")


def reachable(own: Column, other: Column, sizes: Column, percent: int) -> Column:
    """Whether sets that share at most own and other shingles with anyone can be linked: overlap * (100 + p) >= p * (sum of sizes)."""
    return F.least(own, other) * (100 + percent) >= sizes * percent


def band_of(size: Column, percent: int) -> Column:
    """Number of a size band: sets that can be linked are in the same band or in neighbouring ones, as bands are wider than sizes may differ."""
    return F.floor(F.log(size) / F.log(F.lit(101.0 / percent)))


def ends_of(n: Column, percent: int) -> tuple[Column, Column]:
    """Last places of a set's prefix, as the smaller (or an equal) set of a pair and as the larger one."""
    return n - F.ceil(n * (2 * percent) / F.lit(100.0 + percent) - 1e-9) + 1, n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1


def meeting(smaller: DataFrame, larger: DataFrame, percent: int, token: str) -> DataFrame:
    """Entries a and b of prefixes, structs with x, n and at (place), that meet on a token, where a.n <= b.n and the places leave a link open.

    Both tables have `token` and the struct `e`. A token's entries meet by bands of sizes, so that no size outside reach is met."""
    low, high = ends_of(F.col("e.n"), percent)
    a = smaller.where(F.col("e.at") <= low).select(token, band_of(F.col("e.n"), percent).alias("band"), F.col("e").alias("a"))
    band = band_of(F.col("e.n"), percent)
    b = larger.where(F.col("e.at") <= high).select(token, F.explode(F.array(band - 1, band)).alias("band"), F.col("e").alias("b"))
    n, m = F.col("a.n"), F.col("b.n")
    rest = F.least(n - F.col("a.at"), m - F.col("b.at")) + 1
    return a.join(b, [token, "band"]).where((n <= m) & (n * 100 >= m * percent) & (rest * (100 + percent) >= (n + m) * percent))


def link(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return judged(docs, percent, width).drop("mark")


def judged(docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, mark, n_shingles, component_id, kept."""
    prints = features(docs, width)
    classes = prints.where("class is not null").groupBy(F.col("class").alias("x")).agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    banded = classes.select("x", F.explode("bands").alias("b"))
    shared = banded.groupBy("b").count().where("count > 1").select("b")
    members = stored(banded.join(shared, "b"), "members")
    sets = full_sets(docs, classes.join(members.select("x").distinct(), "x", "left_semi").select("mark"), width)

    # How many candidates hold each shingle; how many shingles of each are its own alone.
    spread = stored(sets.select("x", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("x").alias("one")), "spread")
    alone = spread.where("df = 1").groupBy(F.col("one").alias("x")).agg(F.count("*").alias("own"))
    nodes = stored(sets.select("x", "n").join(alone, "x", "left").select("x", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")), "nodes")

    # 1. Star.
    inside = members.join(nodes, "x")
    hub = F.struct((1 - F.col("common") / F.col("n")).alias("alone"), "x", "n", "common")
    hubs = inside.groupBy("b").agg(F.min(hub).alias("hub")).select("b", F.col("hub.x").alias("y"), F.col("hub.n").alias("m"), F.col("hub.common").alias("common_y"))
    sizes = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & reachable(F.col("common"), F.col("common_y"), F.col("n") + F.col("m"), percent)
    star = inside.join(hubs, "b").where((F.col("x") != F.col("y")) & sizes).select("x", "y").distinct()
    links = linked(star, sets, percent)
    roots = components(links)

    # 2. Bound, and the buckets in which components still differ.
    least = F.ceil(F.col("n") * percent / F.lit(100.0))
    able = nodes.where(reachable(F.col("common"), F.col("common"), F.col("n") + least, percent)).join(roots, "x", "left")
    able = able.select("x", "n", "common", F.coalesce("root", "x").alias("root"))
    grouped = members.join(able, "x")
    split = grouped.groupBy("b").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("b")
    left = stored(grouped.join(split, "b", "left_semi").select("x", "n", "common", "root").distinct(), "undecided")

    # 3. Prefix join of the rest.
    if not left.isEmpty():
        ranked = Window.partitionBy("x").orderBy("df", "s")
        held = sets.select("x", "s").join(left, "x").select("x", "n", "common", "root", F.explode("s").alias("s"))
        held = held.join(spread.where("df > 1").select("s", "df"), "s").withColumn("at", F.row_number().over(ranked) + F.col("n") - F.col("common"))
        prefix = stored(held.where(F.col("at") <= ends_of(F.col("n"), percent)[1]).select("s", F.struct("x", "n", "root", "at").alias("e")), "prefixes")
        major = prefix.groupBy("s", "e.root").count().groupBy("s").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("top"))
        # Stored, so that the join of a common shingle is of two plain shuffles, which adaptive execution splits.
        major = stored(major.where("roots > 1").select("s", F.col("top.root").alias("major")), "major")
        minor = prefix.join(major, "s").where("e.root != major").select("s", "e")
        met = meeting(minor, prefix, percent, "s").unionByName(meeting(prefix, minor, percent, "s")).where("a.root != b.root")
        more = linked(met.select(F.greatest("a.x", "b.x").alias("x"), F.least("a.x", "b.x").alias("y")).distinct(), sets, percent)
        discard(prefix, major)
        if not more.isEmpty():
            roots = components(more.unionByName(roots.select("x", F.col("root").alias("y"))))
        discard(more)
    discard(members, sets, spread, nodes, left, links)

    # The smallest doc_id of each component of several classes.
    tree = roots.unionByName(roots.select(F.col("root").alias("x"), "root").distinct())
    tree = stored(tree.join(classes.select("x", "doc_id"), "x"), "trees")
    heads = stored(tree.groupBy("root").agg(F.min("doc_id").alias("component")), "heads")
    named = tree.join(heads, "root").select("x", "component", F.lit(True).alias("in_tree"))
    # Stored, so that the join of a class that very many rows hold is of two plain shuffles.
    names = classes.select("x", "doc_id").join(named, "x", "left")
    names = stored(names.select(F.col("x").alias("class"), F.when(F.col("in_tree"), F.col("component")).otherwise(F.col("doc_id")).alias("component")), "class-names")
    discard(classes, tree, heads)
    component = F.when(F.col("class").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return prints.select("doc_id", "mark", "n", "class").join(names, "class", "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near-copies, and of each group of near-copies the rows of its smallest doc_id; all columns."""
    dropped = judged(docs.select("doc_id", "text"), percent).where("not kept").select(F.col("doc_id").alias("gone"), "mark").distinct()
    given = docs.select(F.struct("*").alias("given"), mark_of().alias("own"))
    return given.join(dropped, (F.col("own") == F.col("mark")) & F.col("given.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("given.*")
