"""A Merkle manifest of a dataset: one root for all rows, and for each row the proof that it is under that root.

Rows are the leaves of one tree per key (`lang`), in the order of doc_id; the trees' roots are the leaves of a last tree. A node
is the hash of up to ARITY consecutive children, so all numbers of children are known from a tree's number of leaves.

1. Leaves are sorted by ranges and numbered by the ranges' prefix counts.
2. Sparse forests are summed up. A forest holds unresolved nodes by tree, level and index; the sum of two forests is their
   union, in which every run of siblings that has become complete is replaced by its parent. The sum is associative, so
   each task first sums up its leaves, batch by batch, and tasks' forests (a few nodes on either edge of their range) are summed by a
   reduction in rounds of FAN forests, until only roots are left.
   Nodes from level BLOCK on, one in ARITY ** BLOCK, are written on the way.
3. Proofs: the way from a node of level BLOCK to the root is joined run by run from the written nodes; the rest of a leaf's
   way lies within its block of ARITY ** BLOCK leaves, which one task holds together.

Defined results: among equal doc_ids leaves ascend by their hash; a null doc_id comes first; a null key's tree comes first
among trees; an empty table gives no rows; other columns than doc_id, source, lang, n_chars and text count for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored
from .shingles import runs

BITS = 3
ARITY = 1 << BITS
#: Level from which nodes are written: blocks of 4096 leaves.
BLOCK = 4
#: Forests that are summed up in one task.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[str, int, int]


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a tree on a level."""
    return -(-leaves // ARITY**level)


class Forest:
    """Unresolved nodes (tree, level, index) with their digests, and the number of leaves of each tree."""

    def __init__(self, least: int = BLOCK):
        self.nodes: dict[Node, str] = {}
        self.leaves: dict[str, int] = {}
        self.least = least
        #: Resolved nodes from level `least` on, and roots.
        self.done: list[tuple[str, int, int, str, int]] = []

    def add(self, nodes: Iterator[tuple[str, int, int, str, int]]) -> None:
        """Sum up with (tree, level, index, digest, leaves of the tree): no node may come twice."""
        touched: dict[int, set[tuple[str, int]]] = {}
        for tree, level, index, digest, leaves in nodes:
            self.leaves[tree] = leaves
            self.nodes[tree, level, index] = digest
            touched.setdefault(level, set()).add((tree, index // ARITY))
        while touched:
            level = min(touched)
            for tree, run in touched.pop(level):
                last = width(self.leaves[tree], level)
                if last == 1:
                    self.done.append((tree, level, 0, self.nodes.pop((tree, level, 0)), self.leaves[tree]))
                    continue
                run_of = [(tree, level, i) for i in range(run * ARITY, min((run + 1) * ARITY, last))]
                if all(key in self.nodes for key in run_of):
                    digests = [self.nodes.pop(key) for key in run_of]
                    if level >= self.least:
                        self.done += [(*key, d, self.leaves[tree]) for key, d in zip(run_of, digests, strict=True)]
                    self.nodes[tree, level + 1, run] = joined(digests)
                    touched.setdefault(level + 1, set()).add((tree, run // ARITY))

    def resolved(self) -> list[tuple]:
        """Rows of NODES of what has been resolved since the last call."""
        out, self.done = [(*n, True) for n in self.done], []
        return out

    def open(self) -> list[tuple]:
        """Rows of NODES of what is unresolved."""
        return [(*key, d, self.leaves[key[0]], False) for key, d in self.nodes.items()]


NODES = "tree string, level int, index long, digest string, leaves long, done boolean, part long"
NAMES = [c.split()[0] for c in NODES.split(", ")]
KINDS = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())


def columns_of(rows: list[tuple], part: int) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS[:-1])] + [pa.array([part] * len(rows), KINDS[-1])]


def numbered_leaves(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (tree, ...) with index (place within the tree, in order), leaves (of the tree) and part (the range of the order); stored."""
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "leaf-ranges").withColumn("_range", F.shiftright("_at", 33))
    # One row for each range and tree in it.
    sizes = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.select("tree", "_range", "_first", before.alias("_before"), F.sum("_n").over(of_tree).alias("leaves")), "leaf-sizes")
    offsets = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    out = ranged.join(offsets, ["tree", "_range"]).withColumn("index", F.col("_before") + F.col("_at") - F.col("_first"))
    return stored(out.withColumnRenamed("_range", "part").drop("_at", "_first", "_before"), "leaves")


def resolved(leaves: DataFrame, least: int) -> DataFrame:
    """All nodes from level `least` on, and all roots, of the trees of numbered leaves (tree, index, leaves, leaf, part): tree, level, index, digest."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(least), -1
        for batch in batches:
            parts = batch.column(4).to_numpy()
            for start, end in runs(parts):
                if parts[start] != part:
                    yield pa.RecordBatch.from_arrays(columns_of(forest.resolved() + forest.open(), part), NAMES)
                    forest, part = Forest(least), int(parts[start])
                tree, index, count, digest = (batch.slice(start, end - start).column(c).to_pylist() for c in range(4))
                forest.add(zip(tree, [0] * len(tree), index, digest, count, strict=True))
                yield pa.RecordBatch.from_arrays(columns_of(forest.resolved(), part), NAMES)
        yield pa.RecordBatch.from_arrays(columns_of(forest.open(), part), NAMES)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        forest = Forest(least)
        forest.add(zip(*(rows.column(name).to_pylist() for name in NAMES[:5]), strict=True))
        return pa.Table.from_arrays(columns_of(forest.resolved() + forest.open(), key[0].as_py()), NAMES)

    now = stored(leaves.select("tree", "index", "leaves", "leaf", "part").mapInArrow(fold, NODES), "forest")
    out = now.where("done")
    while not now.where("not done").isEmpty():
        # Neighbouring ranges meet first, so that a sum keeps only what is open on its edges.
        grouped = now.where("not done").withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part")
        now = stored(grouped.applyInArrow(merge, NODES), "forest")
        out = out.unionByName(now.where("done"))
    return out.drop("done", "part", "leaves")


RUN = "struct<at:int,digests:array<string>>"


def ways(nodes: DataFrame, least: int) -> DataFrame:
    """tree, block (index), digest, root and way of every node of level `least`, or of the root of a lower tree: on each level
    up to the root the place in the run of siblings, and the run's digests."""
    nodes = stored(nodes, "nodes")
    runs = nodes.groupBy("tree", "level", F.shiftright("index", BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("held"))
    runs = stored(runs.select("tree", "level", "run", F.col("held.digest").alias("digests")), "runs")
    roots = nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("root"), F.max("level").alias("top"))
    lowest = nodes.groupBy("tree").agg(F.min("level").alias("level"))
    out = nodes.join(lowest, ["tree", "level"]).join(roots, "tree").select("tree", F.col("index").alias("block"), "level", "digest", "root", "top", F.array().cast(f"array<{RUN}>").alias("way"))
    for level in range(least, nodes.agg(F.max("level")).first()[0] or 0):
        up = F.shiftright("block", BITS * (level - least))
        met = out.withColumn("run", F.when(F.col("top") > level, F.shiftright(up, BITS))).join(runs.where(F.col("level") == level).drop("level"), ["tree", "run"], "left")
        step = F.struct((up % ARITY).cast("int").alias("at"), "digests")
        out = met.withColumn("way", F.when(F.col("top") > level, F.concat("way", F.array(step))).otherwise(F.col("way"))).drop("run", "digests")
    return stored(out.drop("level", "top"), "ways")


def siblings(way: list[dict]) -> str:
    return "".join("".join(d for i, d in enumerate(step["digests"]) if i != step["at"]) for step in way)


def folded(leaf: str, way: list[dict]) -> str:
    """The root that a leaf leads to with the given siblings."""
    for step in way:
        leaf = joined([*step["digests"][: step["at"]], leaf, *step["digests"][step["at"] + 1 :]])
    return leaf


def local_ways(digests: list[str], levels: int) -> list[list[dict]]:
    """The ways of the leaves of one block up to its root."""
    out: list[list[dict]] = [[] for _ in digests]
    now = digests
    for level in range(levels):
        runs = [now[i : i + ARITY] for i in range(0, len(now), ARITY)]
        for i, way in enumerate(out):
            at = i // ARITY**level
            way.append({"at": at % ARITY, "digests": runs[at // ARITY]})
        now = [joined(r) for r in runs]
    return out


def field(c: Column) -> Column:
    """A value with the number of its bytes before it; null is a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The hash of a row of documents with a given text."""
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def lowered(text: Column) -> Column:
    """A-Z alone in small letters."""
    letters = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, letters, letters.lower())


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `tampered` (of doc_id) tells the rows whose text is taken in small letters when they are checked against their proofs."""
    given = docs.select(*FIELDS)
    checked = leaf_of(F.col("text")) if tampered is None else F.when(tampered, leaf_of(lowered(F.col("text")))).otherwise(leaf_of(F.col("text")))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    hashed = given.select(tree.alias("tree"), "doc_id", leaf_of(F.col("text")).alias("leaf"), checked.alias("checked"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered_leaves(stored(hashed, "hashed"), ["doc_id", "leaf", "row"])
    blocks = ways(resolved(leaves, BLOCK), BLOCK)
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("leaf"))
    tops = numbered_leaves(subroots, ["of"])
    above = ways(resolved(tops, 0), 0).select(F.col("block").alias("index"), F.col("way").alias("upper"), F.col("root").alias("top"))
    above = tops.select(F.col("of").alias("tree"), "index").join(above, "index").drop("index")
    full = blocks.join(above, "tree").select("tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("way", "upper").alias("way"))
    full = stored(full, "proofs")

    def prove(key: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        upper, subroot, root = (way.column(c)[0].as_py() for c in ("way", "subroot", "root"))
        digests, total = rows.column("leaf").to_pylist(), rows.column("leaves")[0].as_py()
        levels = 0
        while levels < BLOCK and width(total, levels) > 1:
            levels += 1
        own = [w + upper for w in local_ways(digests, levels)]
        proof = [hashlib.sha256(siblings(w).encode()).hexdigest() for w in own]
        again = [folded(d, w) for d, w in zip(rows.column("checked").to_pylist(), own, strict=True)]
        same = lambda v: pa.array([v] * len(own), pa.string())
        columns = [rows.column("doc_id").combine_chunks(), rows.column("leaf"), same(subroot), same(root), pa.array(proof, pa.string()), pa.array(again, pa.string()), pa.array([a == root for a in again], pa.bool_())]
        return pa.Table.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    key = docs.schema["doc_id"].dataType.simpleString()
    blocked = leaves.withColumn("block", F.shiftright("index", BITS * BLOCK)).groupBy("tree", "block")
    proved = blocked.cogroup(full.groupBy("tree", "block")).applyInArrow(prove, f"doc_id {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proved
