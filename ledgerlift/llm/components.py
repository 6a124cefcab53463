"""Connected components: spanning forests inside tasks, then large-star and small-star joins of what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges that a task joins into a forest at a time.
LOT = 500_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (x, y) with the same components: in each lot of a task, every node but the smallest of its tree has one edge, to that."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(i):
            top = i
            while (up := root.get(top, top)) != top:
                top = up
            while i != top:
                root[i], i = top, root[i]
            return top

        def out() -> pa.RecordBatch:
            xs = [x for x in root if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(xs, kind), pa.array([root[x] for x in xs], kind)], ["x", "y"])

        kind, held = None, 0
        for batch in batches:
            kind = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
            held += batch.num_rows
            if held >= LOT:
                yield out()
                root, held = {}, 0
        if held:
            yield out()

    key = edges.schema["x"].dataType.simpleString()
    return edges.mapInArrow(made, f"x {key}, y {key}")


def components(edges: DataFrame) -> DataFrame:
    """edges (x, y) -> stored (x, root): for every node of an edge but the roots, the smallest node that it reaches.

    A round takes the forest of each task's edges; moves every edge to the least neighbour of its smaller end (large
    star); and moves all but the least end of a node to that least one (small star). A node has at most one edge of each
    lot of LOT edges when its ends are collected; the join by smaller ends, where one root may have very many edges,
    is of two plain shuffles, which adaptive execution splits. The rounds end when all trees are stars; each one's table
    is stored."""
    now = stored(edges.select("x", "y"), "edges")
    while True:
        trees = stored(forest(now), "forest")
        discard(now)
        least = stored(trees.groupBy("x").agg(F.min("y").alias("m")), "least").withColumnRenamed("x", "y")
        large = trees.join(least, "y", "left").select("x", F.coalesce("m", "y").alias("y"), F.col("m").isNotNull().alias("moved"))
        ends = large.groupBy("x").agg(F.min("y").alias("m"), F.collect_set("y").alias("ys"), F.max("moved").alias("moved"))
        pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        small = F.transform("ys", lambda y: F.when(y == F.col("m"), pair(F.col("x"), F.col("m"))).otherwise(pair(y, F.col("m"))))
        open_ = F.col("moved") | (F.size("ys") > 1)
        now = stored(ends.select(F.explode(small).alias("e"), open_.alias("open")).select("e.x", "e.y", "open"), "edges")
        discard(trees)
        if not now.agg(F.max("open")).first()[0]:
            return now.select("x", F.col("y").alias("root"))
        now = stored(now.select("x", "y"), "edges")
