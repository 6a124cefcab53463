"""Exact top-k search by no-random-access aggregation over sorted lists.

Candidates are packed into blocks where they lie, without a shuffle; every block keeps one sorted list per component.
For a block of queries, each list is read from its better end (the top for a positive query component, the bottom
for a negative one), all lists to the same depth, step by step. At any depth a candidate's component is known if it lies
before the list's frontier; unknown ones are bounded by the frontier from above and by the list's far end from below.
Every task remembers each query's k-th best score so far; that, or the k-th best lower bound, is the bar. A query is
done in a block as soon as only a few candidates have an upper bound at the bar: no outsider can qualify any more, and
the few are resolved. First blocks are small, so that later ones find a bar. The blocks' winners, at most k a query and
block, are merged by a window. How early lists can be left depends on the vectors: for independent components of equal
spread, where nothing but the bar prunes, it is after about three quarters.

Defined results: vectors that are null or hold null or non-finite components, rows of null vec_id, and vectors with a
component that does not fit a long after scaling take no part; vectors are compared with those of equal length only;
repeated rows are candidates of their own; of several valid query rows of one vec_id the least vector asks, and no row
of that vec_id answers; scores beyond a long are set to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a task's first block, and of its later ones at most.
FIRST, BLOCK = 256, 4096
QUERY_BLOCK = 1024
#: Queries whose bars a task remembers.
BARS = 64 * QUERY_BLOCK
#: Queries up to which their blocks are broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_QUERIES = 20_000
SALTS = 64
SCALE = 256.0
#: A query leaves the sorted lists of a block once one in RESOLVE candidates, or k, can still qualify; reading goes on in STEPS steps.
RESOLVE, STEPS = 32, 16


def integers(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    """(vec_id, integer vector) of the rows that take part."""
    out = []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if i is None or v is None or any(x is None for x in v):
            continue
        x = np.floor(np.array(v, dtype=np.float64) * SCALE)
        if np.isfinite(x).all() and (np.abs(x) < 2.0**63).all():
            out.append((i, x.astype(np.int64)))
    return out


def packed(rows: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(length, ids, matrix) of rows of equal length."""
    for d in sorted({len(x) for _, x in rows}):
        own = [(i, x) for i, x in rows if len(x) == d]
        yield d, np.array([i for i, _ in own], dtype=np.int64).tobytes(), np.array([x for _, x in own], dtype=np.int64).tobytes()


def aggregate(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, bar: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query id, candidate id, score) of at least each query's k best candidates of a block that reach its bar (scores known to be
    reached by k others), and the share of the lists that was read for each query. Bars are raised in place."""
    n, d = x.shape
    out, read = [], np.zeros(len(q))
    if not n or not len(q):
        return out, read
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(d, 1)
    kind = np.float64 if bound < 2.0**53 else object  # whole numbers below 2 ** 53 are exact in doubles
    q, x = q.astype(kind), x.astype(kind)
    least = -np.inf if kind is np.float64 else -(1 << 130)
    bar = np.full(len(q), -np.inf) if bar is None else bar
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    own = qid[:, None] == xid[None, :]
    few, at = max(k, n // RESOLVE), max(n - k, 0)
    open_ = np.arange(len(q))
    for step in range(2, STEPS + 1):
        depth = n * step // STEPS
        if not depth or not len(open_):
            continue
        plus, minus = np.maximum(q[open_], 0), np.minimum(q[open_], 0)
        top, bottom = lists[n - depth], lists[depth - 1]
        upper = q[open_] @ x.T if depth == n else plus @ np.maximum(x, top).T + minus @ np.minimum(x, bottom).T
        upper[own[open_]] = least
        bars = bar[open_].astype(kind) if kind is np.float64 or np.isfinite(bar[open_]).all() else np.full(len(open_), least, dtype=kind)
        if depth == n:
            lower = upper
        elif not np.isfinite(bar[open_]).all():
            lower = plus @ np.where(x >= top, x, low).T + minus @ np.where(x <= bottom, x, high).T
            lower[own[open_]] = least
        else:
            lower = None
        if lower is not None:
            bars = np.maximum(bars, (np.partition(lower, at, axis=1) if kind is np.float64 else np.sort(lower, axis=1))[:, at])
        able = (upper >= bars[:, None]) & (upper > least)
        ready = np.flatnonzero((able.sum(axis=1) <= few) | (depth == n))
        for r in ready:
            i = open_[r]
            left = np.flatnonzero(able[r])
            score = x[left] @ q[i] if d else np.zeros(len(left))
            best = np.lexsort((xid[left], -score))[:k] if kind is np.float64 else sorted(range(len(left)), key=lambda j: (-score[j], xid[left[j]]))[:k]
            out += [(int(qid[i]), int(xid[left[j]]), int(min(max(int(score[j]), -(1 << 63)), (1 << 63) - 1))) for j in best]
            if len(best) == k and kind is np.float64:
                bar[i] = max(bar[i], float(score[best[-1]]))
        read[open_[ready]] = depth / n
        open_ = np.delete(open_, ready)
    return out, read


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k best partners of every row whose vec_id is divisible by `every`."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, block = [], FIRST

        def out(own: list) -> Iterator[pa.RecordBatch]:
            for d, ids, m in packed(own):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids], pa.binary()), pa.array([m], pa.binary())], ["d", "ids", "m"])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows += integers(batch.slice(start, BLOCK))
                while len(rows) >= block:
                    yield from out(rows[:block])
                    rows, block = rows[block:], min(2 * block, BLOCK)
        yield from out(rows)

    def pack_queries(key: tuple, table: pa.Table) -> pa.Table:
        rows = [r for batch in table.select(["vec_id", "embedding"]).to_batches() for r in integers(batch)]
        found = list(packed(rows))
        columns = [pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())]
        return pa.Table.from_arrays(columns, ["qb", "d", "qids", "qm"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                d, ids, m, qids, qm = (batch.column(c)[row].as_py() for c in range(5))
                qid, xid = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                q, x = np.frombuffer(qm, np.int64).reshape(len(qid), d), np.frombuffer(m, np.int64).reshape(len(xid), d)
                if len(bars) * QUERY_BLOCK > BARS:
                    bars.clear()
                found, _ = aggregate(q, qid, x, xid, k, bars.setdefault(qids + bytes([d & 255]), np.full(len(qid), -np.inf)))
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    # Invalid vectors are dropped before one vector is chosen for each vec_id, so that a valid row asks whatever rows repeat its id.
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(F.floor(x.cast("double") * SCALE).cast("double")) < 2.0**63) & (F.abs(x.cast("double")) * SCALE < 2.0**64))
    asked = vectors.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull() & fits).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    queries = asked.groupBy("qb").applyInArrow(pack_queries, "qb long, d int, qids binary, qm binary")
    held = vectors.mapInArrow(pack, "d int, ids binary, m binary").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if count <= BROADCAST_QUERIES:
        met = held.join(F.broadcast(queries), ["qb", "d"])
    else:
        held = held.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
        salted = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = held.join(salted, ["qb", "d", "salt"])
    found = met.select("d", "ids", "m", "qids", "qm").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
