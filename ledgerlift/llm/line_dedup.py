"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct five-word shingles. Lines of equal token sets are one class; classes of Jaccard
similarity of at least 80 % are linked; a line goes if an earlier line (by doc_id, then place in the text) is of its
class or of a linked one. As five words make a token, a word changed inside a line costs five tokens on either side:
lines of fewer than 49 words match only if they are equal or differ at an end.

The join is exact, by prefixes: under one total order of tokens, two sets of the similarity share at least k tokens
among the first n - ceil(0.8 n) + k of each. It runs in two steps, both over all lines:

1. Under the order of the tokens' hashes, each class gives out a prefix of k = 1 + floor(0.1 n). Only classes stay of
   whose prefix as many tokens as the k of their smallest possible partner are given out by another class too: neither
   ordinary prose nor long lines that only hold a shared passage.
2. Of the classes that stay, token frequencies are counted, and prefixes are taken under the order of rarity. A class
   goes if any earlier one is linked with it, so each is first compared with the earliest class of each token of its
   prefix: a family of similar lines is done by as many comparisons as it has prefix tokens. Only classes that no such
   comparison has found late are joined with all earlier classes of their tokens; there the smaller class of a pair
   needs a shorter prefix than the larger one, and they meet by token and size. Both joins filter on lengths, on
   places in the prefix, and on the tokens that a class shares with any other; what is left is verified on full sets.

Defined results: a line without words stays; a line of fewer words than five is one token; a null text has no lines;
rows that repeat a doc_id are documents of their own, in the order of reading; a null doc_id comes last; an empty
table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import discard, stored
from .minhash import linked, meeting, reachable
from .shingles import bytes_of, hash_spans, lists, mix, portions, rolled, rolled_short, runs, spans

WIDTH, PERCENT = 5, 80
#: A token is the upper 52 bits of a shingle's hash, so that a line's number fits beside it in 64.
LINE_BITS = 12
TOKEN_BITS = 64 - LINE_BITS
#: Most bits of the filter that tells which lines are needed: 16 MB.
FILTER_BITS = 1 << 27
#: Classes that a task remembers, so as to give out the prefix of each once; emptied beyond.
MEMO = 250_000
#: Tokens of prefixes that a task compares before it hands them on, and about as many meet in a task afterwards.
COMPARED = 1_000_000
#: Parts the lines of a document in the filter.
STEP = 1_000_000_007


class Lines:
    """Token sets of all lines of a column of texts: one flat array of sorted distinct tokens, and each line's share of it."""

    def __init__(self, column: pa.Array, starts_of: np.ndarray | None = None, wanted=None):
        """With `wanted`, a function of (starts_of of a line's text, place) to booleans, the other lines are left empty."""
        data, bounds = bytes_of(column)
        breaks = np.flatnonzero(data == 10)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        before = np.searchsorted(breaks, bounds)
        per_text = np.where(valid, np.diff(before) + 1, 0)
        self.document = np.repeat(np.arange(len(column)), per_text)
        first = np.cumsum(per_text) - per_text
        self.place = np.arange(len(self.document)) - first[self.document]
        starts, ends = spans(data, bounds)
        text = np.searchsorted(bounds, starts, side="right") - 1
        line = first[text] + np.searchsorted(breaks, starts) - before[text]
        if wanted is not None:
            keep = wanted(starts_of[self.document], self.place)[line]
            starts, ends, line = starts[keep], ends[keep], line[keep]
        size = np.bincount(line, minlength=len(self.document))
        stop = np.cumsum(size)
        h = hash_spans(data, starts, ends)
        every = rolled(h, WIDTH)
        full = np.flatnonzero(np.arange(len(every)) + WIDTH <= stop[line[: len(every)]])
        short = np.flatnonzero((size > 0) & (size < WIDTH))
        few = [rolled_short(h[e - n : e], WIDTH)[0] for e, n in zip(stop[short].tolist(), size[short].tolist(), strict=True)]
        token = mix(np.concatenate([every[full], np.array(few, dtype=np.uint64)])) >> np.uint64(LINE_BITS)
        line = np.concatenate([line[full], short])
        # Sorted by line, then token.
        if len(self.document) <= 1 << LINE_BITS:
            both = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
            both = both[np.diff(both, prepend=both[:1] ^ np.uint64(1)) != 0]
            self.token, self.line = both & np.uint64((1 << TOKEN_BITS) - 1), (both >> np.uint64(TOKEN_BITS)).astype(np.int64)
        else:
            order = np.lexsort((token, line))
            token, line = token[order], line[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
            self.token, self.line = token[new], line[new]
        self.n = np.bincount(self.line, minlength=len(self.document))
        self.end = np.cumsum(self.n)

    def classes(self) -> np.ndarray:
        """16-byte digests of the token sets: two sums of scrambled tokens."""
        out = np.zeros((len(self.n), 2), dtype=np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            start = (self.end - self.n)[full]
            for c, salt in enumerate((np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))):
                out[full, c] = np.add.reduceat(mix(self.token ^ salt), start)
        return out

    def prefixes(self, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, lengths) of the prefixes under the order of hashes, empty for lines that are not given."""
        spare = self.n * (100 - PERCENT) // 100
        length = np.where(given & (self.n > 0), 1 + spare + spare // 2, 0)
        at = np.arange(len(self.token)) - np.repeat(self.end - self.n, self.n)
        return self.token[at < np.repeat(length, self.n)], length


def binary16(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def features(docs: DataFrame) -> DataFrame:
    """row, doc_id, place (null for a document without lines), class (null for a line without words), n, prefix; stored.

    The prefix of a class is given at least once, and mostly once in a task; else it is empty. `docs` may bring its own
    numbers of rows as `row`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in portions(batch, 2):
                found = Lines(part.column(2))
                bare = np.setdiff1d(np.arange(part.num_rows), found.document)
                take = pa.array(np.concatenate([found.document, bare]).astype(np.int64))
                blank = pa.array(np.concatenate([found.n == 0, np.ones(len(bare), dtype=bool)]))
                digest = binary16(np.concatenate([found.classes(), np.zeros((len(bare), 2), dtype=np.uint64)]))
                if len(seen) > MEMO:
                    seen.clear()
                given = np.zeros(len(found.n), dtype=bool)
                for i, c in enumerate(digest.slice(0, len(given)).to_pylist()):
                    if c not in seen:
                        seen.add(c)
                        given[i] = True
                tokens, length = found.prefixes(given)
                ends = np.concatenate([[0], np.cumsum(length), np.full(len(bare), len(tokens))]).astype(np.int32)
                place = np.concatenate([found.place, np.full(len(bare), -1)])
                columns = [
                    part.column(0).take(take),
                    part.column(1).take(take),
                    pa.array(place, pa.int32(), mask=place < 0),
                    pa.compute.if_else(blank, pa.scalar(None, pa.binary()), digest),
                    pa.array(np.concatenate([found.n, np.zeros(len(bare), dtype=np.int64)])),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "place", "class", "n", "prefix"])

    key = docs.schema["doc_id"].dataType.simpleString()
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row")
    return stored(docs.select(row, "doc_id", "text").mapInArrow(made, f"row long, doc_id {key}, place int, class binary, n long, prefix array<long>"), "lines")


def class_heads(lines: DataFrame) -> DataFrame:
    """class, n, first (the earliest line) and given (times that the prefix is given); stored."""
    held = lines.where("class is not null")
    return stored(held.groupBy("class").agg(F.max("n").alias("n"), F.min(spot()).alias("first"), F.count_if(F.size("prefix") > 0).alias("given")), "line-classes")


def spot() -> Column:
    """The place of a line in the order of all lines."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "row", "place")


def open_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """x (class), first, n and s (tokens) of the classes in wanted (class and first, its first line); stored.

    A bit filter of bounded size, by doc_id and place, goes to the workers; lines that pass it by chance do no harm."""
    bits, rows = 1 << 16, wanted.count()
    while bits < 16 * rows and bits < FILTER_BITS:
        bits *= 2
    mark = F.xxhash64("first.doc_id").bitwiseXOR(F.col("first.place").cast("long") * STEP).bitwiseAND(F.lit(bits - 1).cast("long")).cast("int")
    words = wanted.select(mark.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("v")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def needed(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        at = (starts ^ (places * STEP)) & (bits - 1)
        return (shared.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)) == 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                found = Lines(part.column(0), part.column(1).to_numpy(), needed)
                digest = found.classes()
                _, at = np.unique(digest, axis=0, return_index=True)  # of equal lines here one is enough
                at = at[found.n[at] > 0]
                sets = [found.token[found.end[i] - found.n[i] : found.end[i]] for i in at]
                yield pa.RecordBatch.from_arrays([binary16(digest[at]), pa.array(found.n[at]), lists(sets)], ["x", "n", "s"])

    read = docs.where("text is not null").select("text", F.xxhash64("doc_id").alias("slot")).mapInArrow(made, "x binary, n long, s array<long>")
    asked = wanted.select(F.col("class").alias("x"), "first")
    return stored(read.join(asked, "x").dropDuplicates(["x"]), "line-sets")


def shared_tokens(given: DataFrame) -> DataFrame:
    """c and hits: of the tokens in the prefixes of c (c, prefix), how many another c gives out too.

    Tasks compare lots of what they hold first; a token that two classes share there is told to others once. Tokens
    then meet by ranges of their values, packed: a task holds about COMPARED of them, and at most one of a lot for each
    token, however many lines hold it."""
    total = given.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = max(0, int(total // COMPARED).bit_length())

    def compare(t: np.ndarray, c: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of rows (token, class, told: whether others share it already): tokens in order, their first class, whether shared, and (class, hits)."""
        order = np.argsort(t)
        t, c, told = t[order], c[order], told[order]
        start = np.flatnonzero(np.diff(t, prepend=t[:1] ^ np.uint64(1)))
        both = (np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)) | np.logical_or.reduceat(told, start) if len(start) else np.zeros(0, dtype=bool)
        hit = np.repeat(both, np.diff(start, append=len(t))) & ~told
        return t[start], c[start], both, np.unique(c[hit], return_counts=True)

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            t, c, both, (own, n) = compare(t, c, np.zeros(len(t), dtype=bool))
            part = (t >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
            rows = [(int(part[s]), t[s:e], c[s:e], both[s:e], own[:0], n[:0]) for s, e in runs(part)]
            rows.append((int(own[0] & ((1 << bits) - 1)) if len(own) else 0, t[:0], c[:0], both[:0], own, n))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, 6))], ["part", "t", "c", "told", "own", "n"])

        size = 0
        for batch in batches:
            lists_ = batch.column(1)
            held.append((lists_.flatten().to_numpy().view(np.uint64), np.repeat(batch.column(0).to_numpy(), lists_.value_lengths().to_numpy())))
            size += len(held[-1][0])
            if size >= COMPARED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    joined = lambda rows, name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        # A class that a lot found to share a token has its hit there already: told rows hit no class again.
        _, _, _, (c, hits) = compare(joined(rows, "t", np.uint64), joined(rows, "c", np.int64), joined(rows, "told", bool))
        c, hits = np.concatenate([c, joined(rows, "own", np.int64)]), np.concatenate([hits, joined(rows, "n", np.int64)])
        order = np.argsort(c)
        c, hits = c[order], hits[order]
        # The hits of a class come from many parts: they go on packed, by ranges of classes.
        range_ = c >> np.int64(64 - bits) if bits else np.zeros(len(c), dtype=np.int64)
        held = [(int(range_[s]), c[s:e].tobytes(), hits[s:e].tobytes()) for s, e in runs(range_)]
        return pa.table({"range": pa.array([r[0] for r in held], pa.int64()), "c": pa.array([r[1] for r in held], pa.binary()), "hits": pa.array([r[2] for r in held], pa.binary())})

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        c, at = np.unique(joined(rows, "c", np.int64), return_inverse=True)
        return pa.table({"c": c, "hits": np.bincount(at, weights=joined(rows, "hits", np.int64), minlength=len(c)).astype(np.int64)})

    packed = given.mapInArrow(lots, "part int, t binary, c binary, told binary, own binary, n binary")
    met = packed.groupBy("part").applyInArrow(meet, "range long, c binary, hits binary")
    return met.groupBy("range").applyInArrow(total, "c long, hits long")


def prefixes(sets: DataFrame) -> DataFrame:
    """t and e: x, first, n, common (tokens that x shares with any class) and at (the place of t in x); prefixes by rarity; stored."""
    held = sets.select("x", F.explode("s").alias("t"))
    spread = held.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(spread, "t").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ranked"))  # one line's tokens at most
    least = F.ceil(F.col("n") * PERCENT / F.lit(100.0))
    rows = shared.join(sets.select("x", "n", "first"), "x").withColumns({"common": F.size("ranked").cast("long"), "least": least})
    rows = rows.where(reachable(F.col("common"), F.col("common"), F.col("n") + F.col("least"), PERCENT))
    # Tokens that no other class holds come first in the order; they are counted, not listed.
    entries = rows.select("x", "first", "n", "common", F.posexplode(F.slice("ranked", 1, F.greatest(F.lit(0), (F.col("common") - F.col("least") + 1).cast("int")))).alias("i", "e"))
    at = (F.col("i") + 1 + F.col("n") - F.col("common")).alias("at")
    return stored(entries.select(F.col("e.t").alias("t"), F.struct("x", "first", "n", "common", at).alias("e")), "line-prefixes")


def possible(x: str, y: str) -> Column:
    """Whether x and an earlier class y, structs of a common token's entries, can be linked, by lengths, shared tokens and places of the token."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at")) + 1
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return (F.col(f"{y}.first") < F.col(f"{x}.first")) & sizes & reachable(F.col(f"{x}.common"), F.col(f"{y}.common"), n + m, PERCENT) & (rest * (100 + PERCENT) >= (n + m) * PERCENT)


def links(docs: DataFrame, lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of linked classes (x, y), y the earlier one: at least one pair for every class that has an earlier partner; stored."""
    # Step 1. Classes are told apart by 64 bits here: where two agree, more stays for step 2.
    c = F.xxhash64("class").alias("c")
    hits = shared_tokens(lines.where("size(prefix) > 0").select(c, "prefix"))
    need = F.expr(f"1 + (((n * {PERCENT} + 99) div 100) * {100 - PERCENT} div 100) div 2")
    wanted = heads.select("class", "n", "given", "first", c).join(hits, "c")
    wanted = stored(wanted.where(F.col("hits") >= need * F.col("given")).select("class", "first"), "open-lines")
    sets = open_sets(docs, wanted)
    # Step 2. First the earliest class of each token, then all earlier ones.
    prefix = prefixes(sets)
    heads_ = prefix.groupBy("t").agg(F.min(F.struct("e.first", "e.x", "e.n", "e.common", "e.at")).alias("y"))
    pair = lambda x, y: (F.col(f"{x}.x").alias("x"), F.col(f"{y}.x").alias("y"))
    near = linked(prefix.join(heads_, "t").where(possible("e", "y")).select(*pair("e", "y")).distinct(), sets, PERCENT)
    rest = stored(prefix.join(near.select(F.col("x").alias("e_x")).distinct(), F.col("e.x") == F.col("e_x"), "left_anti"), "line-rest")
    as_smaller = meeting(rest, prefix, PERCENT, "t").where(possible("a", "b")).select(*pair("a", "b"))
    as_larger = meeting(prefix, rest, PERCENT, "t").where(possible("b", "a")).select(*pair("b", "a"))
    far = as_smaller.unionByName(as_larger).distinct()
    found = stored(near.unionByName(linked(far, sets, PERCENT)), "line-links")
    discard(wanted, sets, prefix, rest)
    return found


def judged(docs: DataFrame) -> DataFrame:
    """One row per line: row, doc_id, place, class (a digest of its tokens), gone, and match: the place of an earlier line that it is
    linked with or equal to. Documents without lines and lines without words have one row too, with null class."""
    lines = features(docs)
    heads = class_heads(lines)
    found = links(docs, lines, heads)
    firsts = heads.select(F.col("class").alias("x"), "first")
    near = found.join(firsts.select(F.col("x").alias("y"), F.col("first").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
    # Stored, so that the join of a very common line is of two plain shuffles, which adaptive execution splits.
    near = stored(firsts.join(near, "x", "left").select(F.col("x").alias("class"), "first", "other"), "line-matches")
    discard(heads, found)
    told = lines.drop("prefix", "n").join(near, "class", "left")
    match = F.when(F.col("class").isNull(), F.lit(None)).when(F.col("other").isNotNull(), F.col("other")).when(spot() != F.col("first"), F.col("first"))
    return told.select("row", "doc_id", "place", "class", match.isNotNull().alias("gone"), F.col("other").isNotNull().alias("similar"), match.alias("match"))


def digest(lines: DataFrame) -> DataFrame:
    """Of judged lines, one row per document: row, doc_id, n_lines, kept_lines, n_similar (lines with an earlier similar one that differs) and removed."""
    return lines.groupBy("row", "doc_id").agg(
        F.count("place").alias("n_lines"),
        F.count_if(F.col("place").isNotNull() & ~F.col("gone")).alias("kept_lines"),
        F.count_if("similar").alias("n_similar"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("place")))).alias("removed"),
    )


def decide(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, kept_lines, n_similar and removed (places, ascending)."""
    return digest(judged(docs.select("doc_id", "text"))).drop("row")


def memberships(docs: DataFrame) -> DataFrame:
    """One row per line with words: doc_id, place, class_id, gone, and doc_id and place of an earlier line that it matches."""
    found = judged(docs.select("doc_id", "text")).where("class is not null")
    return found.select("doc_id", "place", F.hex("class").alias("class_id"), "gone", F.col("match.doc_id").alias("match_doc_id"), F.col("match.place").alias("match_place"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents with their later matching lines removed from the text; all columns. Rows are told apart by a number of their own."""
    given = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("given")), "line-docs")
    found = digest(judged(given.select("row", "given.doc_id", "given.text"))).where("size(removed) > 0").select("row", "removed")
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    left = F.array_join(bind(F.split("given.text", "\n"), lambda lines: F.transform(kept(lines), lambda i: F.get(lines, i))), "\n")
    text = F.when(F.col("removed").isNotNull(), left).otherwise(F.col("given.text"))
    return given.join(found, "row", "left").select(*(text.alias(c) if c == "text" else F.col("given")[c].alias(c) for c in docs.columns))
