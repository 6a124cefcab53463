"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. One pass over the training documents counts unigrams and bigrams by hashes: tasks count lots of tokens and deal the
   distinct n-grams, packed, to parts by ranges of their hashes. A part holds the n-grams of about PART bytes of text.
2. Each part is filled by one task: it adds the counts up and puts every n-gram into its share of the Bloom filter once for
   each level up to its own; a count c has the level 1 + floor(log2 c). Parts of the filter grow in number with the
   corpus, none is dropped, and each is sized for all its n-grams. The exact counts of the part's words lie beside it.
3. A second pass scores all documents. A count is read back by probing level after level until a probe fails; the bits
   of a probe lie in one 64-bit word, and each distinct n-gram of a lot of texts is looked up once. The probability of a
   word after a word is smoothed with a Dirichlet prior on the unigram probability.
   Filter and word counts of at most BROADCAST bytes together are broadcast to the workers. Larger ones stay in their
   parts: documents are stored in chunks, the distinct n-grams of a chunk are sent to the parts, probed there, and levels
   come back to the chunk. Both ways probe the same filter, so that the scores are equal.
4. The exact base score takes the words' exact counts on the same ways.

Defined results: null texts are empty and hold the end alone; a null doc_id trains and scores as the empty id; repeated
rows count each; without training tokens all counts are 0; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .shingles import M1, mix, portions, word_hashes

#: Most bytes of filter and word counts that are broadcast: what the processor's cache holds.
BROADCAST = 8 << 20
BITS_EACH, HASHES = 10, 4
LEVELS = 62
#: Weight of the unigram prior, and the base score's addition to every count.
PRIOR, ADD = 100.0, 0.1
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens counted together in a task, and bytes of training text whose n-grams make a part.
TOGETHER, PART = 2_000_000, 1 << 25
#: Bytes of text in a chunk, where the filter is not broadcast.
CHUNK = 8_000_000


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each; and the number of tokens of each text."""
    h, n = word_hashes(column)
    out = np.full(len(h) + len(n), END)
    ends = np.zeros(len(out), dtype=bool)
    ends[np.cumsum(n + 1) - 1] = True
    out[~ends] = h
    return out, n + 1


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; the first comes after an end. Filters tell them apart by 48 bits, which two of a billion
    keys share less often than a probe errs."""
    return short(mix(np.append(END, tokens[:-1])[: len(tokens)] * M1 + tokens))


def short(keys: np.ndarray) -> np.ndarray:
    return keys & ~np.uint64(0xFFFF)


def pack(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys without their lowest bits, as compressed differences, byte by byte."""
    return pa.compress(np.diff(keys >> np.uint64(bits), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int, bits: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(bits)


#: Bits that are left out of packed keys of each order.
LOW = {1: 0, 2: 16}


def by_part(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted keys: a part is the top `bits` bits."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(part[start]), start, end


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[start], np.add.reduceat(n, start) if len(start) else n


class Filter:
    """One part of the log-frequency Bloom filter: 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> Filter:
        """A filter sized for keys with their counts."""
        level = np.floor(np.log2(n)).astype(np.int64) + 1
        out = cls(np.zeros(int(level.sum()) * BITS_EACH // 64 + 1, dtype=np.uint64))
        for j in range(1, int(level.max(initial=0)) + 1):
            keys, level = keys[level >= j], level[level >= j]
            place, mask = out.probes(keys, j)
            order = np.argsort(place)
            place, mask = place[order], mask[order]
            start = np.flatnonzero(np.diff(place, prepend=-1))
            out.words[place[start]] |= np.bitwise_or.reduceat(mask, start)
        return out

    def probes(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The word that a key's level falls in, and the HASHES bits of it: one read of memory per probe."""
        h = mix(keys + np.uint64(level * int(M1) & 0xFFFFFFFFFFFFFFFF))
        mask = np.uint64(1) << (h & np.uint64(63))
        for i in range(1, HASHES):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return ((h >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64), mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all probes of a key succeed; 0 if none does."""
        level, at = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys))
        for j in range(1, LEVELS):
            place, mask = self.probes(keys, j)
            hit = np.flatnonzero((self.words[place] & mask) == mask)
            at, keys = at[hit], keys[hit]
            if not len(at):
                break
            level[at] = j
        return level


def middle_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts."""
    level = level.astype(np.int64)
    return np.where(level > 1, 1.5 * 2.0 ** (level - 1) - 0.5, level)


class Part:
    """What a part knows: levels of n-grams, and exact counts of words."""

    def __init__(self, image: bytes, keys: bytes, counts: bytes):
        self.filter, self.keys, self.counts = Filter(np.frombuffer(image, dtype=np.uint64)), np.frombuffer(keys, dtype=np.uint64), np.frombuffer(counts, dtype=np.int64)

    def look(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, exact counts) of keys; counts of words alone."""
        level, exact = self.filter.levels(short(keys)), np.zeros(len(keys) if order == 1 else 0, dtype=np.int64)
        if len(exact) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            exact = np.where(self.keys[at] == keys, self.counts[at], 0)
        return level, exact


COUNTED = "part int, order byte, n long, keys binary, counts binary"


def part_bits(training: DataFrame, part: int = PART) -> int:
    """log2 of the number of parts, by the bytes of training text."""
    size = training.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    return max(0, int(-(-size // part) - 1).bit_length())


def count(training: DataFrame, bits: int) -> DataFrame:
    """Stored parts: part, image (filter), keys and counts (its words), tokens, words and entries."""

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens, rows = np.concatenate(held), []
            for order, keys in ((1, tokens), (2, pair_keys(tokens))):
                keys, n = np.unique(keys, return_counts=True)
                for at, s, e in by_part(keys, bits):
                    rows.append((at, order, e - s, pack(keys[s:e], LOW[order]), pa.compress(n[s:e].astype(np.uint32).tobytes(), codec="zstd", asbytes=True)))
            kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "order", "n", "keys", "counts"])

        held, size = [], 0
        for batch in batches:
            for piece in portions(batch, 0):
                held.append(tokens_of(piece.column(0))[0])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        own: dict[int, list] = {1: [], 2: []}
        for order, n, keys, counts in zip(*(rows.column(c).to_pylist() for c in ("order", "n", "keys", "counts")), strict=True):
            own[order].append((unpack(keys, n, LOW[order]), np.frombuffer(pa.decompress(counts, decompressed_size=4 * n, codec="zstd"), dtype=np.uint32).astype(np.int64)))
        (words, n), pairs = (summed(*(np.concatenate(x) for x in zip(*own[o], strict=True))) if own[o] else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for o in (1, 2))
        image = Filter.of(np.concatenate([short(words), pairs[0]]), np.concatenate([n, pairs[1]])).words
        columns = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (image, words, n)), *(pa.array([int(x)], pa.int64()) for x in (n.sum(), len(words), len(words) + len(pairs[0])))]
        return pa.Table.from_arrays(columns, ["part", "image", "keys", "counts", "tokens", "words", "entries"])

    dealt = training.select("text").mapInArrow(lots, COUNTED)
    return stored(dealt.groupBy("part").applyInArrow(fill, "part int, image binary, keys binary, counts binary, tokens long, words long, entries long"), "lm-parts")


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Stored (chunk, docs): rows of doc_id and text in chunks of about `size` bytes, each as a compressed Arrow stream."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["docs"])

    cut_ = docs.select("doc_id", "text").mapInArrow(cut, "docs binary")
    return stored(cut_.select(F.monotonically_increasing_id().alias("chunk"), "docs"), "lm-chunks")


def docs_of(chunk: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(chunk.as_buffer()).read_next_batch()


ANSWER = "chunk long, order byte, part int, levels binary, counts binary"


def answers(chunks: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """ANSWER rows: for the distinct n-grams of a chunk that lie in a part, in the order of keys, their levels and exact counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, rows = tokens_of(docs_of(docs).column(1))[0], []
                for order, keys in ((1, tokens), (2, pair_keys(tokens))):
                    keys = np.unique(keys)
                    rows += [(at, chunk, order, e - s, pack(keys[s:e], LOW[order])) for at, s, e in by_part(keys, bits)]
                kinds = (pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "chunk", "order", "n", "keys"])

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        own = Part(*(held.column(c)[0].as_py() for c in ("image", "keys", "counts"))) if held.num_rows else Part(bytes(8), b"", b"")
        told = [own.look(o, k) for o, k in ((o, unpack(k, n, LOW[o])) for o, n, k in zip(*(asked.column(c).to_pylist() for c in ("order", "n", "keys")), strict=True))]
        columns = [asked.column("chunk"), asked.column("order"), asked.column("part"), pa.array([t[0].tobytes() for t in told], pa.binary()), pa.array([t[1].tobytes() for t in told], pa.binary())]
        return pa.Table.from_arrays(columns, ["chunk", "order", "part", "levels", "counts"])

    asked = chunks.mapInArrow(ask, "part int, chunk long, order byte, n long, keys binary")
    return asked.groupBy("part").cogroup(parts.select("part", "image", "keys", "counts").groupBy("part")).applyInArrow(answer, ANSWER)


class Scorer:
    """Scores texts, given a way to look up levels and exact counts of sorted distinct keys of an order."""

    def __init__(self, look, tokens: int, distinct: int):
        self.look, self.total = look, tokens + ADD * (distinct + 1)

    def score(self, docs: pa.RecordBatch) -> pa.RecordBatch:
        """doc_id, n_tokens, n_known, base_score and score of a batch of doc_id and text."""
        tokens, n = tokens_of(docs.column(1))
        start = np.cumsum(n) - n
        words, word = np.unique(tokens, return_inverse=True)
        level, exact = self.look(1, words)
        count, base = middle_of(level), np.log10((exact + ADD) / self.total)
        pairs, pair = np.unique(pair_keys(tokens), return_inverse=True)
        both = middle_of(self.look(2, pairs)[0])[pair]
        end = count[np.searchsorted(words, END)]
        before = np.append(end, count[word[:-1]])
        model = np.log10((np.minimum(both, before) + PRIOR * ((count + ADD) / self.total)[word]) / (before + PRIOR))
        sums = [np.add.reduceat(v, start) for v in ((exact > 0).astype(np.int64)[word], base[word], model)]
        return pa.RecordBatch.from_arrays([docs.column(0), pa.array(n, pa.int64()), *(pa.array(s) for s in sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def looked_up(parts: list[tuple[int, Part]], bits: int):
    """A way to look up keys in parts that lie here."""
    own = dict(parts)
    none = Part(bytes(8), b"", b"")

    def look(order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [own.get(at, none).look(order, keys[s:e]) for at, s, e in by_part(keys, bits)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    return look


def score(docs: DataFrame, training: DataFrame, broadcast: int = BROADCAST, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. A model above `broadcast` bytes stays in parts."""
    docs = docs.select("doc_id", "text")
    bits = part_bits(training, part)
    parts = count(training, bits)
    row = parts.agg(F.sum("tokens"), F.sum("words"), F.sum(F.octet_length("image") + F.octet_length("keys") + F.octet_length("counts"))).first()
    tokens, distinct, size = (x or 0 for x in row)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, n_known long, base_score double, score double"
    if size <= broadcast:
        held = [tuple(r) for r in parts.select("part", "image", "keys", "counts").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(held)  # at most `broadcast` bytes

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(looked_up([(r[0], Part(*r[1:])) for r in shared.value], bits), tokens, distinct)
            for batch in batches:
                for piece in portions(batch, 1):
                    yield scorer.score(piece)

        out = docs.mapInArrow(scored, schema)
        discard(parts)
    else:

        def scored_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by([("order", "ascending"), ("part", "ascending")])
            joined = lambda order, name, kind: np.frombuffer(b"".join(v for o, v in zip(right.column("order").to_pylist(), right.column(name).to_pylist(), strict=True) if o == order), dtype=kind)

            def look(order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                level = joined(order, "levels", np.uint8)
                if len(level) != len(keys):
                    raise ValueError(f"{len(keys)} n-grams of a chunk, levels of {len(level)}")
                return level, joined(order, "counts", np.int64)

            return pa.Table.from_batches([Scorer(look, tokens, distinct).score(docs_of(left.column("docs")[0]))])

        chunks = chunked(docs, chunk)
        told = answers(chunks, parts, bits)
        out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scored_chunk, schema)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
