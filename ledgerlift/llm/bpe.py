"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. One pass over all texts counts the pre-tokens ("words"); the LEXICON most frequent ones are kept.
2. Their ids are found by exact merging, and the words are compiled, as UTF-8 bytes in sorted order, into a minimal
   acyclic automaton (shared prefixes and shared suffixes). Every transition carries the number of words that come
   before it, so that the sum along a path is a word's rank, and the rank selects the word's ids: a transducer.
3. The automaton's arrays are packed into one file image of bounded size, broadcast, and memory-mapped by each worker.
4. A second pass splits each text into pre-tokens, walks the distinct new words of a batch through the automaton
   together, merges the words that it does not hold exactly, by rank, and remembers both in a bounded memo.

The lexicon changes speed, never results. Defined results: a null text is the empty text, of no ids; special tokens
written in a text become their own id, as the tokenizers library does by default; decoding joins the bytes of the ids
and replaces what is no UTF-8. Only doc_id and text are read; rows map one to one, repeated ones too.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import portions

#: Words in the automaton, and the longest of them in bytes: they bound what is broadcast.
LEXICON = 100_000
LONGEST = 64
#: Words that a worker remembers; the memo is emptied beyond.
MEMO = 500_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Classes of counts per power of two, by which the frequent words are chosen.
SCALE = 16

# The pre-token pattern of byte-level BPE, with white space spelt out.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

# The same pattern for texts below U+0250, where its classes are short lists and the plain engine is faster.
LETTERS, NUMBERS, PLAIN_SPACE = "A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", "0-9\xB2\xB3\xB9\xBC-\xBE", r"\t-\r \x85\xA0"
PLAIN_TOKEN = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{PLAIN_SPACE}{LETTERS}{NUMBERS}]+|[{PLAIN_SPACE}]+(?![^{PLAIN_SPACE}])|[{PLAIN_SPACE}]+"
_wide, _full, _plain = re.compile("[^\0-\u024F]"), regex.compile(PRE_TOKEN), re.compile(PLAIN_TOKEN)


def pre_tokens(text: str) -> list[str]:
    return (_full if _wide.search(text) else _plain).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary: bytes of each id, ranks of merges, and special tokens."""

    def __init__(self, text: str):
        read = json.loads(text)
        model, alphabet = read["model"], byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self.id_of[as_bytes(a)], self.id_of[as_bytes(b)]): (r, self.id_of[as_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_at = regex.compile(f"({marks})") if marks else None
        self.first_byte = [self.id_of[bytes([b])] for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: merges of lowest rank first, of equal ones the leftmost."""
        if len(word) > LONGEST:
            return self.merge_long(word)
        ids, get, none = [self.first_byte[b] for b in word], self.rank.get, (1 << 60, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap: O(n log n), for words of any length."""
        ids = [self.first_byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := self.rank.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.rank.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """A file image of the minimal automaton of sorted distinct words, with the ids of each.

    Arrays, each preceded by its length: edge keys (state * 256 + byte, sorted), edge targets, edge outputs, final
    states, offsets into the ids by rank, ids. State 0 is the start."""
    register: dict[tuple, int] = {}
    edges: list[tuple] = []  # by frozen state: (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # the states of the last word: final, frozen edges

    def freeze(down_to: int, last: bytes) -> None:
        while len(path) > down_to + 1:
            final, own = path.pop()
            key = (final, tuple(own))
            if key not in register:
                register[key] = len(edges)
                edges.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        freeze(common, last)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    freeze(0, last)
    edges.append((path[0][0], tuple(path[0][1])))
    below = []  # number of words from each state on; states were frozen after their targets
    for final, own in edges:
        below.append(final + sum(below[t] for _, t in own))
    number = {len(edges) - 1: 0} | {s: s + 1 for s in range(len(edges) - 1)}  # the start is state 0
    rows = []
    for state, (final, own) in enumerate(edges):
        out = int(final)
        for byte, target in own:
            rows.append((number[state] * 256 + byte, number[target], out))
            out += below[target]
    keys, targets, outputs = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3).T
    finals = np.zeros(len(edges), dtype=np.int64)
    for state, (final, _) in enumerate(edges):
        finals[number[state]] = final
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    flat = np.array([i for own in ids for i in own])
    return b"".join(np.array([len(a)], "<i4").tobytes() + a.astype("<i4").tobytes() for a in (keys, targets, outputs, finals, offsets, flat))


class Lexicon:
    """The memory-mapped automaton."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # the mapping outlives the name and the handle: nothing stays behind
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, arrays = 0, []
        while at < len(image):
            n = int(np.frombuffer(self.map, "<i4", 1, at)[0])
            arrays.append(np.frombuffer(self.map, "<i4", n, at + 4))
            at += 4 + 4 * n
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, or -1: all words walk together, one byte a step."""
        out = np.full(len(words), -1, dtype=np.int64)
        short = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONGEST], dtype=np.int64)
        if not len(self.keys) or not len(short):
            return out
        size = np.array([len(words[i]) for i in short])
        width = int(size.max())
        text = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), dtype=np.uint8).reshape(len(short), width)
        state, rank, alive = np.zeros(len(short), dtype=np.int64), np.zeros(len(short), dtype=np.int64), np.ones(len(short), dtype=bool)
        for step in range(width):
            going = np.flatnonzero(alive & (size > step))
            key = state[going] * 256 + text[going, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            alive[going[~found]] = False
            state[going], rank[going] = np.where(found, self.targets[at], 0), rank[going] + np.where(found, self.outputs[at], 0)
        ok = alive & (self.finals[state] == 1)
        out[short[ok]] = rank[ok]
        return out


class Coder:
    """Encodes and decodes texts with a vocabulary and, for speed, a lexicon. Ids travel as decimal text, joined by commas."""

    def __init__(self, vocabulary: Vocabulary, image: bytes = b""):
        self.vocabulary, self.lexicon = vocabulary, Lexicon(image) if image else None
        self.piece = {str(i): b for i, b in vocabulary.bytes_of.items()}
        self.special = {w: str(i) for w, i in vocabulary.special.items()}
        self.memo: dict[str, str] = {}

    def learn(self, fresh: list[str]) -> None:
        """Put words that the memo lacks into it: from the automaton, or by merging."""
        spelt = [w.encode("utf-8", "surrogatepass") for w in fresh]
        ranks = self.lexicon.ranks(spelt) if self.lexicon else np.full(len(fresh), -1)
        for word, b, rank in zip(fresh, spelt, ranks.tolist(), strict=True):
            ids = self.lexicon.ids[self.lexicon.offsets[rank] : self.lexicon.offsets[rank + 1]].tolist() if rank >= 0 else self.vocabulary.merge(b)
            self.memo[word] = ",".join(map(str, ids))

    def parts(self, text: str) -> list[str]:
        """Pre-tokens, and special tokens as they are."""
        at = self.vocabulary.special_at
        if not at or not at.search(text):
            return pre_tokens(text)
        found = []
        for i, piece in enumerate(at.split(text)):
            found += [piece] if i % 2 else pre_tokens(piece)
        return found

    def encoded(self, texts: list[str]) -> list[str]:
        """The ids of each text."""
        parts = [self.parts(t) for t in texts]
        fresh = set().union(*parts) - self.special.keys()
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
        self.learn([w for w in fresh if w not in self.memo])
        self.memo.update(self.special)
        return [",".join(map(self.memo.__getitem__, p)) for p in parts]

    def ids(self, text: str | None) -> list[int]:
        found = self.encoded([text or ""])[0]
        return [int(i) for i in found.split(",")] if found else []

    def decode(self, ids: str) -> str:
        return b"".join(map(self.piece.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_coders: dict[int, Coder] = {}


def coder_of(source: str, image: bytes) -> Coder:
    """The worker's coder for a vocabulary and a lexicon: made once, kept from task to task."""
    key = hash((source, image))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Vocabulary(source), image)
    return _coders[key]


def frequent_words(docs: DataFrame, size: int = LEXICON) -> DataFrame:
    """At most `size` of the most frequent pre-tokens of all texts (word), of equal counts all or none. Counts are exact.

    Counts are sorted into SCALE classes per power of two, whose sizes tell which of them fit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            words, n = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
            counts.clear()
            short = pc.less_equal(pc.binary_length(words), LONGEST)  # longer words never enter the lexicon
            return pa.RecordBatch.from_arrays([words.filter(short), n.filter(short)], ["word", "n"])

        for batch in batches:
            for part in portions(batch, 0):
                for text in part.column(0).to_pylist():
                    counts.update(pre_tokens(text or ""))
                    if len(counts) > COUNTED:
                        yield out()
        yield out()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * SCALE).cast("int")
    counted = stored(counted.where("n > 1").withColumn("level", level), "word-counts")
    least, held = None, 0
    for row in counted.groupBy("level").count().orderBy(F.col("level").desc()).collect():  # at most 64 * SCALE rows
        held += row["count"]
        if held > size:
            break
        least = row["level"]
    return counted.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def build(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> tuple[str, bytes]:
    """The tokenizer's text, and the lexicon's image for the frequent words of docs, compiled by one task from at most `size` words."""
    with open(tokenizer, encoding="utf-8") as f:  # a few MB, read by the driver
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sorted(b for batch in batches for w in batch.column(0).to_pylist() if len(b := w.encode()) <= LONGEST)
        if words:
            vocabulary = Vocabulary(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([compile_lexicon(words, [vocabulary.merge(w) for w in words])], pa.binary())], ["image"])

    images = frequent_words(docs, size).repartition(1).mapInArrow(compiled, "image binary").collect()
    return source, images[0]["image"] if images else b""


def code(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return run(docs, tokenizer, size, digests=True)


def encode(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> DataFrame:
    """doc_id, ids array<int> and decoded, the text that the ids give back, of every document."""
    return run(docs, tokenizer, size, digests=False)


def run(docs: DataFrame, tokenizer: str, size: int, digests: bool) -> DataFrame:
    source, image = build(docs, tokenizer, size)
    shared = docs.sparkSession.sparkContext.broadcast((source, image))  # a tokenizer's file and at most LEXICON words

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        coder = coder_of(*shared.value)
        for batch in batches:
            for part in portions(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                count, first, second = [], [], []
                for ids in coder.encoded(texts):
                    plain = coder.decode(ids)
                    count.append(ids.count(",") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else [int(i) for i in ids.split(",")] if ids else [])
                    second.append(hashlib.sha256(plain.encode()).hexdigest() if digests else plain)
                kind = pa.string() if digests else pa.list_(pa.int32())
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "first", "second"])

    key = docs.schema["doc_id"].dataType.simpleString()
    kind = "string" if digests else "array<int>"
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = docs.select("doc_id", "text").mapInArrow(coded, f"doc_id {key}, n_tokens long, first {kind}, second string")
    return out.withColumnsRenamed({"first": names[0], "second": names[1]})
