"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

1. One pass over all labelled training documents counts, for each hashed n-gram (1 to 3 lower-cased characters), the
   documents that hold it: the IDF covers the whole training corpus.
2. The classifier is fitted on a bounded sample: PER_LANGUAGE documents of each of the LANGUAGES most frequent
   languages, chosen by a hash of doc_id; whole texts are read, where they lie, and only their n-gram counts (at most
   SLOTS of 6 bytes, shared evenly among the languages) meet in the one task that fits. Training is follow-the-regularised-leader with
   per-coordinate rates and elastic-net penalties (L1 leaves most weights exactly 0), on softmax gradients.
3. A fifth of the sample is held back from fitting and sets the temperature that minimises its log loss.
4. All documents are scored in one pass: a feature's value is its relative frequency times its IDF, so a text's scores
   are one gather and one sum over its n-grams, whatever its length.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if nothing is
labelled; ties between languages go to the first by code point; rows map one to one, repeated ones too; other
columns are ignored by `predict` and kept by `keep_languages`.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .shingles import portions

BITS = 16
SIZE = 1 << BITS
ORDERS = 3
#: Bounds of the sample that the classifier is fitted on.
LANGUAGES = 200
PER_LANGUAGE = 400
#: Most n-gram slots of all sample documents together: 600 MB in the task that fits. Beyond, a language's last documents are left out.
SLOTS = 100_000_000
EPOCHS = 4
#: Follow-the-regularised-leader: rate, its offset, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 40.0
UNKNOWN = "und"
#: Cells of the weight table that are gathered at once: 32 MB.
CELLS = 8_000_000

LETTER = re.compile(r"[^\W\d_]")


def ngram_slots(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash slot of the n-gram that starts at each code point (the last ones run past the end)."""
    c = codes.astype(np.uint32)
    slots, h = [], np.zeros(len(c), dtype=np.uint32)
    for order in range(1, ORDERS + 1):
        if len(c) < order:
            break
        h = h[: len(c) - order + 1] * np.uint32(0x9E3779B1) + c[order - 1 :] + np.uint32(order)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        slots.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return slots


def codes_of(text: str) -> np.ndarray:
    """Lower-cased code points, with a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def known(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def text_slots(text: str) -> np.ndarray:
    """All n-gram slots of one text."""
    return np.concatenate(ngram_slots(codes_of(text)))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each slot the documents that hold it, and the number of documents; exact, over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, rows = np.zeros(SIZE, dtype=np.int64), np.zeros(SIZE, dtype=bool), 0
        for batch in batches:
            for part in portions(batch, 0):
                for text in part.column(0).to_pylist():
                    if known(text):
                        for slots in ngram_slots(codes_of(text)):
                            seen[slots] = True
                        held = np.flatnonzero(seen)
                        total[held] += 1
                        seen[held] = False
                        rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["slot", "n"])

    found = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(SIZE, dtype=np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def sample(docs: DataFrame) -> DataFrame:
    """lang, h (a hash that splits the sample), and slots and counts of the n-grams of the documents in the bounded fitting sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 3):
                found = [np.unique(text_slots(t), return_counts=True) if known(t) else None for t in part.column(3).to_pylist()]
                packed = [[None if f is None else f[k].astype(kind).tobytes() for f in found] for k, kind in ((0, np.uint16), (1, np.uint32))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "lang", "h", "slots", "counts"])

    narrow = stored(docs.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(9)).alias("h")).where("doc_id is not null"), "lang-ids")
    common = narrow.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES)
    ranked = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = narrow.join(F.broadcast(common.select("lang")), "lang").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= PER_LANGUAGE)
    picked = picked.select("doc_id", "h").distinct()  # at most LANGUAGES * PER_LANGUAGE ids
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "lang", "h", "text")
    rows = rows.mapInArrow(counted, f"doc_id {key}, lang string, h long, slots binary, counts binary").where("slots is not null")
    # Of rows that repeat a doc_id in one language, one is in the sample.
    return rows.groupBy("doc_id", "lang", "h").agg(F.min(F.struct("slots", "counts")).alias("f")).select("lang", "h", "doc_id", "f.*")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(row: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights [SIZE + 1, classes] (the last row is the bias) fitted to sparse rows, each a function's (slots, values) of its number."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, x = row(i)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    return weights(np.arange(SIZE + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that minimises the log loss of held-back rows, by golden-section search on its log."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = -1.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, and a table [SIZE, languages] of weight times IDF, divided by the temperature; the bias apart."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray):
        self.languages, self.table, self.bias = languages, table.astype(np.float32), bias

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities of the languages, of a text with a letter."""
        total, count = np.zeros(len(self.languages)), 0
        codes, chunk = codes_of(text), max(1, CELLS // len(self.languages))
        for start in range(0, max(1, len(codes) - ORDERS + 1), chunk):
            piece = codes[start : start + chunk + ORDERS - 1]
            for slots in ngram_slots(piece):
                own = slots[:chunk] if start + chunk < len(codes) - ORDERS + 1 else slots
                total += self.table[own].sum(axis=0, dtype=np.float64)
                count += len(own)
        return softmax(SCALE * total / max(count, 1) + self.bias)

    def best(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; UNKNOWN and 0 of a text without a letter."""
        if not self.languages or not known(text):
            return UNKNOWN, 0.0
        p = self.scores(text)
        return self.languages[int(p.argmax())], float(p.max())


def within(rows: Iterator[tuple[str, int, bytes, bytes]], languages: int) -> list[tuple[str, int, bytes, bytes]]:
    """The rows (lang, h, slots, counts), but of each language no more than its share of SLOTS."""
    held: dict[str, int] = {}
    out = []
    for row in rows:
        size = held.get(row[0], 0) + len(row[2]) // 2
        if size <= SLOTS // max(languages, 1) or row[0] not in held:
            held[row[0]] = size
            out.append(row)
    return out


def fitted(rows: list[tuple[str, int, bytes, bytes]], idf: np.ndarray) -> Model:
    """The model of sample rows (lang, h, slots, counts); a fifth of them, by h, sets the temperature.

    Rows stay packed; each is turned to slots and values when its turn comes."""

    def feature(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.frombuffer(rows[i][2], np.uint16).astype(np.int64), np.frombuffer(rows[i][3], np.uint32)
        return np.append(at, SIZE), np.append(SCALE * idf[at] * n / n.sum(), 1.0)

    languages = sorted({r[0] for r in rows})
    y, held = np.array([languages.index(r[0]) for r in rows]), np.array([r[1] % 5 == 0 for r in rows])
    if held.all():
        held[:] = False
    used = np.flatnonzero(~held)
    weights = ftrl(lambda i: feature(used[i]), y[~held], len(languages))
    logits = np.array([x @ weights[at] for at, x in map(feature, np.flatnonzero(held))]).reshape(-1, len(languages))
    t = temperature(logits, y[held])
    return Model(languages, idf[:, None] * weights[:SIZE] / t, weights[SIZE] / t)


def fit(training: DataFrame) -> Model:
    """The model of labelled documents (doc_id, lang, text); fitted by one task, as the sample is bounded."""
    training = training.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    df, rows = document_frequency(training)
    idf = np.log((1 + rows) / (1 + df)) + 0.1

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("lang", "h", "slots", "counts")
        own = within((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)), languages)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(own, idf))], pa.binary())], ["model"])

    languages = training.select("lang").distinct().limit(LANGUAGES).count()
    found = sample(training).repartition(1).sortWithinPartitions("h", "lang", "doc_id").mapInArrow(once, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model([], np.zeros((SIZE, 0)), np.zeros(0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats for each of at most LANGUAGES languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in portions(batch, 1):
                told = [own.best(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], ["doc_id", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {key}, lang_pred string, score double")


def remainder(mod: int):
    """crc32 of doc_id as text, modulo; a null doc_id has the remainder of the empty text's sum, 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % mod


def keep_languages(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents whose language is told with a score of at least `least`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in portions(batch, batch.schema.get_field_index("text")):
                stay = [t[0] != UNKNOWN and t[1] >= least for t in map(own.best, part.column("text").to_pylist())]
                yield part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
