"""Words and word shingles of texts, hashed inside tasks: whole columns at once with numpy, without an object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text whose words are hashed in one go.
PIECE = 1 << 18
#: Bytes of text that operators handle together (a longer text goes alone).
PORTION = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, the same for A-Z as for a-z.
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * M1) | np.uint64(1)
VALUE[ord("A") : ord("Z") + 1] = VALUE[ord("a") : ord("z") + 1]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A word of at most SHORT bytes is hashed as a polynomial modulo 2 ** 64: its base, and the powers of the base and of its inverse.
#: From 1024 bytes on, words can be built that collide under every base; so longer words are hashed by a digest of their bytes.
SHORT = 256
BASE = int(M3) | 3
POWER, INVERSE = np.full(PIECE + 1, BASE, dtype=np.uint64), np.full(PIECE, pow(BASE, -1, 1 << 64), dtype=np.uint64)
POWER[0] = INVERSE[0] = 1
POWER, INVERSE = np.multiply.accumulate(POWER), np.multiply.accumulate(INVERSE)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins and the last one ends; a null text is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last; a word ends where its text does."""
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    cut = cut[inside[cut - 1] & inside[cut]]
    return (np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))) if len(cut) else (starts, ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z."""
    out, at = np.zeros(len(starts), dtype=np.uint64), 0
    long = np.flatnonzero(ends - starts > SHORT)
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        size = ends[to - 1] - first
        if size <= PIECE:  # else one word longer than a piece
            total = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(VALUE[data[first : first + size]] * INVERSE[:size], out=total[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (total[e] - total[s]) * POWER[e]
        at = to
    out = mix(out)
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    data, bounds = bytes_of(column)
    starts, ends = spans(data, bounds)
    return hash_spans(data, starts, ends), np.diff(np.searchsorted(starts, bounds))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """For each place with `width` words from it on, an unscrambled hash of those words."""
    out = h[: max(0, len(h) - width + 1)]
    for k in range(1, width):
        out = out * M1 + h[k : k + len(out)]
    return out


def rolled_short(h: np.ndarray, width: int) -> np.ndarray:
    """The same of a sequence of fewer words, filled up with its length."""
    return rolled(np.concatenate([h, np.full(width - len(h), len(h), dtype=np.uint64)]), width)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of fewer words, the whole sequence as one; of none, nothing."""
    h, counts = word_hashes(column)
    every, ends, out = mix(rolled(h, width)), np.cumsum(counts).tolist(), []
    for n, end in zip(counts.tolist(), ends, strict=True):
        if n >= width:
            own = np.sort(every[end - n : end - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(mix(rolled_short(h[end - n : end], width)) if n else h[:0])
    return out


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Rows of 64-bit numbers as a column of lists."""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal numbers; none of an empty array."""
    starts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *starts.tolist()], [*starts.tolist(), len(x)], strict=True)) if len(x) else []


def portions(batch: pa.RecordBatch, text: int, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts (column `text`) have about `size` bytes together; a longer text is one slice, an empty batch none."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    portion = (np.cumsum(length + 64) - length) // size
    starts = np.flatnonzero(np.diff(portion, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))
