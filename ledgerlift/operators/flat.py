"""Pages of words as flat arrays: a task's words, sorted by page, are cut into lots of whole pages, and lines and vertical
bands are found for all pages of a lot at once."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import CYRILLIC, LATIN

#: Blanks as functions.text knows them.
BLANK = re.compile(r"[\s\u001C-\u001F]*")
#: Words of a lot; a page is never cut.
LOT = 100_000
SLACK_LEAST, SLACK_MOST = 12, 60

FOLD = str.maketrans(LATIN, CYRILLIC)
LOOKALIKE = re.compile(f"[{LATIN}]")
NUMERIC = re.compile(r"[\d\-−()+]")
LONE_DIGITS = re.compile(r"(?<![0-9])([0-9]{4})(?![0-9])")


def fold(text: str) -> str:
    """Latin letters that look like Cyrillic ones become those."""
    return text.translate(FOLD) if LOOKALIKE.search(text) else text


def token(text: str) -> str:
    """Folded, in small letters, letters and digits only."""
    low = fold(text).lower()
    return low if low.isalnum() else "".join(filter(str.isalnum, low))


def lone_digits(text: str) -> str:
    found = LONE_DIGITS.search(text)
    return found.group(1) if found else ""


class Pages(NamedTuple):
    """The pages of a lot: page (from 0) of each word, and id, number and year of each page."""

    of_words: np.ndarray
    doc_ids: list[str]
    numbers: list[int]
    years: list[int | None]


def pages_of_words(words: pa.Table) -> Pages:
    same = lambda name: pc.equal(words.column(name).slice(1), words.column(name).slice(0, words.num_rows - 1)).combine_chunks()
    new = np.ones(words.num_rows, dtype=bool)
    new[1:] = ~pc.and_(same("doc_id"), same("page")).to_numpy(zero_copy_only=False)
    first = pa.array(np.flatnonzero(new))
    taken = lambda name: words.column(name).take(first).to_pylist()
    return Pages(np.cumsum(new) - 1, taken("doc_id"), taken("page"), taken("year") if "year" in words.column_names else [None] * len(first))


class Lot:
    """Words of whole pages, by page, line (in order of first appearance) and left edge; and the lines.

    Arrays over words: page (number in the lot), line (number in the lot), row (place of the line's first word), id, left, top, right,
    bottom, height, code (number of the text). `texts` has each different text once; what is told from a text is told once."""

    def __init__(self, words: pa.Table, pages: Pages | None = None):
        """words: by page; pages tells which page each word is of, if the words do not."""
        page, self.doc_ids, self.page_numbers, self.years = pages or pages_of_words(words)
        column = lambda name: words.column(name).to_numpy()
        # Lines, and words in each by left edge.
        block, par, line, left, pos = (column(c) for c in ("block", "par", "line", "left", "pos"))
        order = np.lexsort((pos, left, line, par, block, page))
        starts_line = np.zeros(len(order), dtype=bool)
        starts_line[:1] = True
        for c in (page, block, par, line):
            starts_line[1:] |= np.diff(c[order]) != 0
        segment = np.cumsum(starts_line) - 1
        begin = np.flatnonzero(starts_line)
        row = np.minimum.reduceat(pos[order], begin)
        rank = np.empty(len(begin), dtype=np.int64)
        rank[np.lexsort((row, page[order][begin]))] = np.arange(len(begin))
        by_line = np.argsort(rank[segment], kind="stable")
        order, self.line, self.row = order[by_line], rank[segment][by_line], row[segment][by_line]
        self.page, self.id = page[order], pos[order]
        self.place = {"block": block[order], "par": par[order], "line": line[order]}
        self.left, self.top, self.right, self.bottom, self.height = (column(c)[order].astype(np.int64) for c in ("left", "top", "right", "bottom", "height"))
        coded = words.column("text").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.texts = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy()[order]
        self.line_start = np.append(np.flatnonzero(np.diff(self.line, prepend=-1)), len(order))
        line_page = self.page[self.line_start[:-1]]
        self.page_line = np.searchsorted(line_page, np.arange(len(self.doc_ids) + 1))
        self.page_start = np.append(np.flatnonzero(np.diff(self.page, prepend=-1)), len(order))

    @cached_property
    def held(self) -> dict[str, list[int]]:
        """The arrays as lists, for what is looked at word by word."""
        return {c: getattr(self, c).tolist() for c in ("row", "id", "left", "top", "right", "bottom", "height")}

    @cached_property
    def word_texts(self) -> list[str]:
        return self.told(str)

    def told(self, f: Callable[[str], object]) -> list:
        """f of every word's text."""
        return self.each([f(t) for t in self.texts])

    def each(self, values: list) -> list:
        """Of values of the texts, the value of every word's text."""
        return [values[c] for c in self.codes]

    @cached_property
    def codes(self) -> list[int]:
        return self.code.tolist()

    def line_boxes(self) -> tuple[list[int], list[int]]:
        """Top and bottom of each line."""
        begin = self.line_start[:-1]
        return np.minimum.reduceat(self.top, begin).tolist(), np.maximum.reduceat(self.bottom, begin).tolist()

    def slots(self) -> np.ndarray:
        """For each word the number of its vertical band on its page: the first band whose grown span it overlaps, or a new one.

        Words are taken in order, the same place of all pages at once. Spans overlap with a slack of the wider one's width, within bounds."""
        size = np.diff(self.page_start)
        by_size = np.argsort(-size, kind="stable")
        start, out = self.page_start[:-1][by_size], np.zeros(len(self.page), dtype=np.int64)
        left, right = (np.zeros((len(size), 8), dtype=np.int64) for _ in range(2))
        bands, rows = np.zeros(len(size), dtype=np.int64), np.arange(len(size))
        for k in range(size.max(initial=0)):
            n = int(np.searchsorted(-size[by_size], -k))  # pages with more than k words
            at, most = start[:n] + k, int(bands[:n].max())
            if most == left.shape[1]:
                left, right = (np.concatenate([a, np.zeros_like(a)], axis=1) for a in (left, right))
            wl, wr = self.left[at], self.right[at]
            bl, br = left[:n, :most], right[:n, :most]
            slack = np.clip(np.maximum((wr - wl)[:, None], br - bl), SLACK_LEAST, SLACK_MOST)
            met = (wr[:, None] >= bl - slack) & (br >= wl[:, None] - slack) & (np.arange(most) < bands[:n, None])
            old = met.any(axis=1)
            slot = np.where(old, met.argmax(axis=1) if most else 0, bands[:n])
            own = rows[:n], slot
            left[own] = np.where(old, np.minimum(left[own], wl), wl)
            right[own] = np.where(old, np.maximum(right[own], wr), wr)
            bands[:n] += ~old
            out[at] = slot
        return out


class Band:
    """A vertical band of a page: number, left edge and words (by line, then left edge); what else is asked of few bands is told when it is."""

    def __init__(self, lot: Lot, slot: int, words: list[int], kinds: int = 0):
        """kinds: bits of what its words can be of."""
        self.lot, self.slot, self.words, self.kinds = lot, slot, words, kinds
        self.left = min([lot.held["left"][w] for w in words])

    @cached_property
    def box(self) -> tuple[int, int, int, int]:
        top, right, bottom = (self.lot.held[c] for c in ("top", "right", "bottom"))
        return self.left, min([top[w] for w in self.words]), max([right[w] for w in self.words]), max([bottom[w] for w in self.words])

    @cached_property
    def text(self) -> str:
        """Its words: lines by top and left, words by left."""
        top, left, row, texts = self.lot.held["top"], self.lot.held["left"], self.lot.held["row"], self.lot.word_texts
        lines: dict[int, list[int]] = {}
        for w in self.words:
            lines.setdefault(row[w], []).append(w)
        by_top = sorted((min([top[w] for w in own]), left[own[0]], r) for r, own in lines.items())
        return "\n".join([" ".join([texts[w] for w in lines[r]]) for _, _, r in by_top]).strip()

    @cached_property
    def in_order(self) -> list[int]:
        """Its words by top and left."""
        top, left, row, place = (self.lot.held[c] for c in ("top", "left", "row", "id"))
        return [w for *_, w in sorted([(top[w], left[w], row[w], place[w], w) for w in self.words])]

    @cached_property
    def named(self) -> tuple[list[int], list[str]]:
        """Its words with a token, in order, and their tokens."""
        tokens = self.lot.tokens
        named = [w for w in self.in_order if tokens[w]]
        return named, [tokens[w] for w in named]

    @property
    def rows(self) -> list[int]:
        """The rows of its lines, in order."""
        return list(dict.fromkeys([self.lot.held["row"][w] for w in self.in_order]))


def bands_of_pages(lot: Lot, wanted: np.ndarray, kinds: np.ndarray | None = None) -> dict[int, list[Band]]:
    """The bands of the wanted pages (booleans), by left edge; with `kinds` (bits, of each word) those with any such word alone."""
    slots, out = lot.slots(), {}
    by_band = lot.page * (int(slots.max(initial=0)) + 1) + slots
    of_band = np.zeros(int(by_band.max(initial=0)) + 1, dtype=np.int64)
    if kinds is not None:
        np.bitwise_or.at(of_band, by_band, kinds)
    told, slots, starts = of_band[by_band].tolist(), slots.tolist(), lot.page_start.tolist()
    for page in np.flatnonzero(wanted).tolist():
        own: dict[int, list[int]] = {}
        for w in range(starts[page], starts[page + 1]):
            if told[w] or kinds is None:
                if (slot := slots[w]) in own:
                    own[slot].append(w)
                else:
                    own[slot] = [w]
        out[page] = sorted([Band(lot, slot, words, told[words[0]]) for slot, words in own.items()], key=lambda b: (b.left, b.slot))
    return out


def lots(batches: Iterator[pa.RecordBatch], size: int = LOT) -> Iterator[Lot]:
    """Lots of whole pages of a stream of words that come page by page."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.num_rows
        if total >= size:
            words = pa.Table.from_batches(held)
            last = (words.column("doc_id")[-1], words.column("page")[-1])
            inside = pc.and_(pc.equal(words.column("doc_id"), last[0]), pc.equal(words.column("page"), last[1]))
            cut = pc.index(inside, True).as_py()
            if cut:
                yield Lot(words.slice(0, cut))
            held, total = words.slice(cut).to_batches(), words.num_rows - cut
    if total:
        yield Lot(pa.Table.from_batches(held))


def whole(batches: Iterator[pa.RecordBatch], size: int = LOT, every: bool = False, empty: bool = False) -> Iterator[tuple[pa.RecordBatch, Lot | None, np.ndarray]]:
    """Lots of documents that come whole, one in a row (pages.rows_of): the rows, their lot (of all pages with words) and each page's row.

    Rows are kept together as long as they have `size` words. Words are kept as pages.typed does, or `every` one. Rows
    without any word are left out, or if `empty` come without a lot."""
    for rows in cut(batches, size):
        gc.disable()  # what is made of a lot has no cycles, and is much
        lot, row_of = lot_of_rows(rows, every)
        if lot or empty:
            yield rows, lot, row_of
        gc.enable()


def cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows as long as they have `size` words together; one row at least."""
    for batch in batches:
        words_to = np.append(0, np.cumsum(pc.list_value_length(batch.column("words").values).fill_null(0).to_numpy()))[batch.column("words").offsets.to_numpy()]
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(words_to, words_to[start] + size, side="right")) - 1, start + 1)
            yield batch.slice(start, end - start)
            start = end


def whole_alike(batches: Iterator[pa.RecordBatch], digits: str, least_year: int, size: int = 2 * LOT) -> Iterator[tuple[pa.RecordBatch, "Alike", Lot | None, np.ndarray]]:
    """The rows of `whole`, which stand for which, and the lot and rows of those that stand alone. Instead of ids the lot has numbers of
    runs of equal ids."""
    last, run = None, 0
    for rows in cut(batches, size):
        gc.disable()
        ids, runs = rows.column("doc_id").to_pylist(), []
        for doc_id in ids:
            run += doc_id != last
            last = doc_id
            runs.append(run)
        like = alike(rows, digits, least_year)
        lot, row_of = lot_of_rows(rows.take(pa.array(like.standing)), False)
        if lot:
            lot.doc_ids = [str(runs[like.standing[r]]) for r in row_of.tolist()]
        yield rows, like, lot, row_of
        gc.enable()


#: Numbers as they stand for one another: what is told of a page asks of their digits only whether they are a label's or a year.
PLAIN_NUMBER = r"^[.,()\-−]*[0-9][0-9.,()\-−]*$"


class Alike(NamedTuple):
    """Rows of documents of which one stands for several: those that stand (in order), which of them each row has; of all words of the rows,
    the texts (each once), the number of each word's text, and each row's first word (and the end)."""

    standing: np.ndarray
    of: np.ndarray
    texts: pa.Array
    code: np.ndarray
    first: np.ndarray


def alike(rows: pa.RecordBatch, digits: str, least_year: int) -> Alike:
    """Documents whose pages have the same words in the same places, but for plain numbers: those of which no digits are a label's (`digits`)
    and that are or are not the document's year or the year before in both, if it counts (from `least_year` on). All that is told of one is told of the other, with its own numbers.

    First and last row, and rows next to one of equal id, stand for themselves, as columns are carried along an id's rows."""
    pages = rows.column("words").flatten()
    each, of_page = pages.flatten(), pc.list_value_length(pages).fill_null(0).to_numpy(zero_copy_only=False)
    of_row = pc.list_value_length(rows.column("words")).fill_null(0).to_numpy(zero_copy_only=False)
    page_row, page_first = np.repeat(np.arange(rows.num_rows), of_row), np.append(0, np.cumsum(of_page))
    first, row = page_first[np.append(0, np.cumsum(of_row))], np.repeat(page_row, of_page)
    held = dict(zip([f.name for f in each.type], each.flatten(), strict=True))
    coded = held["text"].fill_null("").dictionary_encode()
    texts, code = coded.dictionary, coded.indices.to_numpy()
    number = pc.and_(pc.match_substring_regex(texts, PLAIN_NUMBER), pc.invert(pc.match_substring_regex(texts, digits))).to_numpy(zero_copy_only=False)
    # A word without text is not one of empty text, but both are blank.
    shown = np.where(number, -1, np.arange(len(texts)))[code]
    fields = [np.repeat(rows.column("page").flatten().fill_null(-1).to_numpy(zero_copy_only=False), of_page), np.repeat(np.arange(len(of_page)) - np.append(0, np.cumsum(of_row))[page_row], of_page), held["level"].fill_null(-1).to_numpy(zero_copy_only=False)]
    fields += [held[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("block", "par", "line", "left", "top", "width", "height")]
    year = rows.column("year").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    dated, counts = np.zeros(len(code), dtype=np.int64), np.flatnonzero(year[row] >= least_year)
    if len(counts):
        own, at = np.unique(code[counts], return_inverse=True)
        listed, years = texts.take(pa.array(own)).to_pylist(), year[row[counts]]
        for bit, told in enumerate((token, lone_digits)):
            value = np.fromiter([int(t) if len(t) == 4 and t.isascii() and t.isdigit() else -1 for t in map(told, listed)], np.int64, len(listed))[at]
            dated[counts] |= (value == years).astype(np.int64) << 2 * bit | (value == years - 1).astype(np.int64) << 2 * bit + 1
    looks = np.column_stack([shown, dated, *fields]).astype(np.int32)
    ids = rows.column("doc_id").to_pylist()
    alone = {0, rows.num_rows - 1, *(i for n in range(1, len(ids)) if ids[n] == ids[n - 1] for i in (n - 1, n)), *np.flatnonzero(year > 9999).tolist()}
    met: dict[bytes | int, int] = {}
    ends = first.tolist()
    of = np.fromiter([met.setdefault(n if n in alone else looks[a:b].tobytes(), len(met)) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], np.int64, rows.num_rows)
    standing = np.unique(of, return_index=True)[1]
    return Alike(standing, of, texts, code, first)


def lot_of_rows(rows: pa.RecordBatch, every: bool) -> tuple[Lot | None, np.ndarray]:
    pages, row = rows.column("words").flatten(), pc.list_parent_indices(rows.column("words")).to_numpy()
    each, page, of_page = pages.flatten(), pc.list_parent_indices(pages).to_numpy(), pc.list_value_length(pages).fill_null(0).to_numpy()
    held = dict(zip([f.name for f in each.type], each.flatten(), strict=True))
    held["pos"] = pa.array(np.arange(len(page)) - np.repeat(np.cumsum(of_page) - of_page, of_page))
    if not every:
        texts = held["text"].dictionary_encode()
        words = pa.array([t is not None and not BLANK.fullmatch(t) for t in texts.dictionary.to_pylist()], pa.bool_()).take(texts.indices)
        kept = pc.and_(words, pc.equal(held["level"], 5)).fill_null(False)
        if not pc.all(kept).as_py():
            held, page = {k: v.filter(kept) for k, v in held.items()}, page[kept.to_numpy(zero_copy_only=False)]
    if not len(page):
        return None, page
    number = lambda name: held[name].fill_null(0).to_numpy(zero_copy_only=False)
    placed = {c: number(c) for c in ("pos", "block", "par", "line", "left", "top", "height")}
    table = pa.table({"text": held["text"].fill_null("")} | placed | {"right": placed["left"] + number("width"), "bottom": placed["top"] + placed["height"]})
    starts = np.diff(page, prepend=-1) != 0
    on = pa.array(page[starts])
    of = pa.array(row[page[starts]])
    years = rows.column("year").take(of).to_pylist() if "year" in rows.schema.names else [None] * len(of)
    told = Pages(np.cumsum(starts) - 1, rows.column("doc_id").take(of).to_pylist(), rows.column("page").flatten().take(on).to_pylist(), years)
    lot, before = Lot(table, told), np.cumsum(of_page) - of_page
    #: Words of its document before each page.
    lot.before = (before - before[np.searchsorted(row, row)])[page[starts]] if len(row) else before
    return lot, row[page[starts]]


def runs_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def joined(texts: pa.Array, starts: np.ndarray, between: str) -> pa.Array:
    """Runs of texts, each from a start to the next, as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts), between)


def band_rows(lot: Lot) -> tuple[np.ndarray, pa.StructArray]:
    """The bands of all pages at once, as bands_of_pages tells them: each page's first one (and the end), and box and text of each."""
    slot = lot.slots()
    by_slot = np.lexsort((lot.line, slot, lot.page))
    page, slot, line = (a[by_slot] for a in (lot.page, slot, lot.line))
    new_band = (np.diff(page, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0)
    new_line = new_band | (np.diff(line, prepend=-1) != 0)
    lines, bands = np.flatnonzero(new_line), np.flatnonzero(new_band)
    line_of, band_of = np.cumsum(new_line) - 1, np.cumsum(new_band) - 1
    left, top, right, bottom = (a[by_slot] for a in (lot.left, lot.top, lot.right, lot.bottom))
    band_left, line_top = np.minimum.reduceat(left, bands), np.minimum.reduceat(top, lines)
    # Bands by left edge, their lines by top and left, words by left.
    order = np.lexsort((line_of, lot.row[by_slot], left[lines][line_of], line_top[line_of], band_of, band_left[band_of], page))
    line_start = np.append(np.flatnonzero(np.diff(line_of[order], prepend=-1)), len(order))
    by_band = band_of[order]
    band_start = np.flatnonzero(np.diff(by_band, prepend=-1))
    told = by_band[band_start]
    texts = joined(pa.array(lot.texts, pa.string()).take(pa.array(lot.code[by_slot][order])), line_start, " ")
    texts = [t.strip() for t in joined(texts, np.searchsorted(line_start, np.append(band_start, len(order))), "\n").to_pylist()]
    box = [band_left, np.minimum.reduceat(top, bands), np.maximum.reduceat(right, bands), np.maximum.reduceat(bottom, bands)]
    rows = pa.StructArray.from_arrays([*[pa.array(b[told], pa.int32()) for b in box], pa.array(texts, pa.string())], ["left", "top", "right", "bottom", "text"])
    return np.searchsorted(page[bands][told], np.arange(len(lot.doc_ids) + 1)), rows


def line_rows(lot: Lot) -> dict[str, np.ndarray | pa.Array]:
    """The lines of all pages, by page and first word: page (in the lot), block, par, line, row, text and box."""
    begin = lot.line_start[:-1]
    least, most = (lambda a: np.minimum.reduceat(a, begin)), (lambda a: np.maximum.reduceat(a, begin))
    texts = joined(pa.array(lot.texts, pa.string()).take(pa.array(lot.code)), lot.line_start, " ")
    return {"at": lot.page[begin], **{k: v[begin] for k, v in lot.place.items()}, "row": lot.row[begin], "text": texts, "left": least(lot.left), "top": least(lot.top), "right": most(lot.right), "bottom": most(lot.bottom)}


def cluster_rows(lot: Lot) -> dict[str, np.ndarray | pa.Array]:
    """The numeric clusters of all pages: page (in the lot), cluster (from 1), text, left and right.

    A number-like word starts a new one after another kind of word, a wide gap, or in another row."""
    order = np.lexsort((lot.id, lot.left, lot.top, lot.page))
    page, left, right, top, height = (a[order] for a in (lot.page, lot.left, lot.right, lot.top, lot.height))
    numeric = np.fromiter([bool(NUMERIC.search(t)) for t in lot.texts], bool, len(lot.texts))[lot.code[order]]
    high = np.maximum(height[1:], height[:-1])
    apart = (left[1:] - right[:-1] > np.maximum(15, np.floor(np.maximum(high, 1) * 1.5).astype(np.int64))) | (np.abs(np.diff(top)) > high)
    new = numeric.copy()
    new[1:] &= ~numeric[:-1] | (np.diff(page) != 0) | apart
    at = np.flatnonzero(numeric)
    start = np.flatnonzero(new[at])
    clean = pa.array([t.strip() for t in lot.texts], pa.string()).take(pa.array(lot.code[order][at]))
    on = page[at][start]
    number = np.arange(len(start)) - np.searchsorted(on, on) + 1
    low, far = (np.minimum.reduceat(left[at], start), np.maximum.reduceat(right[at], start)) if len(start) else (start, start)
    return {"at": on, "cluster": number, "text": joined(clean, np.append(start, len(at)), " "), "left": low, "right": far}


def as_batch(lot: Lot, rows: dict[str, np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of the pages of a lot, with id and number of their page."""
    at = pa.array(rows["at"])
    told = rows | {"doc_id": pa.array(lot.doc_ids, pa.string()).take(at), "page": pa.array(lot.page_numbers, pa.int32()).take(at)}
    return pa.RecordBatch.from_arrays([told[f.name].cast(f.type) if isinstance(told[f.name], pa.Array) else pa.array(told[f.name], f.type) for f in schema], schema=schema)
