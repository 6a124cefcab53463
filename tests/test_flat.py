"""Flat pages without Spark: lots of whole pages, bands and lines against plain loops, labels against their patterns."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from ledgerlift.functions.vocabulary import ROW_PATTERNS, ROW_SYNONYMS, YEAR_PATTERNS
from ledgerlift.operators import extract
from ledgerlift.operators.columns import Carried
from ledgerlift.operators.flat import Lot, bands_of_pages, fold, lots, token
from ledgerlift.operators.labels import Labels, labels_of, parts

NAMES = ["doc_id", "page", "pos", "text", "block", "par", "line", "left", "top", "right", "bottom", "height", "year"]
KEYS = ("bs_assets", "bs_capital_aop0401", "bs_loss", "bu_revenue")


def random_words(seed: int, docs: int = 40) -> list[tuple]:
    dice = random.Random(seed)
    texts = ["a", "bb", "12", "3.4", "Пословни", "приходи", "текућа", "година", "2042", "АОП"]
    rows = []
    for doc in range(docs):
        for page in range(1, dice.randrange(2, 5)):
            for pos in range(dice.randrange(1, 40)):
                left, top = dice.randrange(600), dice.randrange(300)
                rows.append((f"d{doc:03d}", page, pos, dice.choice(texts), dice.randrange(2), 1, dice.randrange(6), left, top, left + dice.randrange(1, 80), top + 18, dice.randrange(30), 2042))
    return rows


def batches(rows: list[tuple], size: int) -> list[pa.RecordBatch]:
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(NAMES)})
    return table.to_batches(max_chunksize=size)


def plain_slots(words: list[tuple]) -> list[int]:
    bands: list[list[int]] = []
    out = []
    for left, right in words:
        for n, b in enumerate(bands):
            slack = max(12, min(max(right - left, b[1] - b[0], 1), 60))
            if right >= b[0] - slack and b[1] >= left - slack:
                b[0], b[1] = min(b[0], left), max(b[1], right)
                out.append(n)
                break
        else:
            bands.append([left, right])
            out.append(len(bands) - 1)
    return out


def test_lines_and_bands_against_plain_loops():
    rows = random_words(3)
    lot = Lot(pa.Table.from_batches(batches(rows, 1000)))
    slots, at = lot.slots().tolist(), 0
    for n, (doc, page) in enumerate(dict.fromkeys((r[0], r[1]) for r in rows)):
        own = [r for r in rows if r[:2] == (doc, page)]
        lines: dict[tuple, list] = {}
        for r in own:
            lines.setdefault(r[4:7], []).append(r)
        ordered = sorted(lines.values(), key=lambda line: min(r[2] for r in line))
        words = [r for line in ordered for r in sorted(line, key=lambda r: (r[7], r[2]))]
        assert (lot.doc_ids[n], lot.page_numbers[n]) == (doc, page) and lot.page_start[n + 1] - lot.page_start[n] == len(words)
        assert lot.held["id"][at : at + len(words)] == [r[2] for r in words] and lot.word_texts[at : at + len(words)] == [r[3] for r in words]
        assert slots[at : at + len(words)] == plain_slots([(r[7], r[9]) for r in words])
        at += len(words)
    bands = bands_of_pages(lot, [True] * len(lot.doc_ids))
    assert all(b.left <= c.left for own in bands.values() for b, c in zip(own, own[1:], strict=False))
    assert sum(len(b.words) for own in bands.values() for b in own) == len(rows) and all(len(b.in_order) == len(b.words) for own in bands.values() for b in own)


@pytest.mark.parametrize(("batch", "lot"), [(1, 1), (7, 20), (1000, 50), (3, 10**6)])
def test_lots_hold_whole_pages(batch, lot):
    """However words come in batches, pages are whole, and columns are carried from lot to lot."""
    rows = random_words(4)

    def read(size: int, most: int) -> list:
        carried, labels, out = Carried(), labels_of(KEYS), []
        for one in lots(iter(batches(rows, size)), most):
            for n, page, columns, codes in extract.pages_of_lot(one, carried, labels):
                out.append((one.doc_ids[n], one.page_numbers[n], page.end - page.first, columns, codes))
        return out

    assert read(batch, lot) == read(10**6, 10**6) and len(read(batch, lot)) == len({r[:2] for r in rows})
    assert list(lots(iter([]))) == []


def test_labels_against_their_patterns():
    """The automaton tells of every line what each spelling and pattern by itself does."""
    dice = random.Random(6)
    pieces = [p for k in ROW_PATTERNS for s in ROW_SYNONYMS[k] for p in s.split()] + ["A.", "АОП0401", "00401", "ПОСЛОВНИ", "Poslovni-", "kapital", "x", "-", "1001", "aop"]
    labels = Labels(KEYS)
    hits = 0
    for _ in range(3000):
        plain = dice.choice([" ", "  ", "-"]).join(dice.choice(pieces) for _ in range(dice.randrange(1, 6))).strip()
        plain = plain.upper() if dice.random() < 0.3 else plain
        matched, _ = labels.found(plain, fold(plain))
        for key in labels.patterns:
            low, folded = plain.lower(), fold(plain)
            want = any(fold(s.lower()).lower() in folded.lower() or (key in KEYS and s.lower() in low) for s in ROW_SYNONYMS[key])
            want = want or any(re.search(ROW_PATTERNS[key], t, re.IGNORECASE) for t in (plain, folded))
            assert (key in matched) == want, (key, plain)
            hits += want
    assert hits > 1000 and Labels(()).found("Пословни приходи", "") == (set(), set())


def test_parts_are_in_every_match():
    for pattern in [*ROW_PATTERNS.values(), *YEAR_PATTERNS.values()]:
        assert parts(pattern)
    for key, spelt in ROW_SYNONYMS.items():
        for s in spelt:
            if re.search(ROW_PATTERNS[key], s, re.IGNORECASE):
                assert any(p in s.lower() for p in parts(ROW_PATTERNS[key]))


def test_tokens():
    assert [token(t) for t in ("AОP.", "Tekuća", "12-34", "", "²x", "година")] == ["аор", "тек" + "uć" + "а", "1234", "", "²х", "година"]
