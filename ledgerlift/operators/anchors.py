"""Anchors: the lines, vertical bands or row-code neighbourhoods in which a row's label stands on a page."""

from __future__ import annotations

from typing import NamedTuple

from .columns import PARTIAL
from .flat import Band, Lot, fold
from .labels import Labels


class Anchor(NamedTuple):
    tier: int
    ord: int
    words: list[int]
    text: str
    left: int
    top: int
    right: int
    bottom: int
    fallback: bool


class Page:
    """One page of a lot with what its lines can hold."""

    def __init__(self, lot: Lot, number: int, bands: list[Band], told: list[tuple[set[str], set[str]]]):
        """told: of each line of the page, the labels in it and the possible ones."""
        self.lot, self.number, self.bands, self.told = lot, number, bands, told
        self.first, self.end = int(lot.page_line[number]), int(lot.page_line[number + 1])

    def words(self, line: int) -> range:
        """The words of a line of the lot."""
        return range(self.lot.starts[line], self.lot.starts[line + 1])

    def near(self, top: int, bottom: int) -> list[int]:
        """The words of all lines that reach into a stretch of the page."""
        tops, bottoms = self.lot.line_top, self.lot.line_bottom
        return [w for line in range(self.first, self.end) if bottoms[line] >= top and tops[line] <= bottom for w in self.words(line)]

    def anchor(self, tier: int, order: int, words: list[int], fallback: bool) -> Anchor:
        held = self.lot.held
        text = " ".join(self.lot.word_texts[w] for w in words).strip()
        left, top, right, bottom = ([held[c][w] for w in words] for c in ("left", "top", "right", "bottom"))
        box = min(left), min(top), max(right), max(bottom)
        return Anchor(tier, order, words, text, *box, fallback)

    def by_place(self, words: list[int]) -> list[int]:
        """Words by top and left; ties keep their order."""
        top, left = self.lot.held["top"], self.lot.held["left"]
        return [w for _, _, _, w in sorted([(top[w], left[w], i, w) for i, w in enumerate(words)])]


def in_lines(page: Page, key: str) -> list[tuple[int, Anchor]]:
    """First tier: the lines that hold the label; with the rows of the lines."""
    held = [i for i, (matched, _) in enumerate(page.told) if key in matched]
    return [(page.lot.held["row"][page.words(page.first + i)[0]], page.anchor(1, i, list(page.words(page.first + i)), False)) for i in held]


def in_bands(page: Page, used: list[int], key: str, labels: Labels) -> list[Anchor]:
    """Second tier: bands that spell the label over several lines, unless one of their lines has been used."""
    found: list[Anchor] = []
    if not any(key in possible for _, possible in page.told):
        return found
    taken = set(used)
    row, starts = page.lot.held["row"], page.lot.starts
    lines = {row[starts[line]]: line for line in reversed(range(page.first, page.end))}
    for band in page.bands:
        if not band.kinds & PARTIAL or any([row[w] in taken for w in band.words]):
            continue
        if band.text and taken.isdisjoint(band.rows) and labels.patterns[key].search(fold(band.text)):
            taken.update(band.rows)
            words = [w for r in band.rows for w in page.words(lines[r])]
            found.append(page.anchor(2, len(found), page.by_place(words), False))
    return found


def by_code(page: Page, code: str) -> list[Anchor]:
    """Third tier: lines with the row's code, each with the words above and below it within reach."""
    held, found = page.lot.held, []
    seen: set[tuple[int, ...]] = set()
    order = -1
    for i, (matched, _) in enumerate(page.told):
        if code not in matched:
            continue
        line = page.first + i
        tall = max((h for h in (held["height"][w] for w in page.words(line)) if h), default=20)
        reach = max(30, int(tall * 2.5))
        top, bottom = page.lot.line_top[line] - reach, page.lot.line_bottom[line] + reach
        words = [w for w in page.near(top, bottom) if held["bottom"][w] >= top and held["top"][w] <= bottom]
        if words:
            order += 1
            key = tuple(sorted(held["id"][w] for w in words))
            if key not in seen:
                seen.add(key)
                found.append(page.anchor(3, order, page.by_place(words), True))
    return found


def anchors_of(page: Page, key: str, labels: Labels) -> list[Anchor]:
    """All anchors of a label on a page, in order: lines, then bands, and only if there is neither, codes."""
    held = in_lines(page, key)
    found = [a for _, a in held] + in_bands(page, [row for row, _ in held], key, labels)
    return found or (by_code(page, f"{key}_aop") if f"{key}_aop" in labels.patterns else [])
