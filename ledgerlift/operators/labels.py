"""Which labels can stand in a line: one automaton over all spellings, codes and parts of patterns, run once over each line."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick

from ..functions.vocabulary import ROW_PATTERNS, ROW_SYNONYMS
from .flat import fold

#: Between the two forms of a line; no spelling holds it.
BETWEEN = "\x00"


def parts(pattern: str) -> list[str]:
    """The runs of three and more letters or digits in a pattern: a text that holds none of them, in small letters, does not match.

    It holds for patterns of which every alternative has such a run outside of optional groups and sets, as all of the vocabulary do."""
    return [r.lower() for r in re.findall(r"\w{3,}", re.sub(r"\[[^\]]*\]|\\.", " ", pattern))]


class Labels:
    """The labels of some anchors, and of their codes: found in the lines of pages."""

    def __init__(self, keys: Iterable[str]):
        """keys of ROW_PATTERNS; the code of a key is looked for too, where it has one."""
        self.keys = tuple(keys)
        every = [*self.keys, *(f"{k}_aop" for k in self.keys if f"{k}_aop" in ROW_PATTERNS)]
        self.patterns = {k: re.compile(ROW_PATTERNS[k], re.IGNORECASE) for k in every}
        every_part = {x for k in self.keys for x in parts(ROW_PATTERNS[k])}
        #: Finds a part of a label's pattern in a word, folded and in small letters.
        self.part = re.compile("|".join(map(re.escape, sorted(every_part))) or r"(?!)")
        # What is found in the line as it is, what in the line in one script; and parts of patterns, in either.
        plain: dict[str, set[str]] = {}
        folded: dict[str, set[str]] = {}
        either: dict[str, set[str]] = {}
        for key in every:
            for s in ROW_SYNONYMS[key]:
                folded.setdefault(fold(s.lower()).lower(), set()).add(key)
                if key in self.keys:
                    plain.setdefault(s.lower(), set()).add(key)
            for part in parts(ROW_PATTERNS[key]):
                either.setdefault(part, set()).add(key)
        #: Finds the digits of a label in a number: anywhere, but where a spelling has them between other signs as a run of their own.
        runs = {(r.group() if r.start() == 0 or r.end() == len(t) else rf"(?:^|[^0-9]){r.group()}(?:[^0-9]|$)") for t in {*plain, *folded, *either} for r in re.finditer("[0-9]+", t)}
        self.digits = "|".join(sorted(runs)) or r"[^\s\S]"
        self.automaton = ahocorasick.Automaton()
        none: frozenset[str] = frozenset()
        for text in {*plain, *folded, *either}:
            self.automaton.add_word(text, (len(text), *(frozenset(d.get(text, none)) for d in (plain, folded, either))))
        if self.keys:
            self.automaton.make_automaton()

    def found(self, plain: str, folded: str) -> tuple[set[str], set[str]]:
        """Of a stripped line, as it is and in one script: the labels that stand in it, and those of which a part does."""
        if not self.keys:
            return set(), set()
        low = plain.lower()
        matched: set[str] = set()
        possible: set[str] = set()
        for end, (size, in_plain, in_folded, in_either) in self.automaton.iter(low + BETWEEN + folded.lower()):
            if end < len(low):
                matched |= in_plain
            elif end - size >= len(low):
                matched |= in_folded
            possible |= in_either
        for key in possible - matched:
            if self.patterns[key].search(folded) or self.patterns[key].search(plain):
                matched.add(key)
        return matched, possible


@lru_cache(maxsize=16)
def labels_of(keys: tuple[str, ...]) -> Labels:
    """Built once in a worker, from the vocabulary alone."""
    return Labels(keys)
