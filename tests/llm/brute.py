"""Plain versions of the operators, for small tables, and the rows that tests feed to both."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, size long, row string, class string, best string, x long, bucket int"

BASE = " ".join(f"word{i % 61}x{i}" for i in range(120))
TEXTS = [
    None, "", " \t\n", "one", "one two three", "ONE two\tthree", BASE, BASE.upper().lower(), BASE.replace("word3x3", "changed"), BASE + " tail end",
    BASE.replace("word7x7", "a b"), "line a b c d e f g\nother line here now and then\nline a b c d e f g", "line a b c d e f g", "line A b c d e f g\n\n", "é\u00a0ü naïve 漢字 🙂",
    "x" * 50_000, ("long text of many words " * 4000), BASE[: len(BASE) // 2], "one  two three ", None,
]


def rows(texts: list[str | None] = TEXTS) -> list[tuple]:
    """Documents of several sources, one null; a repeated row; extra columns whose names the operators use inside."""
    sources = ["web", "web", "web", "books", None, "code"]
    out = [(i, t, ["en", "de", None][i % 3], sources[i % 6], 1, 2, "r", "c", "b", 3, 4) for i, t in enumerate(texts)]
    return out + [out[6]]


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def shingles(text: str | None) -> set[tuple]:
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def alike(a: set, b: set, percent: int) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def components(docs: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    """The smallest doc_id that each doc_id reaches."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and alike(sets[i], sets[j], percent):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def bare(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def winners(docs: list[tuple[int, str | None]]) -> dict[str, int]:
    """Of each normalised text the doc_id that stays."""
    best: dict[str, tuple] = {}
    for i, t in docs:
        best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t or ""), i))
    return {k: v[1] for k, v in best.items()}
