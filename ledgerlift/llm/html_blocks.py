"""Main text of web pages by two passes of block rules.

A page is cut at block tags. What markup names as something else than the article (menus, headers and footers of the page,
sidebars, forms, adverts, notices, reader comments, scripts, styles) is left out; the other blocks are classified:

1. Each block alone: with many words in links it is bad; a block too short to tell is ambiguous; of the others, stop-word
   density and length make it good, nearly good, or bad.
2. Ambiguous and nearly good blocks inherit the label of the nearest decided block, of the better one if two are equally
   near; nearly good ones become good if there is none.

Where markup names the article itself (article, main), only blocks inside count once any of them is good or open to be, and
few stop words make a block there ambiguous rather than bad: tables and lists of an article read like that. If nothing
is decided inside, what is not bad is good.

The work on a page is in proportion to its length. Defined results: null and empty html give an empty text; rows map one to one,
repeated ones too; unclosed tags and comments end where an outer one does or the page ends; two line breaks in a row end a block; all Unicode
white space counts as such; only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import portions

#: Function words of English, German, French and Spanish; the caller may pass others.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so
    some than that the their them there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur
    oder sich sie sind so über um und von vor war was wie wir zu zum zur
    au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous
    al como con del el ella en era es esta este fue ha la las lo los más me muy no para pero por que se si sin su sus también un una y ya""".split()
)


class Rules(NamedTuple):
    """Thresholds: shares of link characters and of stop words, lengths in characters."""

    most_links: float = 0.5
    few_links: float = 0.2
    short: int = 70
    long: int = 200
    some_stop_words: float = 0.12
    many_stop_words: float = 0.2


RAW = frozenset(["script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "select", "object", "canvas", "audio", "video"])
#: Tags that are never part of an article, and those that are not outside of one.
LEFT_OUT, OUTSIDE = frozenset(["nav", "footer", "aside", "form", "button", "dialog", "menu", "head"]), frozenset(["header"])
ARTICLE = frozenset(["article", "main"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img""".split()
)
#: Parts of classes, ids and roles: of what is never an article's text, and of what lies around articles and may hold one.
FOREIGN = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices alert popup
    modal newsletter subscribe subscription signup login share sharing social related recommended alertdialog dialog hidden""".split()
)
AROUND = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner complementary contentinfo search toolbar pagination pager widget widgets copyright""".split()
)
P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
PARTS = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")


class Block(NamedTuple):
    text: str
    links: int
    article: bool


class Open(NamedTuple):
    """An open element: whether its text is left out (0: no, 1: as something around articles, 2: for good), and whether an article has begun."""

    name: str
    out: int
    article: bool
    link: bool


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name, attributes) of each tag, in order; a closing tag's name begins with a slash; at last (text, '', '')."""
    at, begin, size = 0, 0, len(html)
    lower = html.lower()
    lower = lower if len(lower) == size else html  # some letters are longer in lower case
    pieces: list[str] = []
    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            pieces.append(html[begin:lt])
            at = begin = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            pieces.append(html[begin:lt])
            at = begin = size if end < 0 else end + 1
            continue
        name = NAME.match(html, lt + 1)
        if not name:
            at = lt + 1
            continue
        end = tag_end(html, name.end())
        pieces.append(html[begin:lt])
        if end < 0:  # a tag that the page's end cuts off
            begin = size
            break
        told = name.group().lower()
        yield "".join(pieces), told, html[name.end() : end]
        pieces, at = [], end + 1
        if told in RAW:
            close = lower.find(f"</{told}", at)
            at = size if close < 0 else close
        begin = at
    pieces.append(html[begin:])
    yield "".join(pieces), "", ""


def tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag, quoted values skipped; -1 if there is none."""
    while True:
        end = html.find(">", at)
        if end < 0:
            return -1
        quote = QUOTE.search(html, at, end)
        if not quote:
            return end
        at = html.find(quote.group(1), quote.end()) + 1
        if not at:  # a quote that nothing closes is none
            return end


QUOTE = re.compile(r"""=\s*(["'])""")


def hints(given: str) -> frozenset[str]:
    """The parts of an element's class, id and role; `hidden` where it is not shown."""
    found: set[str] = set()
    for key, *values in ATTRIBUTE.findall(given):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role", "itemprop"):
            found.update(PARTS.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            found.add("hidden")
    return frozenset(found)


def opened(name: str, given: str, over: Open) -> Open:
    """The element that a tag opens inside of another."""
    told = hints(given) if given and name not in ("html", "body") else frozenset()
    article = name in ARTICLE or name in ("div", "section") and ("articlebody" in told or "main" in told and not AROUND & told)
    if over.out == 2 or name in LEFT_OUT or FOREIGN & told:
        return Open(name, 2, over.article, over.link)
    if article:
        return Open(name, 0, True, over.link)
    around = not over.article and (name in OUTSIDE or AROUND & told) or over.article and AROUND & told and name not in ("header", "h1", "h2", "h3", "p", "div", "section")
    return Open(name, 1 if around or over.out else 0, over.article, over.link or name == "a")


def blocks(html: str) -> list[Block]:
    """The blocks of a page that may be of its article, in order."""
    out: list[Block] = []
    stack = [Open("", 0, False, False)]
    words: list[str] = []
    links = breaks = 0
    article = False

    def ended() -> None:
        nonlocal links
        text = " ".join(references.unescape("".join(words)).split())
        if text:
            out.append(Block(text, links, article))
        words.clear()
        links = 0

    for text, name, given in tags(html):
        top = stack[-1]
        if text and not top.out:
            if not text.isspace():
                breaks = 0
                if not words:
                    article = top.article
                if top.link:
                    links += len(text.strip())
            words.append(text)
        bare = name.lstrip("/")
        if name == "br":
            breaks += 1
            words.append(" ")
            if breaks == 2:
                ended()
            continue
        if bare not in INLINE:
            ended()
            breaks = 0
        if not name or name in VOID:
            continue
        if name.startswith("/"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == bare:
                    del stack[i:]
                    break
                if bare in INLINE and stack[i].name not in INLINE:
                    break  # a stray closing tag of a word does not close blocks
        elif name not in RAW:
            if name in P_ENDS or name in ("li", "td", "tr", "dt", "dd"):
                close(stack, name)
            stack.append(opened(name, given, stack[-1]))
    ended()
    return out


def close(stack: list[Open], name: str) -> None:
    """End the elements that a block's tag ends unsaid: a paragraph, or the item or cell before; and inline ones inside."""
    ends = {"li": ("li",), "td": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, ("p",))
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in ends:
            del stack[i:]
            return
        if stack[i].name not in INLINE and stack[i].name != "p":
            return


GOOD, NEAR, OPEN, BAD = "good", "near", "open", "bad"


def alone(block: Block, rules: Rules, stop_words: frozenset[str]) -> str:
    """First pass: the label of a block by itself."""
    size = len(block.text)
    density = block.links / size
    if density > rules.most_links:
        return BAD
    if size < rules.short:
        return BAD if density > rules.few_links else OPEN
    words = WORD.findall(block.text.lower())
    stop = sum(w in stop_words for w in words) / max(len(words), 1)
    if stop >= rules.many_stop_words:
        return GOOD if size > rules.long and density <= rules.few_links else NEAR
    if stop >= rules.some_stop_words:
        return NEAR
    return OPEN if block.article else BAD


def in_context(labels: list[str], otherwise: str) -> list[str]:
    """Second pass: open and near blocks get the label of the nearest decided one; of two as near, the better one's."""
    decided = [label in (GOOD, BAD) for label in labels]
    before, last = [], None
    for i, label in enumerate(labels):
        last = i if decided[i] else last
        before.append(last)
    after, last = [], None
    for i in range(len(labels) - 1, -1, -1):
        last = i if decided[i] else last
        after.append(last)
    after.reverse()
    out = []
    for i, label in enumerate(labels):
        if decided[i]:
            out.append(label)
            continue
        near = [(abs(i - j), labels[j] != GOOD) for j in (before[i], after[i]) if j is not None]
        if label == NEAR and any(not bad for _, bad in near):
            out.append(GOOD)
        elif near:
            out.append(BAD if min(near)[1] else GOOD)
        else:
            out.append(GOOD if label == NEAR else otherwise)
    return out


def main_text(html: str | None, rules: Rules = Rules(), stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The text of a page's article: its blocks, parted by an empty line."""
    found = blocks(html or "")
    labels = [alone(b, rules, stop_words) for b in found]
    inside = [i for i, b in enumerate(found) if b.article]
    if any(labels[i] != BAD for i in inside):
        found, labels = [found[i] for i in inside], in_context([labels[i] for i in inside], GOOD)
    else:
        labels = in_context(labels, BAD)
    return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame, rules: Rules = Rules(), stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                texts = [main_text(h, rules, stop_words) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html")).mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
