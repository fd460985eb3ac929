"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks. Elements that never hold main text (menus, forms, scripts, reader comments and the
like, by tag or by a whole class or id) are left out, but for an article or main element in one with such a class or
id (other than of comments and related pages, which hold articles of their own).

Pass one classifies each block by stop-word density, length and link density as main text, boilerplate or, where it
is short or has few stop words, ambiguous. Where a fair share of the main text that it found stands in the page's
``article`` (else ``main``) elements, these are the main text's section and what is outside them is boilerplate; teasers beside a
longer text elsewhere are no section.

Pass two gives ambiguous blocks the label of their nearest decided neighbours in the same section: a heading that of
the text under it, other blocks that of the nearer neighbour. Elements left out count as boilerplate neighbours of
blocks that are no paragraphs, list items or the like. Inside an article a class or id that may as well name a part of
it (related, skip) is a prior only: its long text stays, its ambiguous blocks go. A page whose words are of no known
language is classified by length and links alone. Where neighbours at one distance differ, such blocks are
boilerplate outside a section, and all others are main text; blocks without decided neighbours are kept.

Work is per page and Spark spreads the pages; nothing is shuffled. Defined cases: null and empty pages have
the empty text; unclosed elements end with their parent; a page may be nested and long at will; tags are read as HTML
reads them (a quote begins a value only after an equals sign). Reading takes time in proportion to the page, whatever
it holds: after ``TRIES`` tags that never end, tags end at the next angle bracket, quoted or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Frequent function words of the languages supported.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other some could time these two may then do first any my now such like our over me even most made after also did many must before through back years where much your way well down should because each just those people how too little state good very make world still see own men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three de des les est un une du que qui dans au pas pour sur en par avec plus ne se ce il elle et la le der die das und ist den von zu mit im für auf sich nicht ein eine als auch dem es el los las y una por con para del lo su al como".split()
)
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer form head title button select option dialog menu object audio video canvas label".split())
_REPLIES = r"comments?|commentlist|disqus|related|recommend[a-z\d]*|replies|respond"
#: A whole class or id: a hint, at most with a word for its place before it and one for a container after it. Other
#: compounds (has-sidebar, with-comments, page-with-ads) tell of a page's layout.
_NAME = r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|reader|user|post|article|entry)[_-])?(?:{0})(?:[_-](?:{0}|bar|box|list|item|section|area|block|buttons?|links?|container|wrapper|body|form|\d+))*"
_HINT = re.compile(
    _NAME.format(
        rf"{_REPLIES}|ads?|advert[a-z\d]*|banner|breadcrumbs?|consent|cookies?|foot(?:er)?|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo[a-z\d]*|share|sharing|sidebar|skip|social|sponsor[a-z\d]*|subscribe|toolbar|widget"
    ),
    re.I,
)
#: Hints of elements that hold articles of their own, which are no main text either.
_REPLY = re.compile(_NAME.format(_REPLIES), re.I)
_ARTICLE = re.compile(_NAME.format("comments?|related|promo"), re.I)
#: A name and its value; as in HTML, a quote that does not follow an equals sign is part of a name.
_PAIR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|(?=>)))?+"""
#: Inside an article, a prior only.
_PRIOR = re.compile(_NAME.format(r"related|recommend[a-z\d]*|respond|skip"), re.I)
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|textarea|math)\b", re.I)
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]|{_PAIR})*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style noscript template svg iframe textarea math".split()}
#: Tags without an end in a page until tags are read more simply.
TRIES = 64
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+)))?+""")
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

_LEGAL = re.compile(r"©|\(c\)\s*\d|\bcopyright\b|\ball rights reserved\b", re.I)

#: Elements whose short text is likelier a part of its surroundings than a bare one's.
_TEXTUAL = frozenset("p li dd dt blockquote pre figcaption td th address summary".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

LONG, STOPS, LINKS = 70, 0.2, 0.5
#: A section holds at least one part in so many of the main text that the first pass found.
SHARE = 4


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """First and end character, name, whether it closes and attributes of each tag; name is empty for what holds no text."""
    at, last, tries = 0, html.rfind(">"), 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = _COMMENT.match(html, at).end()
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:  # no tag ends any more, but comments may follow
            at = html.find("<!--", at + 1)
            if at < 0:
                return
            continue
        raw = _RAW.match(html, at)
        if raw:
            end, name = html.index(">", at) + 1, raw[1].lower()
            if not (name in ("svg", "math") and html[end - 2] == "/"):
                closer = _CLOSERS[name].search(html, end)
                end = html.find(">", closer.end()) + 1 if closer else 0
            yield at, end or len(html), "", False, ""
            at = end or len(html)
            continue
        if html[at + 1 : at + 2] in ("!", "?") or (html.startswith("</", at) and not html[at + 2 : at + 3].isalpha()):
            end = html.index(">", at) + 1
            if end > at + 3:
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        m = (_TAG if tries < TRIES else _PLAIN_TAG).match(html, at)
        if m:
            yield at, m.end(), m[2].lower(), bool(m[1]), m[3]
            at = m.end()
        else:
            tries += html[at + 1 : at + 2].isalpha() or html.startswith("</", at)
            at += 1


def _left_out(name: str, attributes: str, in_article: bool) -> int:
    """0 not left out, 1 left out but for an article or main element in it, 2 left out with all in it; -1: a doubt only."""
    if name in _NEVER or (name == "header" and not in_article):
        return 2
    found = doubt = 0
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "hidden":
            return 2
        if what in ("class", "id") and name not in ("html", "body", "article", "main"):
            for token in value.split():
                if in_article and _PRIOR.fullmatch(token):
                    doubt = -1
                elif _HINT.fullmatch(token):
                    found = max(found, 2 if _REPLY.fullmatch(token) else 1)
        if what == "class" and name == "article" and any(_ARTICLE.fullmatch(token) for token in value.split()):
            return 2
        if what == "role" and value.lower() in _ROLE:
            return 2
        if what == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
    return found or doubt


class Block(NamedTuple):
    """text (None: elements left out here), characters in links, innermost element, and whether in an article, in main, in doubt."""

    text: str | None
    linked: int
    name: str
    in_article: bool
    in_main: bool
    doubted: bool = False


class _Open(NamedTuple):
    name: str
    gone: int  # see _left_out
    in_article: bool
    in_main: bool
    doubted: bool = False


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, and one without text for elements left out between them."""
    out: list[Block] = []
    top = _Open("", 0, False, False)
    open_: list[_Open] = [top]
    parts: list[str] = []
    linked, anchor, skipped, at = 0, 0, False, 0  # anchor: depth at which a link was opened, 0 for none

    def flush() -> None:
        nonlocal linked, skipped
        text, own = " ".join("".join(parts).split()), open_[-1]
        if text:
            out.append(Block(text, linked, own.name, own.in_article, own.in_main, own.doubted))
        if skipped:
            out.append(Block(None, 0, own.name, own.in_article, own.in_main))
        parts.clear()
        linked, skipped = 0, False

    def add(text: str) -> None:
        nonlocal linked, skipped
        own = open_[-1]
        if own.gone:
            skipped = skipped or (own.name not in ("head", "title") and own.name in _BLOCK | _NEVER and not text.isspace() and text != "")
        elif text:
            text = unescape(text)
            parts.append(text)
            if anchor:
                linked += len("".join(text.split()))

    held: dict[str, list[int]] = {}  # places of the open elements of each name, and of blocks
    bounds: list[int] = []

    def close(to: int) -> None:
        while len(open_) > to:
            own = open_.pop()
            held[own.name].pop()
            if own.name in _BLOCK:
                bounds.pop()

    for begin, end, name, closes, attributes in tags(html):
        add(html[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            anchor = 0 if closes or not attributes or not any(p[1].lower() == "href" for p in _ATTRIBUTE.finditer(attributes)) else len(open_)
        if name in _BLOCK:
            flush()
            if not closes and open_[-1].name == "p":
                close(len(open_) - 1)
        if closes:
            # an inline end tag closes nothing beyond its block
            if held.get(name) and (name in _BLOCK or not bounds or held[name][-1] > bounds[-1]):
                close(held[name][-1])
        elif name not in _VOID and not (attributes and attributes.rstrip().endswith("/")):
            up = open_[-1]
            own = _left_out(name, attributes, up.in_article or up.in_main) if attributes or name in _BLOCK or name in _NEVER else 0
            if name in _BLOCK or name in _NEVER or own:
                gone = up.gone
                if gone == 1 and name in ("article", "main") and not held.get("article"):
                    gone = 0
                held.setdefault(name, []).append(len(open_))
                if name in _BLOCK:
                    bounds.append(len(open_))
                open_.append(_Open(name, max(gone, own), up.in_article or name == "article", up.in_main or name == "main", up.doubted or own < 0))
        if len(open_) < anchor:  # a link ends with the element that it was opened in
            anchor = 0
    add(html[at:])
    flush()
    return out


def first_pass(block: Block, in_section: bool, known: bool = True) -> int:
    """1 main text, -1 boilerplate, 0 ambiguous; known: the page is in a language whose stop words are listed."""
    if block.text is None:
        return 0
    label = _density(block, in_section, known)
    return -1 if block.doubted and not label and block.name not in _HEADING else label


def _density(block: Block, in_section: bool, known: bool) -> int:
    solid = len(block.text.replace(" ", "")) or 1
    if block.linked / solid > LINKS:
        return -1
    if not in_section and block.name not in _TEXTUAL and len(block.text) < 2 * LONG and _LEGAL.search(block.text):
        return -1
    if not known:
        return int(len(block.text) >= LONG)
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(block.text) >= LONG and stops >= STOPS:
        return 1
    if len(block.text) >= LONG and not in_section and block.name not in _TEXTUAL and stops < STOPS / 2:
        return -1
    return 0


def section(found: list[Block], labels: list[int]) -> list[bool]:
    """Whether each block is in the elements, articles or else main, that hold a share of the main text found; nowhere if none does."""
    weigh = lambda keep: sum(len(b.text or "") for b, label in zip(found, labels) if label > 0 and keep(b))
    article, main, every = weigh(lambda b: b.in_article), weigh(lambda b: b.in_article or b.in_main), weigh(lambda b: True)
    if SHARE * main >= every and any(b.text and (b.in_article or b.in_main) for b in found):
        if SHARE * article >= main and any(b.text and b.in_article for b in found):
            return [b.in_article for b in found]
        return [b.in_article or b.in_main for b in found]
    return [False] * len(found)


def _nearest(labels: list[int]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Distance and label of the nearest decided neighbour before and after each block; label 0 if there is none."""
    n = len(labels)
    out = []
    for step in (range(n), range(n - 1, -1, -1)):
        near, far, label = [(n, 0)] * n, n + 1, 0
        for i in step:
            far += 1
            near[i] = (far, label)
            if labels[i]:
                far, label = 0, labels[i]
        out.append(near)
    return list(zip(*out))


def second_pass(found: list[Block], labels: list[int], in_section: bool) -> list[int]:
    """labels of the blocks of one section with those of decided neighbours for 0."""
    out = list(labels)
    with_gaps = _nearest([label if b.text is not None else -1 for b, label in zip(found, labels)])
    without = _nearest(labels)
    for i, b in enumerate(found):
        if labels[i] or b.text is None or b.name in _HEADING:
            continue
        textual = b.name in _TEXTUAL
        (d, x), (e, y) = (without if textual or in_section else with_gaps)[i]
        nearer = x if not y or (x and d < e) else y if not x or e < d else x if x == y else (1 if textual or in_section else -1)
        out[i] = nearer or 1
    below: dict[int, int] = {}  # of each rank, the label of the text under a heading of it
    near = _nearest(out)
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.text is not None and b.name in _HEADING:
            rank = int(b.name[1])
            if not out[i]:
                (_, x), (_, y) = near[i]
                out[i] = below.get(rank) or y or x or 1
            for r in range(rank, 7):
                below[r] = 0
            for r in range(1, rank):
                below[r] = max(below.get(r, 0) or -2, out[i])
        else:
            own = out[i] if b.text is not None else -1
            for r in range(1, 7):
                below[r] = max(below.get(r, 0) or -2, own)
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text, in page order, joined by an empty line."""
    found = blocks(html or "")
    labels = [first_pass(b, b.in_article or b.in_main) for b in found]
    known = 1 in labels
    inside = section(found, labels if known else [first_pass(b, b.in_article or b.in_main, False) for b in found])
    label = [0] * len(found)
    for own in (True, False):
        at = [i for i, here in enumerate(inside) if here == own]
        part = [found[i] for i in at]
        if not own and any(inside):
            break
        for i, x in zip(at, second_pass(part, [first_pass(b, own, known) for b in part], own)):
            label[i] = x
    return "\n\n".join(b.text for b, x in zip(found, label) if b.text is not None and x > 0)


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_RESULT)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; pages needs page_id bigint, url and html."""
    common.prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
