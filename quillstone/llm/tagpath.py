"""Main text of HTML pages by tag-path ratios.

A tolerant tokenizer turns a page into text blocks, each with its root-to-leaf path of block tags (with their
class names). Text length, punctuation and link share are aggregated per path; the ratios are laid along the
page, smoothed with a Gaussian, fused by their product and cut at a share of the largest. The paths that pass
select the content nodes. From the root, the region of the text is the deepest element that still holds nearly all of
what they weigh; its blocks are the text. (After Wu et al., "Web news extraction via tag path feature fusion".)

Tags, roles and names of elements are features of the ratios, not decisions of their own: article and main
elements weigh more; navigation, footers, asides, forms and what is named like adverts, notices or comments has its paths
left out of the ratios and its blocks out of the region, but a form or a name that holds nearly all text of the page
means nothing and is overruled, and inside an article sections, paragraphs, headings and fieldsets may have names that are words of
prose. Lists of links are left out by their link share, whatever their names. A link is an anchor with an address and
ends where a block begins or ends. A page that has text outside navigation, footers and the like always gives some.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of tags and the names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|textarea|iframe|title"
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th option wbr hr img".split())
STRONG = frozenset("head nav footer aside menu search".split())
WEAK = frozenset("form dialog fieldset audio video map template svg math object canvas".split())
CONTROLS = frozenset("button label select output progress meter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation "
    "navigator breadcrumb breadcrumbs topbar toolbar header masthead footer foot bottombar copyright legal comment comments commentlist disqus reply replies respond feedback "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "discussion discussions related recommended recommendations pager pagination widget widgets tags tagcloud skip hidden".split()
)
#: What names join to a mark without changing what it means.
JOINED = frozenset(
    "a area article articles bar block blog body bottom box button buttons card center col column container content div fixed form global group head holder icons inner item items "
    "left line link links list main mobile module outer page panel post posts primary right row secondary section site slot sticky story strip text the thread title top unit user wrap wrapper zone".split()
)
HEADS = frozenset({"header", "masthead", "head"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article's own text, and names that are no mark on them unless they are joined to another word.
PROSE = frozenset("p section blockquote pre figure fieldset li dl dt dd table tr td th".split()) | HEADINGS
PROSE_NAMES = frozenset("legal side related notice notices alert discussion discussions feedback copyright tags reply replies respond menu foot header banner hidden".split())
#: Text-level elements, below which no region starts.
LEAVES = frozenset("p li pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl dt dd table tbody thead tfoot tr td th figure figcaption address".split())
CLOSED_BY = {
    "p": frozenset(BLOCK - {"html", "body"}),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}), "option": frozenset({"option"}), "head": frozenset({"body"}),
}
LISTS = frozenset("ul ol dl table menu".split())
#: Text in these elements weighs more; the nearest one counts.
FAVOURED = (("article", 10.0), ("main", 3.0))
#: A share of text that is nearly none.
NEARLY_NONE = 0.1
DEEPEST = 512
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،؟।]")

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ADDRESS = re.compile(r"""(?<![\w-])href\s*=""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    parent: "Element | None"
    mark: int  # of its own: 2 for what is never text, 1 for what may be overruled
    depth: int


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int
    controls: int = 0


def marked_name(name: str, inside: bool) -> bool:
    """Whether a class name or id is a mark, alone or joined to words that leave its meaning; inside an article a header is its own."""
    pieces = [p.lower() for p in _PIECES.findall(name)]
    marks = [p for p in pieces if p in MARKS and not (inside and p in HEADS)]
    return bool(marks) and all(p in MARKS or p in JOINED or p.isdigit() for p in pieces) and not (inside and any(p in HEADS for p in pieces))


def _named(tag: str, more: str, inside: bool, in_article: bool = False) -> tuple[str, int]:
    """An element's first class name, and its mark by names, role or state."""
    prose = in_article and tag in PROSE
    first, mark = "", 0
    for name, value in _NAMED.findall(more):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            mark = max(mark, 2 * (value.lower() in ROLES))
        elif name == "hidden":
            mark = 2
        elif name == "aria-hidden":
            mark = max(mark, 2 * (value.lower() == "true"))
        else:
            if name == "class" and value.split():
                first = value.split()[0].lower()
            if not (name == "id" and tag in HEADINGS):
                mark = max(mark, int(any(marked_name(x, inside) and not (prose and x.lower() in PROSE_NAMES) for x in value.split())))
    return first, mark


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, empty ones left out."""
    found: list[Block] = []
    top = Element("", "", None, 0, 0)
    stack: list[tuple[str, Element]] = [("", top)]  # every open tag with its nearest block element
    pieces: list[str] = []
    linked, in_link, controls, in_control = 0, False, 0, 0
    beyond: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, controls, in_link
        in_link = False
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Block(stack[-1][1], text, min(linked, len(text)), min(controls, len(text))))
            pieces.clear()
            linked = controls = 0

    def close(upto: int) -> None:
        nonlocal in_link, in_control
        if any(tag in BLOCK or el is not stack[upto - 1][1] for tag, el in stack[upto:]):
            flush()
        in_link = in_link and not any(tag == "a" for tag, _ in stack[upto:])
        in_control -= sum(tag in CONTROLS for tag, _ in stack[upto:])
        del stack[upto:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
            if in_control:
                controls += len(piece.strip())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, more = tag.lower(), m["more"] or m["more2"] or ""
        if m["end"] or m["end2"]:
            if beyond.get(tag):
                beyond[tag] -= 1
                if tag in BLOCK:
                    flush()
            elif tag == "br":
                pieces.append(" ")
            elif tag not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("article", "main", "body", "td", "th") and tag not in BLOCK:
                        break  # a stray inline end tag does not close what holds it
                else:
                    if tag == "p":
                        flush()
            if tag in SPACED:
                pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in SPACED:
                pieces.append(" ")
            continue
        for k in range(len(stack) - 1, 0, -1):
            was = stack[k][0]
            if tag in CLOSED_BY.get(was, ()):
                close(k)
                break
            if was in LISTS or was in ("article", "section", "div", "td", "th", "body"):
                break
        holder = stack[-1][1]
        if len(stack) > DEEPEST:  # as in browsers, what is nested deeper belongs to the deepest element
            beyond[tag] = beyond.get(tag, 0) + 1
            if tag in BLOCK:
                flush()
            continue
        inside = _within(holder, ("article", "main"))
        in_article = inside and _within(holder, ("article",))
        first, mark = _named(tag, more, inside, in_article) if more.strip(" /\n\t\r") else ("", 0)
        if tag in STRONG or (tag == "header" and not inside):
            mark = 2
        elif tag in WEAK and not (in_article and tag in PROSE):
            mark = max(mark, 1)
        if tag in ("html", "body", "main") or (tag == "article" and not inside):
            mark = 0
        if tag in BLOCK or mark:
            flush()
            holder = Element(tag, f"{holder.path}/{tag}{'.' + first if first else ''}", holder, mark, holder.depth + 1)
        elif tag in SPACED:
            pieces.append(" ")
        stack.append((tag, holder))
        if tag == "a":
            in_link = bool(_ADDRESS.search(more))
        in_control += tag in CONTROLS
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return found


def _within(element: Element | None, tags: tuple[str, ...]) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def _holders(element: Element | None) -> Iterator[Element]:
    """The element and all that it stands in."""
    while element is not None:
        yield element
        element = element.parent


def _smoothed(values: list[float], radius: int = 1, sigma: float = 1.0) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for k in range(len(values)):
        near = [(weights[j + radius], values[k + j]) for j in range(-radius, radius + 1) if 0 <= k + j < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _weight(b: Block) -> int:
    return max(0, len(b.text) - b.linked - b.controls)


def _left_in(found: list[Block]) -> list[Block]:
    """The blocks outside marked elements, after overruling marks that hold nearly all text, and outside lists of links."""
    weights, links, sizes = {}, {}, {}
    for b in found:
        for e in _holders(b.element):
            weights[id(e)] = weights.get(id(e), 0) + _weight(b)
            links[id(e)] = links.get(id(e), 0) + b.linked
            sizes[id(e)] = sizes.get(id(e), 0) + len(b.text)
    linked = {k for k, n in links.items() if n >= 0.7 * sizes[k]}
    strong = [any(e.mark == 2 for e in _holders(b.element)) for b in found]
    weak = [None if out else next((e for e in reversed([*_holders(b.element)]) if e.mark == 1), None) for b, out in zip(found, strong)]
    overruled: set[int] = set()
    while True:
        free = [b for b, out, e in zip(found, strong, weak) if not out and (e is None or id(e) in overruled)]
        if any(_within(b.element, ("article", "main")) for b in free):
            break
        rest = sum(_weight(b) for b in free)
        held = {id(e): e for out, e in zip(strong, weak) if not out and e is not None and id(e) not in overruled}
        largest = max(held.values(), key=lambda e: weights[id(e)], default=None)
        if largest is None or rest >= NEARLY_NONE * weights[id(largest)]:
            break
        overruled.add(id(largest))
        # what stands inside has marks of its own
        weak = [next((x for x in reversed([*_holders(b.element)]) if x.mark == 1 and id(x) not in overruled), None) if not out else None for b, out in zip(found, strong)]
    lists = {id(e) for b in free for e in _holders(b.element) if e.tag in ("ul", "ol", "menu") and id(e) in linked}
    return [b for b in free if b.controls < len(b.text) and not (lists and any(id(e) in lists for e in _holders(b.element)))]


def fused_ratios(candidates: list[Block]) -> dict[str, float]:
    """For each path the largest of its fused ratios along the page: text by node without links, times punctuation by node, both smoothed."""
    totals: dict[str, list[float]] = {}
    for b in candidates:
        t = totals.setdefault(b.element.path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), b.linked)):
            t[k] += v
    text = {p: chars / n * (1 - linked / chars) for p, (n, chars, _, linked) in totals.items()}
    marks = {p: 1 + punctuation / n for p, (n, _, punctuation, _) in totals.items()}
    along = [x * y for x, y in zip(_smoothed([text[b.element.path] for b in candidates]), _smoothed([marks[b.element.path] for b in candidates]))]
    best: dict[str, float] = {}
    for b, near in zip(candidates, along):
        own = text[b.element.path] * marks[b.element.path]
        fused = min(near, own) * next((f for e in _holders(b.element) for t, f in FAVOURED if e.tag == t), 1.0)
        best[b.element.path] = max(best.get(b.element.path, 0), fused)
    return best


def content_blocks(page: str, share: float = 0.1) -> list[Block]:
    """The blocks of the main text."""
    found = blocks(page)
    candidates = _left_in(found) or [b for b in found if not any(e.mark == 2 for e in _holders(b.element))]
    if not candidates:
        return []
    best = fused_ratios(candidates)
    limit = share * max(best.values())
    picked = [b for b in candidates if best[b.element.path] >= limit]  # where all ratios are 0, as on a page of links, all of them
    region = _region(picked)
    own = [any(e is region for e in _holders(b.element)) for b in candidates]
    chosen = {id(b) for b in picked}
    places = [k for k, b in enumerate(candidates) if own[k] and id(b) in chosen]
    if region.tag in ("", "html", "body"):  # no element of its own: from the first to the last content node
        first, last = places[0], places[-1]
    else:
        inside = [k for k, x in enumerate(own) if x]
        first, last = inside[0], inside[-1]
    while first and candidates[first - 1].element.tag in HEADINGS and region.tag not in ("article", "main"):
        first -= 1
    return [b for k, b in enumerate(candidates[first : last + 1], first) if own[k] or b.element.tag in HEADINGS]


def _region(picked: list[Block]) -> Element:
    """From the root, each time the child that holds most of the content nodes' weight, as long as nearly nothing stands beside it.

    An article or main element needs half of the weight only, and is not left for a part of it but for an article in a main.
    """
    weights: dict[int, float] = {}
    below: dict[int, dict[int, Element]] = {}
    for b in picked:
        factor = next((f for e in _holders(b.element) for t, f in FAVOURED if e.tag == t), 1.0)
        for e in _holders(b.element):
            weights[id(e)] = weights.get(id(e), 0) + (_weight(b) + 1) * factor
            if e.parent is not None:
                below.setdefault(id(e.parent), {})[id(e)] = e
    region = next(e for e in _holders(picked[0].element) if e.parent is None)
    while parts := below.get(id(region)):
        part = max(parts.values(), key=lambda e: weights[id(e)])
        whole, own = weights[id(region)], weights[id(part)]
        favoured = part.tag in ("article", "main") and 2 * own >= whole
        if part.tag in LEAVES or (not favoured and (own < (1 - NEARLY_NONE) * whole or _within(region, ("article", "main")))):
            break
        if region.tag == "article":
            break
        region = part
    return region


def main_text(page: str | None) -> str:
    """The main text of one whole page: blocks joined by an empty line; empty for null, empty or text-free pages."""
    return "\n\n".join(b.text for b in content_blocks(page)) if page else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars (code points).

    Null html counts as empty; repeated rows are treated alike; other columns are ignored; an empty table
    gives no rows. Pages of any length are read whole, one at a time; elements nested deeper than DEEPEST belong to the
    deepest one, as in browsers. There is no shuffle.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                texts = [main_text(h.as_py()) for h in part.column(2)]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, url_col, "text", "n_chars"])

    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(extracted, schema)
