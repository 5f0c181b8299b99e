"""Main text by tag-path ratios: a version in plain Python over element trees, and pages that once lost their text."""

import math
import random
import xml.etree.ElementTree as ET

import pytest

from quillstone.llm import tagpath

ARTICLE = "<article><h1>Title of it</h1><p>A first paragraph, long enough, to be one.</p><p>Sh is.</p><p>And another paragraph follows, with words.</p></article>"
TEXT = "Title of it\n\nA first paragraph, long enough, to be one.\n\nSh is.\n\nAnd another paragraph follows, with words."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form>{ARTICLE}</form></body>", f"<div class='col side-by-side'>{ARTICLE}</div>", f"<div class='layout has-sidebar'>{ARTICLE}<div class=sidebar>x y, z</div></div>",
        f"<body class='no-footer'><div class='no-footer'>{ARTICLE}</div>", f"<!-->{ARTICLE}", f"<!--->{ARTICLE}", f"<object data=x>{ARTICLE}", f"<div class=overlay>{ARTICLE}</div><nav>a b</nav>", f"<form><div class='banner'>{ARTICLE}</div></form>",
        f"<article><h2>Teaser</h2><p>Short, teaser.</p></article>{ARTICLE}", ARTICLE.replace("</article>", "</article><div class='feedback-list'><p>Nice, text.</p></div>"), ARTICLE.replace("</article>", "<div class='commentList'><p>Nice, text.</p></div></article>"),
        ARTICLE.replace("<h1>", "<h1 id='legal-background'>").replace("<p>Sh", "<section id='related-work'><p>Sh"), ARTICLE.replace("another", "<button>another</button>"), ARTICLE.replace("another", "<label>another</label>"),
        f"<div class=ad>Buy this, that, and more of it, now.</div>{ARTICLE}<footer>By us, all of us, everywhere, and so on and on.</footer>", f"<ul><li><a>One</a></li><li><a>Two</a></li></ul>{ARTICLE}", ARTICLE.replace("article", "div"), f"<main>{ARTICLE}</main>", ARTICLE.replace("article", "main"),
        ARTICLE.replace("</article>", "<ul><li><a href=x>more of this</a></li><li><a href=y>and of that</a></li></ul></article>"), ARTICLE.replace("</article>", "<div><button>Share</button></div></article>"),
    ],
)
def test_pages_keep_their_text(page):
    assert tagpath.main_text(page) == TEXT


SIX = [f"Paragraph {k} of the story, which goes on, with commas, and ends." for k in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in SIX)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><a name="top"><article>{STORY}</article></body>', f'<body><a id=top>Up<div>{STORY}</div></body>', f'<article><a href="/story">{STORY}</a></article>', f'<a href=x><article>{STORY}</article>', f"<article>{STORY.replace('<p>', '<p><a href=y>').replace('</p>', '</a></p>')}</article>",
        f"<article>{STORY.replace('<p>Paragraph 2', '<section class=legal><p>Paragraph 2').replace('<p>Paragraph 4', '</section><p>Paragraph 4')}</article>", f"<article>{STORY.replace('<p>Paragraph 3', '<p class=side>Paragraph 3')}</article>",
        f"<article>{STORY.replace('<p>Paragraph 1', '<fieldset><p>Paragraph 1').replace('<p>Paragraph 3', '</fieldset><p>Paragraph 3')}</article>", f"<article>{STORY.replace('<p>Paragraph 5', '<section class=discussion><p>Paragraph 5')}</section></article>",
        f"<article>{STORY}<div class='discussion-thread'><p>Nice, text, I think.</p></div></article>", f"<article>{STORY}<section class='comments'><p>Nice, text, I think.</p></section></article>", f"<article>{STORY}<p class='advert'>Buy, now, this.</p></article>",
    ],
)
def test_links_and_words_of_prose_cost_no_text(page):
    """No anchor without an address, no link around an article, no section named by a word of prose empties a page or cuts it."""
    assert tagpath.main_text(page).removeprefix("Up\n\n") == "\n\n".join(SIX)


def test_headings_named_by_words_of_prose_stay():
    page = f"<article>{STORY}<h2 class='related'>Related work</h2><p>Others wrote of it, before, at length.</p></article>"
    assert tagpath.main_text(page) == "\n\n".join([*SIX, "Related work", "Others wrote of it, before, at length."])


@pytest.mark.parametrize("page", ["<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "<form><a href=x>One</a> <p><a href=y>Two</a></form>", "<div class=ad><button>One Two</button></div>"])
def test_a_page_with_text_outside_menus_is_never_empty(page):
    assert tagpath.main_text(page).split() == ["One", "Two"]


def test_a_page_of_menus_only_is_empty():
    assert tagpath.main_text("<nav><a href=x>One</a></nav><footer>Two, three.</footer>") == ""


def test_a_short_article_beside_longer_notices():
    page = "<body><nav><ul><li><a>x</a></li></ul></nav><div class='ad'>A longer advert, with marks, and words enough.</div><article><p>Of.</p></article><footer>&copy; someone, somewhere, and many more words of it.</footer></body>"
    assert tagpath.main_text(page) == "Of."


@pytest.mark.parametrize("name, inside, wanted", [("ad", False, True), ("ad-slot-3", False, True), ("topAd", False, True), ("side-by-side", False, False), ("has-sidebar", False, False), ("no-footer", False, False), ("related-work", False, False), ("post-header", False, True), ("post-header", True, False), ("comment-list", True, True), ("readable", False, False), ("shared-memory", False, False)])
def test_names_that_are_marks(name, inside, wanted):
    assert tagpath.marked_name(name, inside) == wanted


def brute(root):
    """Tag-path ratios over a tree of unmarked, link-free elements, by definition: (path, text) in page order, then the region."""
    leaves = []

    def walk(node, path, chain):
        path, chain = f"{path}/{node.tag}", [*chain, node]
        if node.text and node.text.strip():
            leaves.append((path, " ".join(node.text.split()), chain))
        for child in node:
            walk(child, path, chain)

    walk(root, "", [])
    if not leaves:
        return ""
    size = {p: [len(t) for q, t, _ in leaves if q == p] for p, _, _ in leaves}
    marks = {p: [sum(c in ".,;:!?" for c in t) for q, t, _ in leaves if q == p] for p, _, _ in leaves}
    mean = lambda v: sum(v) / len(v)
    text, punctuation = {p: mean(v) for p, v in size.items()}, {p: 1 + mean(v) for p, v in marks.items()}

    def smooth(values, k):
        near = [(math.exp(-((j - k) ** 2) / 2), values[j]) for j in (k - 1, k, k + 1) if 0 <= j < len(values)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    favour = lambda chain: next((f for n in reversed(chain) for t, f in (("article", 10), ("main", 3)) if n.tag == t), 1)
    best = {}
    for k, (p, _, chain) in enumerate(leaves):
        fused = min(smooth([text[q] for q, _, _ in leaves], k) * smooth([punctuation[q] for q, _, _ in leaves], k), text[p] * punctuation[p]) * favour(chain)
        best[p] = max(best.get(p, 0), fused)
    chosen = [best[p] >= 0.1 * max(best.values()) for p, _, _ in leaves]
    weigh = lambda node: sum((len(t) + 1) * favour(c) for (_, t, c), x in zip(leaves, chosen) if x and any(n is node for n in c))
    region = root
    while len(region):
        part = max(region, key=weigh)
        special = part.tag in ("article", "main") and 2 * weigh(part) >= weigh(region)
        held = any(n.tag in ("article", "main") for n in next(c for _, _, c in leaves if any(x is region for x in c)) if any(x is region for x in n.iter()))
        if not weigh(part) or region.tag == "article" or part.tag in tagpath.LEAVES or not (special or (weigh(part) >= 0.9 * weigh(region) and not held)):
            break
        region = part
    own = [any(n is region for n in c) for _, _, c in leaves]
    at = [k for k, x in enumerate(own) if x and (chosen[k] or region.tag not in ("html", "body"))]
    first, last = at[0], at[-1]
    while first and leaves[first - 1][0].rsplit("/", 1)[1] in tagpath.HEADINGS and region.tag not in ("article", "main"):
        first -= 1
    return "\n\n".join(leaves[k][1] for k in range(first, last + 1) if own[k] or leaves[k][0].rsplit("/", 1)[1] in tagpath.HEADINGS)


def random_page(rng):
    def text():
        return " ".join(rng.choice(["word", "and", "longer,", "end.", "of", "it", "really,", "so!"]) for _ in range(rng.choice([1, 2, 5, 20, 60])))

    def make(depth):
        if depth > 3 or rng.random() < 0.45:
            node = ET.Element(rng.choice(["p", "p", "p", "h2", "pre"]))
            node.text = text()
            return node
        node = ET.Element(rng.choice(["div", "div", "section", "article", "main", "blockquote"]))
        for _ in range(rng.randint(1, 5)):
            node.append(make(depth + 1))
        return node

    body = ET.Element("body")
    for _ in range(rng.randint(1, 5)):
        body.append(make(1))
    html = ET.Element("html")
    html.append(body)
    return html


def test_against_ratios_over_element_trees():
    rng, picked = random.Random(8), 0
    for k in range(1500):
        tree = random_page(rng)
        page = ET.tostring(tree, encoding="unicode")
        wanted = brute(tree)
        assert tagpath.main_text(page) == wanted, page
        picked += wanted != "\n\n".join(" ".join(t.split()) for t in tree.itertext() if t.strip())
    assert picked > 300
