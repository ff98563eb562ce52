"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements, forgiving about tags that are left open. Parts that can't be article text are cut off: by
element (nav, header, footer, aside, script, style ...); forms, and what the words in class, id and role speak against, too, but
for wrappers of the article. Blocks of text pass points for length and commas to their ancestors, each level up half as many, and
a container's points are discounted by its link density. The best container is kept with those of its siblings that score well or
read like prose. Elements nested more than DEPTH deep count as children of the one at that depth; their text stays.

Defined cases: null or empty html gives an empty text; markup without any block of text gives an empty text; very long pages
are read whole; page_ids are 64-bit and may be null; repeated rows, ties included, are treated one by one, and of equally good
containers the first on the page is the best; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import chunks
from textmill.llm._shared import ready

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|aria-hidden|hidden|style|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title noembed noframes canvas".split())
CUT = frozenset("nav header footer aside button dialog menu fieldset label input option datalist audio video map head".split()) | RAW
BLOCK = frozenset("p div article section main body html ul ol li table tr td th thead tbody tfoot caption blockquote pre h1 h2 h3 h4 h5 h6 dl dt dd figure figcaption address hr details summary center hgroup form".split()) | CUT - {"label", "input", "button", "option"}
#: An opening tag ends these open ones.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
INLINE_STOP = BLOCK - {"p"}
#: Words in class, id or role that mark what isn't article text.
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|reply|reviews?|sidebars?|side|aside|widgets?|menus?|nav|navbar|navigation|navigations|breadcrumbs?|crumbs?|header|masthead|topbar|footer|foot|bottom|"
    r"cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|subscribe|subscription|newsletter|signup|login|register|search|share|sharing|social|related|recommend\w*|more-\w+|trending|popular|tags?|tagcloud|pagination|pager|toolbar|skip\w*|copyright|legal|disclaimer|hidden|print-only|toc|form|contentinfo|complementary|dialog|tooltip|byline-share|outbrain|taboola|metadata)(?:$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text|blog|prose", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACES = re.compile(r"\s+")
DEPTH = 256


class Node:
    """An element: its parent, its place among blocks, the blocks below it."""

    __slots__ = ("bad", "blocks", "good", "link_chars", "name", "parent", "points", "chars", "order", "soft")

    def __init__(self, name: str, parent: Node | None, bad: bool, good: bool, order: int, soft: bool = False):
        # bad: cut by element or as hidden; soft: cut by its words unless spare() finds the article in it
        self.name, self.parent, self.bad, self.good, self.order, self.soft = name, parent, bad, good, order, soft
        self.points, self.chars, self.link_chars, self.blocks = 0.0, 0, 0, []


def _soft(name: str, named: str) -> bool:
    """Whether an element goes unless it wraps the article."""
    return name == "form" or name not in ("body", "html", "article", "main") and _named_bad(named)


def _named_bad(named: str) -> bool:
    """Whether words of class, id and role mark no article text: one is bad, and none is good without a bad part."""
    if not BAD.search(named):
        return False
    return not any(GOOD.search(w) and not BAD.search(w) for w in named.split())


def _above(n: Node) -> Iterator[Node]:
    """A node and its ancestors."""
    up: Node | None = n
    while up is not None:
        yield up
        up = up.parent


def spare(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside elements that are cut by their words.

    Such an element is a wrapper and stays if it holds the page's article or main element, and none stands outside the cut ones;
    or, on a page without these, if it holds most of the text and no block of prose stands outside them.
    """
    softs = [n for n in nodes if n.soft]
    if not softs:
        return blocks
    bodies = [n for n in nodes if n.name in ("article", "main") and not n.bad]
    free = lambda n: not any(x.soft for x in _above(n))
    chars, holds = [0] * len(nodes), [False] * len(nodes)
    for n, text, _ in blocks:
        chars[n.order] += len(text)
    for n in bodies:
        holds[n.order] = True
    for n in reversed(nodes[1:]):  # a parent stands before its children
        chars[n.parent.order] += chars[n.order]
        holds[n.parent.order] |= holds[n.order]
    found = any(free(n) for n in bodies)
    prose = found or any(len(t) > 80 and links < 0.25 * len(t) and free(n) for n, t, links in blocks)
    # the likeliest wrapper first: one that is called like an article, or a form, by its text
    for soft in sorted(softs, key=lambda n: (not n.good and n.name != "form", -chars[n.order], n.order)):
        if found or prose and not bodies:
            break
        if soft.parent is not None and not free(soft.parent):
            continue
        likely = soft.good or soft.name == "form"
        if holds[soft.order] or not bodies and (likely or chars[soft.order] > chars[0] / 2):
            soft.soft = False
            found = any(free(n) for n in bodies)
            prose = found or any(len(t) > 80 and links < 0.25 * len(t) and free(n) for n, t, links in blocks)
            if not prose and not holds[soft.order]:
                soft.soft = True
    return [b for b in blocks if free(b[0])]


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """(nodes, blocks): blocks in page order as (node that holds it, text, characters in links)."""
    root = Node("#root", None, False, False, 0)
    nodes, stack, blocks = [root], [root], []
    held: list[str] = []
    links = 0
    in_link = 0
    holder = root

    def flush() -> None:
        nonlocal links, holder
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip()
            if text and not holder.bad:
                blocks.append((holder, text, min(links, len(text))))
            held.clear()
        links = 0

    def block_node() -> Node:
        for n in reversed(stack):
            if n.name in BLOCK or n.name == "#root":
                return n
        return root

    raw = ""
    at = 0
    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            raw = ""
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if not held:
                holder = block_node()
            held.append(piece)
            if in_link:
                links += len(piece.strip())
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if m[1]:
            if name == "p" and not any(n.name == "p" for n in stack):
                flush()
                continue
            if name == "a":
                in_link = max(0, in_link - 1)
                continue
            if name in BLOCK or name in CUT:
                flush()
            if name in BLOCK or name in CUT:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        in_link = 0
                        break
                    if name in ("li", "p", "td", "th", "tr") and stack[k].name in ("ul", "ol", "table", "article", "section", "nav", "aside"):
                        break
            continue
        if name in RAW and not m[3].endswith("/"):
            raw = name
            continue
        if name == "a":
            in_link += 1
            continue
        if name in BLOCK or name in CUT:
            flush()
            if name in ENDS:
                ends, stop = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        del stack[k:]
                        break
                    if stack[k].name in stop:
                        break
            elif name in INLINE_STOP or name == "p":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in INLINE_STOP:
                        break
            if name in VOID:
                continue
            words = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] else {}
            named = f"{words.get('class', '')} {words.get('id', '')} {words.get('role', '')}"
            bad = name in CUT or "hidden" in words or words.get("aria-hidden") == "true" or "display:none" in words.get("style", "").replace(" ", "")
            node = Node(name, stack[min(len(stack), DEPTH) - 1], stack[-1].bad or bad, name in ("article", "main") or words.get("role") == "main" or "articlebody" in words.get("itemprop", "").lower() or bool(GOOD.search(named)), len(nodes), _soft(name, named) or len(stack) > DEPTH and stack[-1].soft)
            nodes.append(node)
            if not m[3].endswith("/"):
                stack.append(node)
    flush()
    return nodes, spare(nodes, blocks)


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    _, blocks = parse(page)
    if not blocks:
        return ""
    containers: dict[int, Node] = {}
    for i, (node, text, links) in enumerate(blocks):
        up, share = node, 1.0
        points = 0.0 if node.name in HEADINGS else 1.0 + text.count(",") + min(len(text) / 100.0, 3.0) if len(text) - links >= 20 else 0.0
        inner = node.name in ("p", "li", "pre", "td", "blockquote", "dd", "dt", "figcaption") or node.name in HEADINGS
        k = 0
        while up is not None:
            up.chars += len(text)
            up.link_chars += links
            up.blocks.append(i)
            if not (inner and up is node):
                up.points += points * share
                share = 0.5 if k == 0 else share / 2 if k > 0 else share
                k += 1
            containers[up.order] = up
            up = up.parent
    density = lambda n: n.link_chars / n.chars if n.chars else 1.0
    score = lambda n: (n.points + (5.0 if n.name == "article" or n.name == "main" else 2.0 if n.good else 0.0)) * (1.0 - density(n))
    ranked = [n for n in containers.values() if n.name not in ("#root", "html") and n.name not in HEADINGS]
    best = max(ranked or list(containers.values()), key=lambda n: (score(n), -n.order))
    # an enclosing article or main element is the article's own container
    up = best.parent
    while up is not None and up.name not in ("body", "html", "#root"):
        if up.name in ("article", "main"):
            best = up
            break
        up = up.parent
    keep = set(best.blocks)
    limit = max(5.0, 0.2 * score(best))
    if best.parent is not None and best.name not in ("article", "main"):
        for n in containers.values():
            if n.parent is best.parent and n is not best:
                prose = n.name == "p" and (n.chars > 80 and density(n) < 0.25 or n.chars and density(n) == 0 and re.search(r"[.!?]( |$)", " ".join(blocks[i][1] for i in n.blocks)))
                if score(n) >= limit or prose or n.name in HEADINGS:
                    keep.update(n.blocks)
        keep.update(i for i, b in enumerate(blocks) if b[0] is best.parent and len(b[1]) > 80 and b[2] == 0)
    return "\n".join(blocks[i][1] for i in sorted(keep))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        text = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; a narrow map over the rows, without a shuffle."""
    ready(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
