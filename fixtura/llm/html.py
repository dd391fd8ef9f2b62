"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Features of a block are its words and link density, those of the blocks
before and after, whether it and the block after stand where the page's words are dense, whether that is the page as a whole, whether the
block stands in a container for boilerplate, and whether it is a heading (has a heading open around it). A small tree of axis
splits, trained on the labelled table below when a task starts, decides which blocks are main text. Character references are
decoded, white space in a block becomes one space, and kept blocks are joined in page order by a newline.

What a container is called is evidence, not a verdict. Names count by whole tokens of a class, so that states of a page
(``has-sidebar``, ``no-sidebar``, ``search-open``) say nothing. A form, alert, sidebar and the like that holds MOST of the
page's unlinked words (those of an article elsewhere weigh PRIOR times) is no boilerplate; menus, footers and reader comments
always are. A header inside an article belongs to it.

Words are dense in the deepest container with at least DENSE of the page's words that are neither links nor in boilerplate, or in the
outermost article or main element (or one named so) around it; words inside such elements weigh PRIOR times. So a
container's name alone makes nothing main text: most of the words have to stand there.

Null and empty pages have no text. A page is worked on alone, so partitions and row counts stay as they are. Rows repeat as they come.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fixtura.llm.common import append_columns

DENSE, PRIOR, MOST = 0.6, 4, 0.75
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "noise", "dense", "dense_after", "flat", "heading")

# A small labelled table of blocks, in the order of FEATURES, then the label (1: main text).
LABELLED = [
    # menus, headers, footers, sidebars, notices, adverts, forms and comments, by their container
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0, 0, 0),
    (14, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0),
    (45, 0.1, 30, 0.0, 12, 0.0, 1, 1, 1, 1, 0, 0),
    (120, 0.0, 90, 0.0, 40, 0.0, 1, 0, 0, 0, 0, 0),
    (30, 0.0, 60, 0.0, 70, 0.0, 1, 1, 1, 0, 0, 0),
    (4, 0.0, 60, 0.0, 70, 0.0, 1, 1, 1, 0, 1, 0),
    (3, 1.0, 12, 0.0, 3, 1.0, 1, 1, 1, 0, 0, 0),
    (85, 0.0, 20, 0.0, 35, 0.0, 1, 1, 0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 25, 0.0, 1, 0, 1, 0, 1, 0),
    (55, 0.4, 3, 1.0, 2, 1.0, 1, 1, 1, 1, 0, 0),
    # where words are dense, in a part of the page: paragraphs of any length, headings, a line that is one link among text
    (6, 0.0, 12, 0.0, 45, 0.0, 0, 1, 1, 0, 1, 1),
    (1, 0.0, 70, 0.0, 55, 0.0, 0, 1, 1, 0, 0, 1),
    (60, 0.0, 6, 0.0, 1, 0.0, 0, 1, 1, 0, 0, 1),
    (35, 0.3, 60, 0.0, 35, 0.2, 0, 1, 1, 0, 0, 1),
    (2, 1.0, 40, 0.0, 30, 0.0, 0, 1, 1, 0, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 1),
    (250, 0.0, 1, 0.0, 3, 1.0, 0, 1, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0, 0, 1),
    (12, 0.9, 50, 0.0, 14, 0.0, 0, 1, 1, 0, 0, 1),
    (3, 1.0, 12, 0.0, 20, 0.0, 0, 1, 1, 0, 0, 1),
    (5, 1.0, 25, 0.0, 25, 0.1, 0, 1, 1, 0, 0, 1),
    (2, 1.0, 4, 0.0, 70, 0.0, 0, 1, 1, 0, 0, 1),
    (8, 0.0, 8, 0.0, 8, 0.0, 0, 1, 1, 0, 0, 1),
    (40, 0.1, 3, 1.0, 35, 0.0, 0, 1, 1, 0, 0, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1, 0, 0, 1),
    (25, 0.0, 1, 1.0, 25, 0.0, 0, 1, 1, 0, 0, 1),
    (9, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0, 1),
    (6, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 1),
    (70, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1, 0, 0, 1),
    # there too: lines of links in a row
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 1, 1, 0, 0, 0),
    (4, 1.0, 30, 0.0, 3, 1.0, 0, 1, 1, 0, 0, 0),
    (3, 1.0, 4, 1.0, 40, 0.0, 0, 1, 1, 0, 0, 0),
    (9, 0.9, 6, 0.9, 7, 1.0, 0, 1, 1, 0, 0, 0),
    (14, 0.8, 25, 0.1, 12, 0.8, 0, 1, 1, 0, 0, 0),
    (4, 1.0, 60, 0.0, 3, 1.0, 0, 1, 1, 0, 0, 0),
    (3, 1.0, 45, 0.9, 30, 0.0, 0, 1, 1, 0, 0, 0),
    (5, 1.0, 5, 1.0, 12, 0.1, 0, 1, 1, 0, 0, 0),
    # elsewhere on such a page; only headings right before the dense part belong to it
    (3, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0, 0, 0),
    (40, 0.0, 1, 1.0, 6, 0.0, 0, 0, 1, 0, 0, 0),
    (18, 0.2, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
    (5, 1.0, 0, 0.0, 5, 1.0, 0, 0, 0, 0, 0, 0),
    (1, 1.0, 4, 1.0, 9, 0.0, 0, 0, 0, 0, 0, 0),
    (6, 0.0, 5, 1.0, 40, 0.0, 0, 0, 0, 0, 1, 0),
    (90, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 0),
    (9, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 0, 0),
    (7, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1, 0, 1, 1),
    (11, 0.0, 2, 1.0, 6, 0.0, 0, 0, 1, 0, 1, 1),
    (4, 0.0, 0, 0.0, 90, 0.0, 0, 0, 1, 0, 1, 1),
    # pages without such a part: running text, its headings and its short paragraphs; lists of links and lone scraps are not
    (60, 0.0, 3, 1.0, 45, 0.0, 0, 1, 1, 1, 0, 1),
    (45, 0.05, 60, 0.0, 30, 0.0, 0, 1, 1, 1, 0, 1),
    (25, 0.1, 45, 0.0, 2, 1.0, 0, 1, 1, 1, 0, 1),
    (16, 0.0, 30, 0.0, 18, 0.0, 0, 1, 1, 1, 0, 1),
    (120, 0.2, 2, 1.0, 2, 1.0, 0, 1, 1, 1, 0, 1),
    (30, 0.0, 1, 1.0, 25, 0.0, 0, 1, 1, 1, 0, 1),
    (22, 0.0, 25, 0.0, 1, 0.0, 0, 1, 1, 1, 0, 1),
    (40, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 1, 0, 1),
    (8, 0.0, 55, 0.0, 40, 0.0, 0, 1, 1, 1, 0, 1),
    (3, 0.0, 40, 0.0, 60, 0.0, 0, 1, 1, 1, 0, 1),
    (5, 0.0, 2, 1.0, 50, 0.0, 0, 1, 1, 1, 1, 1),
    (7, 0.0, 35, 0.0, 60, 0.0, 0, 1, 1, 1, 1, 1),
    (4, 0.0, 0, 0.0, 30, 0.0, 0, 1, 1, 1, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 1, 1, 0, 0),
    (12, 0.9, 3, 1.0, 8, 0.8, 0, 1, 1, 1, 0, 0),
    (20, 0.7, 30, 0.0, 4, 1.0, 0, 1, 1, 1, 0, 0),
    (40, 0.8, 2, 1.0, 60, 0.0, 0, 1, 1, 1, 0, 0),
    (3, 0.0, 2, 1.0, 1, 1.0, 0, 1, 1, 1, 0, 0),
    (5, 0.0, 1, 1.0, 4, 0.5, 0, 1, 1, 1, 0, 0),
    (6, 0.0, 3, 0.0, 0, 0.0, 0, 1, 1, 1, 0, 0),
    (4, 0.5, 60, 0.0, 30, 0.0, 0, 1, 1, 1, 0, 0),
]

# Element names by role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "option", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
NOISE = frozenset("nav footer header aside form dialog menu fieldset".split())
CONTENT = frozenset("article main".split())
CLOSES = frozenset("p li dt dd tr td th option".split())
PARTS = frozenset("article main section div td center".split())
HOLDS = frozenset("article aside blockquote body div dl fieldset figure footer form header main menu nav ol section table ul".split())
TOPICS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_NAME = re.compile(r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|comments?|comment-?list|replies|disqus|respond|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|foot(?:er)?|head(?:er)?|masthead|share|sharing|social|newsletter|subscribe|subscription|signup|sign-up|login|search|related|recommended|pagination|pager|toolbar|widget|copyright|disclaimer|skip-?link)(?:$|[_-])", re.I)
#: Names that no number of words redeems, names that belong to an article inside one, and tokens that tell a state of what bears them.
STRONG_NAME = re.compile(r"(?:^|[_-])(?:comments?|comment-?list|replies|disqus|respond|nav|navbar|navigation|menu|foot(?:er)?|breadcrumbs?|pagination|pager)(?:$|[_-])", re.I)
HEAD_NAME = re.compile(r"(?:^|[_-])(?:head(?:er)?|masthead)(?:$|[_-])", re.I)
STATE_NAME = re.compile(r"(?:has|no|not|with|without|is|are|show|shows|hide|hides|js|can|enable|disable|single|layout)[_-].*|.*[_-](?:open|opened|closed|active|inactive|enabled|disabled|visible|hidden|on|off|shown|collapsed|expanded|allowed|layout)", re.I)
STRONG = frozenset("nav footer menu".split())
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post|post-?body|post-?content|entry|entry-?content|story|story-?body|main-?content|main-?text|body-?text)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    veil: int  #: the innermost container for boilerplate, 0 for none
    content: bool
    heading: bool
    part: int  #: the nearest container, 0 for the page itself
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    text: str = ""
    noise: bool = False


def _named(value: str, inside: bool) -> int:
    """What the tokens of a class, id or label tell: 0 nothing, 1 boilerplate, 2 boilerplate whatever it holds."""
    out = 0
    for token in value.split():
        if NOISE_NAME.search(token) and not STATE_NAME.fullmatch(token) and not (inside and HEAD_NAME.search(token) and not STRONG_NAME.search(token)):
            out = max(out, 2 if STRONG_NAME.search(token) else 1)
    return out


def _roles(name: str, attrs: str, inside: bool = False) -> tuple[int, bool]:
    """Whether an element opens boilerplate (2: whatever it holds), and whether it opens content. Ids and labels of headings and sections ``inside`` content are topics, and a header there is its own."""
    noise, content = 2 if name in STRONG else int(name in NOISE and not (inside and name == "header")), name in CONTENT
    if attrs and not attrs.isspace():
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "role":
                noise = max(noise, 2 if value.lower() in ("navigation", "contentinfo", "menu", "menubar") else int(value.lower() in ("banner", "complementary", "search", "form", "alert", "dialog")))
                content |= value.lower() in ("main", "article")
            elif key == "itemprop":
                content |= value.lower() == "articlebody"
                noise = max(noise, 2 * (value.lower() == "comment"))
            elif key == "hidden":
                noise = 2
            elif key in ("class", "id", "aria-label"):
                topic = inside and key != "class" and name in TOPICS
                if not topic and name not in ("html", "body", "article", "main"):
                    noise = max(noise, _named(value, inside))
                content |= bool(CONTENT_NAME.search(value)) and name in ("div", "section", "td")
    return noise, content


def _settled(found: list[Block], veils: list[tuple[int, bool]]) -> None:
    """Mark the blocks that stand in boilerplate: inside a container that is so whatever it holds, or that doesn't hold MOST of the page's unlinked words."""
    held, plain, weighed = [0] * len(veils), [0] * len(veils), 0
    for b in found:
        n = b.words - b.linked
        weighed += n * (PRIOR if b.content else 1)
        plain[b.veil] += n
        held[b.veil] += n * (PRIOR if b.content else 1)
    for i in range(len(veils) - 1, 0, -1):  # parents come before their children
        plain[veils[i][0]] += plain[i]
        held[veils[i][0]] += held[i]
    noise = [False]
    for i in range(1, len(veils)):
        above, strong = veils[i]
        # what it holds, against that and all that stands elsewhere
        noise.append(noise[above] or strong or plain[i] < MOST * (plain[i] + weighed - held[i]) or not plain[i])
    for b in found:
        b.noise = noise[b.veil]


def blocks(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """Flat blocks with text, in page order, and each container's parent and whether it opens content; the page itself is the first."""
    done: list[Block] = []
    above_of: list[tuple[int, bool]] = [(0, False)]
    veils: list[tuple[int, bool]] = [(0, False)]  #: of each container for boilerplate the one around it, and whether it is so whatever it holds
    open_: list[tuple[str, int, bool, int]] = []  #: name, the nearest container for boilerplate, content, and the nearest container
    now = Block(0, False, False, 0)
    links, heads, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                done.append(now)
        top = open_[-1] if open_ else ("", 0, False, 0)
        now = Block(top[1], top[2], part=top[3], heading=heads > 0)

    def say(piece: str) -> None:
        piece = entities.unescape(piece)
        now.parts.append(piece)
        n = len(piece.split())
        now.words += n
        now.linked += n if links else 0

    def close(index: int) -> None:
        nonlocal links, heads
        links -= sum(x[0] == "a" for x in open_[index:])
        heads -= sum(x[0] in HEADS for x in open_[index:])
        del open_[index:]

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            index = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if index is not None:
                close(index)
            if name in BLOCKS:
                flush()
            continue
        if name in RAW:
            stop = _END[name].search(page, at) if not attrs.endswith("/") or name not in ("svg", "math") else None
            if stop:
                at = page.find(">", stop.start()) + 1 or end
            elif not attrs.endswith("/"):
                at = end
            say(" ")
            continue
        if name == "br":
            say(" ")
            continue
        if name in CLOSES:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    close(i)
                    break
                if open_[i][0] in HOLDS:
                    break
        if name not in VOID and not attrs.endswith("/"):
            above = open_[-1] if open_ else ("", 0, False, 0)
            noise, content = _roles(name, attrs, above[2])
            if noise:
                veils.append((above[1], noise > 1))
            if name in PARTS:
                above_of.append((above[3], content))
            open_.append((name, len(veils) - 1 if noise else above[1], above[2] or content, len(above_of) - 1 if name in PARTS else above[3]))
            links += name == "a"
            heads += name in HEADS
        if name in BLOCKS:
            flush()
    flush()
    _settled(done, veils)
    return done, above_of


def dense_part(found: list[Block], above_of: list[tuple[int, bool]]) -> list[bool]:
    """Of each container, whether it is the one where the page's words are dense, or inside that."""
    held = [0] * len(above_of)
    for b in found:
        if not b.noise:
            held[b.part] += (b.words - b.linked) * (PRIOR if b.content else 1)
    for i in range(len(held) - 1, 0, -1):  # parents come before their children
        held[above_of[i][0]] += held[i]
    now = 0
    for i in range(1, len(held)):
        if above_of[i][0] == now and held[i] >= DENSE * held[0] > 0:
            now = i
    top, up = now, now
    while up:
        if above_of[up][1]:
            top = up
        up = above_of[up][0]
    inside = [top == 0]
    for i in range(1, len(held)):
        inside.append(i == top or inside[above_of[i][0]])
    return inside


@dataclass
class Node:
    label: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, x: tuple) -> int:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.cut else node.high
        return node.label


def _gini(labels: list[int]) -> float:
    return 2 * len(labels) * (p := sum(labels) / len(labels)) * (1 - p) if labels else 0.0


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """A tree of the splits with the least impurity; ties go to the widest gap between values relative to their spread, then to the first feature."""
    labels = [r[-1] for r in rows]
    node = Node(int(2 * sum(labels) >= len(labels)))
    if not depth or len(set(labels)) < 2:
        return node
    best = None
    for j in range(len(rows[0]) - 1):
        values = sorted({r[j] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            loss = _gini([r[-1] for r in rows if r[j] <= cut]) + _gini([r[-1] for r in rows if r[j] > cut])
            rank = (round(loss, 9), -(b - a) / (values[-1] - values[0]), j, cut)
            best = min(best or rank, rank)
    if best is None or best[0] >= round(_gini(labels), 9):
        return node
    node.feature, node.cut = best[2], best[3]
    node.low = grow([r for r in rows if r[node.feature] <= node.cut], depth - 1)
    node.high = grow([r for r in rows if r[node.feature] > node.cut], depth - 1)
    return node


def measured(found: list[Block], above_of: list[tuple[int, bool]]) -> list[tuple]:
    """FEATURES of each block."""
    inside = dense_part(found, above_of)
    size = [(b.words, b.linked / b.words if b.words else 0.0) for b in found]
    ends, dense, flat = [(0, 0.0), *size, (0, 0.0)], [*(int(inside[b.part]) for b in found), 0], int(inside[0])
    return [(*ends[i + 1], *ends[i], *ends[i + 2], int(b.noise), dense[i], dense[i + 1], flat, int(b.heading)) for i, b in enumerate(found)]


def main_text(page: str | None, tree: Node) -> str:
    found, above_of = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, measured(found, above_of), strict=True) if tree.decide(x))


def extract(pages: DataFrame, html: str = "html", out: str = "text", labelled: list[tuple] = LABELLED) -> DataFrame:
    """``pages`` with ``out``, the main text of each whole page."""

    def make():
        tree = grow(list(labelled))
        return lambda texts: [pa.array([main_text(t, tree) for t in texts], pa.string())]

    return append_columns(pages, html, [T.StructField(out, T.StringType())], make)
