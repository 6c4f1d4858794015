"""Operator 2, main-text extraction by tree scoring.

A page becomes a tree (script-like elements and page furniture are left out).  Each paragraph passes points for its length and
commas to its ancestors, halved per level; a container's points are discounted by its link density.  The best container is
kept (or the ``article``/``main`` that holds it), with the siblings that also look like content, later sections with a heading of
their own and further articles of the same depth among them.

An element is furniture by its own name, or if a whole class, id or role says so: ``sidebar``, ``site-footer``, ``cookie-notice``,
but not ``no-sidebar`` or ``content-with-comments``; other attributes say nothing, but for ``hidden``, ``aria-hidden`` and a style
that shows nothing.  Where no article or main element lies outside of furniture, an element that
holds most of the page's paragraph text (a form around the whole page, say) is no furniture, unless it holds reader comments.

Defined results: null or empty html, and pages without text, give an empty text; unclosed, cut and misnested tags are read as
browsers do for the common cases; very long pages and elements nested without end take time in proportion to their length;
repeated rows give repeated rows; an empty table gives an empty result; columns beside keys and html are not read.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element names.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav header footer aside form button select menu svg canvas object audio video dialog fieldset datalist map head".split())
MAY_HOLD_ALL = frozenset("form fieldset header aside dialog".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK | DROP
PARAGRAPHS = frozenset("p pre blockquote td dd figcaption li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_FURNITURE = frozenset("html body main article".split())
# Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu header masthead banner footer contentinfo sidebar complementary aside notice cookie cookies consent gdpr alert ad ads adv advert adverts advertisement "
    "sponsor sponsored promo promotion comment comments disqus reply replies respond form search login signup subscribe newsletter share sharing social related breadcrumb breadcrumbs "
    "pagination pager popup modal overlay widget toolbar tags".split()
)
# Words that say where furniture is or what it is made of, and words that say an element has or lacks some.
PLACES = frozenset("site main page top left right bottom primary secondary global post article entry list area box slot section container buttons button posts links link item items bar block unit wrap nav".split())
STATES = frozenset("no not has have with without open closed enabled disabled hide show is layout content body text".split())
TALK = frozenset("comment comments disqus reply replies respond".split())
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
# an attribute: its whole name, and its value with the quotes around it consumed
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?|"[^"]*"|'[^']*'""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# Which open elements an opening tag looks at: (those it closes, those that shield what is further out).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td"}, {"tr", "table"}), "th": ({"th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
SHIELDS_P = frozenset({"td", "th", "button"})
NO, SOFT, HARD = 0, 1, 2


class Node:
    __slots__ = ("furniture", "items", "parent", "points", "tag", "talk")

    def __init__(self, tag: str, parent: Node | None, furniture: int = NO, talk: bool = False):
        self.tag, self.parent, self.furniture, self.talk = tag, parent, furniture, talk
        self.items: list = []
        self.points = 0.0


def names_furniture(token: str) -> bool:
    """Whether a class, id or role as a whole names page furniture."""
    if token in FURNITURE:
        return True
    parts = [x for x in re.split(r"[^a-z]+", token) if x]
    return len(parts) > 1 and STATES.isdisjoint(parts) and not FURNITURE.isdisjoint(parts) and all(x in FURNITURE or x in PLACES for x in parts)


def furniture_of(tag: str, attributes: str) -> tuple[int, bool]:
    """(NO, SOFT or HARD, whether it is reader comments)."""
    if attributes and tag not in NEVER_FURNITURE:
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                return HARD, False
            if kind == "style" and UNSEEN.search(value):
                return SOFT, False  # a page may show such an element by script, so it is no furniture where it holds the article
            if kind in ("class", "id", "role"):
                for token in value.split():
                    if names_furniture(token):
                        return SOFT, not TALK.isdisjoint(re.split(r"[^a-z]+", token))
    if tag in DROP:
        return SOFT if tag in MAY_HOLD_ALL else HARD, False
    return NO, False


class Open:
    """The open elements, outermost first, with their places by name, so that no search walks over unrelated ones."""

    def __init__(self, root: Node):
        self.path, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, at: int) -> None:
        while len(self.path) > at:
            self.places[self.path.pop().tag].pop()


def parse(text: str) -> Node:
    root = Node("#root", None)
    open_, at, size = Open(root), 0, len(text)
    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            open_.path[-1].items.append(htmllib.unescape(text[at:lt]))
        if lt >= size:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        closing = text.startswith("</", lt)
        name = NAME.match(text, lt + 1 + closing)
        if not name:
            if closing or text[lt + 1 : lt + 2] in ("!", "?"):
                end = text.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                open_.path[-1].items.append("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        end = TAG_END.match(text, name.end())
        stop = end.end() if end else text.find(">", name.end()) + 1 or size
        attributes = text[name.end() : stop]
        at = stop
        if closing:
            if place := open_.last(tag):
                open_.close(place)
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = found.end() if found else size
            continue
        if tag in CLOSES_P and (place := open_.last("p")) > max(map(open_.last, SHIELDS_P)):
            open_.close(place)
        if tag in CLOSES:
            ends, shields = CLOSES[tag]
            if (place := max(map(open_.last, ends))) > max(map(open_.last, shields)):
                open_.close(place)
        here = open_.path[-1]
        if tag in VOID:
            here.items.append(" " if tag != "hr" else Node("hr", here))
            continue
        child = Node(tag, here, *furniture_of(tag, attributes))
        here.items.append(child)
        if not attributes.rstrip(">").endswith("/") or tag in BLOCK:
            open_.push(child)
    return root


def spare(root: Node) -> None:
    """Clears SOFT where the element holds most of the page's paragraph text and no article lies outside of furniture."""
    mass: dict[int, list[int]] = {}  # node: characters in paragraphs, paragraphs
    soft, article = [], False
    stack = [(root, False, False)]
    while stack:
        n, inside, done = stack.pop()
        if n.furniture == HARD:
            mass[id(n)] = [0, 0]
            continue
        if not done:
            if n.furniture == SOFT:
                soft.append(n)
            inside = inside or n.furniture == SOFT
            article = article or (n.tag in ("article", "main") and not inside)
            stack.append((n, inside, True))
            stack.extend((x, inside, False) for x in n.items if isinstance(x, Node))
            continue
        chars = count = 0
        plain = n.tag == "p" or (n.parent is not None and n.parent.tag == "p")
        for x in n.items:
            if isinstance(x, Node):
                c, k = mass.pop(id(x))
                chars, count = chars + c, count + k
            elif plain:
                chars += len(x.strip())
        mass[id(n)] = [chars, count + (n.tag == "p")]
        if n.furniture == SOFT:
            n.points = chars if mass[id(n)][1] >= 2 and not n.talk else 0.0
    total = mass[id(root)][0]
    for n in soft:
        if not article and n.points > 0.6 * total:
            n.furniture = NO
        n.points = 0.0


def measure(node: Node, points: dict | None = None) -> tuple[int, int, int]:
    """Characters, characters in links and commas below a node; fills in the points paragraphs pass up, if asked for.  No
    recursion: a page may nest its elements as deep as it likes."""
    sizes: dict[int, list[int]] = {}
    stack = [(node, False, False)]
    while stack:
        n, link, done = stack.pop()
        if n.furniture:
            sizes[id(n)] = [0, 0, 0]
            continue
        link = link or n.tag == "a"
        if not done:
            stack.append((n, link, True))
            stack.extend((x, link, False) for x in n.items if isinstance(x, Node))
            continue
        chars = linked = commas = own = own_commas = 0
        for x in n.items:
            if isinstance(x, Node):
                c, k, m = sizes.pop(id(x))
                if x.tag not in BLOCK:
                    own, own_commas = own + c - k, own_commas + m
            else:
                c = len(x.strip())
                k, m = c if link else 0, x.count(",")
                own, own_commas = own + c - k, own_commas + m
            chars, linked, commas = chars + c, linked + k, commas + m
        sizes[id(n)] = [chars, linked, commas]
        if points is None:
            continue
        if n.tag in PARAGRAPHS or (n.tag in ("div", "section", "article", "body", "main") and own >= 25):
            score = (1 + own_commas + min(own / 100, 3.0)) * (1 - linked / max(chars, 1)) if own >= 25 else 0.2 * (own > 0)
            up = n.parent if n.tag in PARAGRAPHS else n
            share = 1.0
            while up is not None and share > 0.01:
                up.points += score * share
                points[id(up)] = up
                up, share = up.parent, share / 2
        n.points *= 1 - linked / max(chars, 1)
    return tuple(sizes[id(node)])


def blocks(node: Node, out: list[str]) -> None:
    """The text blocks below a node in page order; a block ends where a block element begins or ends."""
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.furniture:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()


def has_heading(node: Node) -> bool:
    """Whether a heading with text lies below."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS and measure(n)[0]:
            return True
        stack.extend(x for x in n.items if isinstance(x, Node) and not x.furniture)
    return False


def same_level(root: Node, node: Node) -> list[Node]:
    """The elements of a node's name and depth that lie outside of furniture, in page order."""
    depth, up = 0, node
    while up.parent is not None:
        depth, up = depth + 1, up.parent
    level = [root]
    for _ in range(depth):
        level = [x for n in level for x in n.items if isinstance(x, Node) and not x.furniture]
    return [x for x in level if x.tag == node.tag]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    spare(root)
    points: dict[int, Node] = {}
    total = measure(root, points)
    if not total[0]:
        return ""
    best = max((n for n in points.values() if not n.furniture), key=lambda n: n.points, default=root)
    up, holder = best, None
    while up is not None:
        if up.tag in ("article", "main"):
            holder = up
            if up.tag == "article":
                break
        up = up.parent
    out: list[str] = []
    if holder is not None:
        best = holder
    parent = best.parent
    if parent is None:
        blocks(best, out)
        return "\n".join(out)
    # siblings that also look like content: as many points as a fifth of the best, or headings and paragraphs with little link text,
    # alone or in a section of their own; beside an article the other articles of its depth
    limit = max(2.0, 0.2 * best.points)
    if best.tag == "article":
        for x in same_level(root, best):
            if x is best or x.points >= limit:
                blocks(x, out)
        return "\n".join(out)
    for x in parent.items:
        if x is best:
            blocks(x, out)
        elif isinstance(x, Node) and not x.furniture and holder is None:
            chars, linked, _ = measure(x)
            if chars and linked <= 0.25 * chars and (x.points >= limit or x.tag in ("p", "blockquote", "pre") or x.tag in HEADINGS or (x.points > 0 and has_heading(x))):
                blocks(x, out)
        elif isinstance(x, Node) and not x.furniture and x.tag == holder.tag and x.points >= limit:
            blocks(x, out)
    return "\n".join(out)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), col: str = "html") -> DataFrame:
    """(keys, text, n_chars) of every page."""

    def run(batches):
        for big in batches:
            for b in slices(big, col):
                texts = [main_text(x) for x in b.column(col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keys, "text", "n_chars"])

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, col).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op2_html(pages: DataFrame) -> DataFrame:
    """Contract query over the whole html of every page."""
    return extract(pages)
