"""Main text of web pages by tree scoring.

The page becomes a tree without the parts that are never an article. Each paragraph gives points for its length and its
commas to its ancestors, less the further up; an ancestor's points are discounted by the share of its text that is link
text. The best container and those of its siblings that look like more of the article are the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template head nav footer aside form button select textarea input iframe object "
                  "svg canvas audio video menu dialog applet map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre td li blockquote".split())
#: A paragraph passes points to so many ancestors.
ANCESTORS = 10
WHOLE = frozenset("html body article main".split())
#: An opening tag that ends an open one: these end an open p, and one of a kind ends the one before.
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div body html main blockquote".split())
#: Words in a class, id or role that mark a part as no article.
APART = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sidebar|comments?|commentlist|respond|replies|"
                   r"disqus|cookies?|consent|gdpr|notice|notification|alert|promo|promotion|sponsor(?:ed)?|newsletter|"
                   r"subscribe|share|sharing|social|related|recommended|breadcrumbs?|menu|nav|navbar|navigation|topbar|"
                   r"footer|header|masthead|popup|modal|overlay|widget|toolbar|pager|pagination|login|signup|paywall|"
                   r"complementary|contentinfo|search|skip)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "points", "length", "linked", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.length = self.linked = 0


class Tree(HTMLParser):
    """Builds the tree as browsers would for plain faults: a p ends before a block, an unopened end tag is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag not in INLINE and tag not in VOID:
            self.end_open({"p"} | ALIKE.get(tag, set()))
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        in_article = tag == "header" and self.inside(("article", "main"))
        drop = tag in NEVER or (tag == "header" and not in_article) or tag not in WHOLE and (
            hidden or bool(named and APART.search(named) and not in_article))
        node = Node(tag, self.at, drop or self.at.dropped)
        self.at.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def inside(self, tags: tuple[str, ...]) -> bool:
        node = self.at
        while node is not None and node.tag not in tags:
            node = node.parent
        return node is not None

    def end_open(self, tags: set[str]) -> None:
        """End the innermost open elements up to one of tags, not across a fence."""
        node = self.at
        while node is not None and node.tag not in FENCES:
            if node.tag in tags and node.parent is not None:
                self.at = node = node.parent
            else:
                node = node.parent


def score(tree: Tree) -> None:
    """Lengths and link lengths of all nodes, and the points that paragraphs pass up."""
    for node in reversed(tree.nodes):  # children before parents
        if node.dropped:
            continue
        own = sum(len(p) - p.count(" ") for p in node.parts if isinstance(p, str))
        node.length += own
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    for node in tree.nodes:
        if node.tag in INLINE or node.dropped or not node.length:
            continue
        text = direct_text(node)
        if not text.strip():
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        above, level = node if node.tag not in PARAGRAPHS else node.parent, 0
        while above is not None and level < ANCESTORS:
            above.points += points * (1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level))
            above, level = above.parent, level + 1


def direct_text(node: Node) -> str:
    """Text of a node and its inline parts, not of blocks in it."""
    out, stack = [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.dropped and (part is node or part.tag in INLINE):
            stack.extend(reversed(part.parts))
    return "".join(out)


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 1.0


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order; white space within and between them becomes one space."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.dropped:
            out.append(" ")
        elif part.tag in INLINE:
            stack.extend(reversed(part.parts))
        else:
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    score(tree)
    value = lambda n: n.points * (1 - density(n))
    best = max((n for n in tree.nodes if n.points > 0), key=value, default=None)
    if best is None or best.length == 0:
        return ""
    node = best  # the page's own word for its article, if the best container lies in one
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    if best.parent is None or best.tag in WHOLE - {"article"}:
        return text_of([best])
    least = max(10.0, 0.2 * value(best))
    kept = []
    for other in best.parent.parts:
        if other is best:
            kept.append(other)
        elif isinstance(other, Node) and not other.dropped and other.length:
            long_p = other.tag == "p" and density(other) < 0.25 and other.length > 80
            if value(other) >= least or long_p or other.tag in HEADINGS and density(other) < 0.5:
                kept.append(other)
    return text_of(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    Null or empty html, or a page without article text, gives the empty text. Null ids and urls stay null, repeated
    rows are extracted alike, other columns are not read. A faulty page never fails: unknown ends are ignored, open
    elements end with the page. Pages are handled where they lie, one tree in memory at a time.
    """
    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None) if len(html) else pd.Series([], dtype=object)

    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
