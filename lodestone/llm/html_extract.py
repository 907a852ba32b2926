"""Main text of HTML pages by tree scoring.

Paragraphs earn points for length and commas and pass them to their ancestors, discounted by link density;
the container with the best score is kept with the siblings that belong to it.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# HTML element names by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe textarea title noembed xmp".split())
EMBEDDED = set("noscript template svg canvas object video audio select annotation".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
CLUTTER = set("nav footer aside form button fieldset dialog menu head".split()) | EMBEDDED
PARAGRAPHS = set("p pre blockquote td li dd figcaption".split())
CONTAINERS = set("article main section div body td blockquote".split())
# An opening tag on the left ends an open element on the right.
ENDS = {x: {"p"} for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
# Where the search for an element to end stops.
SCOPE = set("article body div section main table ul ol dl blockquote td th form aside nav header footer fieldset".split())

# Words of class, id and role that mark what is not the article, and what is.
BAD_WORDS = set("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs
sidebar side rail widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog
comment comments commentlist reply replies respond disqus discussion share sharing social follow subscribe subscription newsletter signup login
related recommended recommendations popular trending pagination pager paging skip search contentinfo complementary toc outbrain taboola
""".split())
GOOD_WORDS = set("article body content entry main page post story text blog hentry".split())
# Words of BAD_WORDS that are everyday words too, and words that only say what kind of box an element is.
EVERYDAY = set("share side follow social related recommended recommendations popular trending search skip rail banner reply replies respond discussion alert".split())
BOXES = set("""
area bar block bottom box btn button buttons card col column container element feed form group header holder icons inner item items layout left link links list
module outer panel posts region right row section slot stories top unit wrap wrapper
""".split())

#: A sibling, or an element around the best container, needs this share of its points, a sibling LEAST points too, and a sibling
#: that is an article of its own RIVAL of them; how many levels up points go.
SHARE, LEAST, RIVAL, REACH = 0.2, 4, 0.5, 5
#: An element with a name of clutter that holds this share of a page's points, and MASS of them, is none. One whose name only may be of clutter is
#: clutter if this share of it is links, or if no paragraph in it earns points.
MOST, MASS, LINKED = 0.5, 10, 0.3

_START = re.compile(r"<(?=[!?/a-zA-Z])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("articles", "bad", "told", "chars", "commas", "kids", "links", "mass", "open", "parent", "points", "rank", "suspect", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, weight: int = 0, suspect: int = 0):
        self.tag, self.parent, self.bad, self.weight, self.suspect = tag, parent, bad, weight, suspect
        self.kids: list[Node | str] = []
        self.open = False  # an embedded element that nothing ends
        self.clear()

    def clear(self) -> None:
        """points are those of paragraphs that reach it, rank has what its name adds, mass is that of all paragraphs under it, told
        what of that is in its articles."""
        self.articles, self.told = 0, 0.0
        self.points, self.rank, self.mass, self.chars, self.links, self.commas = 0.0, 0.0, 0.0, 0, 0, 0


def suspicion(value: str) -> int:
    """Of a class, id or role: 2 if a name in it is one of clutter, 1 if it may be, 0 if not.

    A name is of clutter if it ends in such a word (reader-comments), or if no word of it says anything else (related-posts, share-bar).
    With an everyday word (related-work, market-share) or with the word not last (side-effects) it may be.
    """
    most = 0
    for name in value.split():
        words = _TOKEN.findall(_CAMEL.sub(" ", name).lower())
        if BAD_WORDS.isdisjoint(words):
            continue
        head = words[-1]
        plain = all(w in BAD_WORDS or w in BOXES for w in words)
        if plain or (head in BAD_WORDS and head not in EVERYDAY):
            return 2
        if head not in GOOD_WORDS:
            most = 1
    return most


def marks(tag: str, attributes: str) -> tuple[bool, int, int]:
    """Whether an element is clutter by its tag or hidden, its weight as a container, and how suspect its class, id or role is."""
    bad, weight, suspect = tag in CLUTTER, 25 if tag in ("article", "main") else 0, 0
    if not attributes or tag in ("body", "html"):
        return bad, weight, suspect
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            bad = True
        elif name in ("class", "id", "role"):
            words = _TOKEN.findall(_CAMEL.sub(" ", value).lower())
            if tag not in ("article", "main", "p"):
                suspect = max(suspect, suspicion(value))
            weight += 25 * (not GOOD_WORDS.isdisjoint(words))
    return bad, weight, suspect


def parse(page: str) -> Node:
    """The tree of a page; what browsers would repair is repaired in the plain cases.

    Its cost is linear: behind the last > no tag is sought, the end of an element is sought once for all that it ends, and quotes
    that do not close are given up once they have cost four reads of the page.
    """
    root = node = Node("html", None)
    at, start, size, lower = 0, 0, len(page), None
    last, effort, ended = page.rfind(">"), 4 * size, {}
    unclosed: set[str] = set()
    while at < size:
        begun = _START.search(page, start) if start <= last else None
        if not begun:
            node.kids.append(page[at:])
            break
        start = begun.start()
        if page[start + 1] in "!?":
            if start > at:
                node.kids.append(page[at:start])
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = start = size if end < 0 else end + (3 if comment else 1)
            continue
        found = _TAG.match(page, start) if effort > 0 else None
        if not found:
            effort -= size - start
            found = _PLAIN.match(page, start)
        if not found:
            start += 1  # no tag, so it is text
            continue
        if start > at:
            node.kids.append(page[at:start])
        at = start = found.end()
        shut, tag, attributes = found[1], found[2].lower(), found[3]
        if shut:
            up = node
            while up.parent and up.tag != tag:
                if up.tag in SCOPE and (tag in INLINE or tag == "p" or tag == "li"):
                    break  # a stray end tag closes nothing outside its block
                up = up.parent
            if up.tag == tag and up.parent:
                node = up.parent
            elif tag == "p":
                node.kids.append(Node("p", node))
            continue
        if tag in RAW or tag in EMBEDDED:
            if attributes.endswith("/") and tag not in ("script", "style", "title", "textarea"):
                continue
            lower = lower or page.lower()
            if len(lower) != size:  # a character that grows in lower case
                lower = re.sub("[A-Z]", lambda m: m.group().lower(), page)
            if tag not in unclosed and ended.get(tag, -1) < at:
                ended[tag] = lower.find(f"</{tag}", at)
            end = -1 if tag in unclosed else ended[tag]
            if end < 0 and tag not in ("script", "style"):
                unclosed.add(tag)  # nothing ends it, so it ends where the next block begins
                if tag in EMBEDDED and not node.open:
                    kid = Node(tag, node, bad=True)
                    kid.open = True
                    node.kids.append(kid)
                    node = kid
                continue
            if tag in RAW:
                stop = -1 if end < 0 else page.find(">", end)
                at = start = size if stop < 0 else stop + 1
                continue
        if node.open and tag in ENDS:
            node = node.parent
        ends = ENDS.get(tag)
        if ends:
            up = node
            while up.parent and up.tag not in SCOPE | ends:
                up = up.parent
            while up.parent and up.tag in ends:
                node = up = up.parent
        if tag in ("html", "body") and (tag == "html" or node.tag == "body"):
            continue
        if tag == "body" or (node.tag == "head" and tag not in ("meta", "link", "base")):
            node = node.parent if node.tag == "head" else node
        kid = Node(tag, node, *marks(tag, attributes))
        node.kids.append(kid)
        if tag not in VOID and not attributes.endswith("/"):
            node = kid
    return root


def walk(root: Node) -> Iterator[tuple[Node | str, Node | None, bool]]:
    """(node or text, its parent, whether it ends) in page order, clutter left out."""
    stack: list[tuple] = [(root, None, True), (root, None, False)]
    while stack:
        x, parent, ends = stack.pop()
        yield x, parent, ends
        if not ends and isinstance(x, Node):
            for k in reversed(x.kids):
                if isinstance(k, str):
                    stack.append((k, x, False))
                elif not k.bad:
                    stack += [(k, x, True), (k, x, False)]


def earn(root: Node) -> list[Node]:
    """Count characters and links, and give points of paragraphs to their ancestors. The elements that count, from the inside out."""
    seen: list[Node] = []
    for x, parent, ends in walk(root):
        if not ends and isinstance(x, Node):
            x.clear()
        if isinstance(x, str):
            n = len(x) if "  " not in x and "\n" not in x else len(" ".join(x.split()))
            if x.isspace():
                continue
            parent.chars += n
            parent.commas += x.count(",") + x.count("，") + x.count("、")
        elif ends:
            if x.tag == "a":
                x.links = x.chars
            if x.parent:
                x.parent.chars += x.chars
                x.parent.links += x.links
                x.parent.commas += x.commas
            seen.append(x)
    for x in seen:
        own = x.tag in PARAGRAPHS or (x.tag in ("div", "section") and not any(isinstance(k, Node) and k.tag not in INLINE and k.tag not in VOID for k in x.kids))
        if not own or x.chars < 25:
            continue
        points = (1 + x.commas + min(x.chars / 100, 3)) * (1 - x.links / x.chars)
        x.mass += points
        up, level = x.parent, 0
        while up and level < REACH:
            up.points += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    for x in seen:
        if x.tag == "article" and x.chars:
            x.articles, x.told = 1, x.mass
        if x.parent:
            x.parent.mass += x.mass
            x.parent.articles += x.articles
            x.parent.told += x.told
    return seen


def condemn(seen: list[Node], whole: float) -> bool:
    """Mark those elements as clutter that their names and their points both speak against; whether there are any."""
    any_bad = False
    for x in seen:
        if x.suspect == 2:
            x.bad = x.mass < max(MASS, MOST * whole)
        elif x.suspect == 1:
            x.bad = not x.mass or x.links > LINKED * x.chars
        any_bad |= x.bad
    return any_bad


def score(root: Node) -> Node | None:
    """Give points to containers, clutter left out; the best one, or none. One that mostly holds several articles is none."""
    seen = earn(root)
    if any(x.suspect for x in seen) and condemn(seen, root.mass):
        seen = earn(root)
    best = None
    for x in seen:
        if x.points and x.tag in CONTAINERS and not (x.articles > 1 and x.told > 0.5 * x.mass):
            left = 1 - x.links / max(1, x.chars)
            x.points, x.rank = x.points * left, x.points * (1 + x.weight / 50) * left
            if best is None or x.rank > best.rank:
                best = x
    return best


def around(best: Node) -> Node:
    """The outermost element around the best container that is marked as content, has its share of points and is no list of links.

    An element that holds other articles is none: which of these belong is for their own points to tell.
    """
    up, inner, points, level = best.parent, best, best.rank, 0
    while up and up.tag not in ("body", "html") and level < REACH:
        rest, links = up.chars - best.chars, up.links - best.links
        others = any(isinstance(k, Node) and k is not inner and not k.bad and k.chars and k.tag == "article" for k in up.kids)
        if up.weight > 0 and up.rank >= SHARE * points and links <= 0.5 * max(1, rest) and not others:
            best = up
        inner, up, level = up, up.parent, level + 1
    return best


def top(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order. Of containers with equal points the first counts."""
    best = score(root)
    if best is None:
        marked = [x for x, _, ends in walk(root) if ends and isinstance(x, Node) and x.tag in ("article", "main") and x.chars]
        return marked[:1] or [root]
    best = around(best)
    if not best.parent:
        return [best]
    share, out = {x: max(LEAST, (RIVAL if x == "article" else SHARE) * best.points) for x in CONTAINERS}, []
    for x in best.parent.kids:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and not x.bad and x.chars:
            density = x.links / x.chars
            if (x.tag in CONTAINERS and x.points >= share[x.tag] and x.chars >= SHARE * best.chars and density < 0.25 and best.tag == x.tag) or (x.tag in ("p", "pre", "blockquote") and ((x.chars > 80 and density < 0.25) or (density == 0 and x.commas > 0 and x.chars > 25))) or x.tag == "h1":
                out.append(x)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under nodes, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = "".join(line)
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            line.clear()

    for node in nodes:
        skip: Node | None = None
        for x, _, ends in walk(node):
            if skip is not None:
                if x is skip and ends:
                    skip = None
                continue
            if isinstance(x, str):
                line.append(x)
            elif x.tag not in INLINE:
                flush()
                # Lists and boxes that are mostly links are text only in what is marked as content; page headers without the
                # article's title are none.
                if not ends and x is not node and ((not node.weight and x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.chars and x.links > 0.5 * x.chars) or (x.tag == "header" and not any(isinstance(k, Node) and k.tag in ("h1", "h2") for k in x.kids))):
                    skip = x
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page; empty for a null, an empty page or a page without text."""
    return "\n".join(blocks(top(parse(page)))) if page else ""


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) for the html column, which goes.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds.
    A null or empty html gives an empty text; other columns, and repeated rows, pass through.
    A column named text or n_chars is replaced. Embedded elements that nothing ends go to the next block, scripts and styles to the page's
    end. Points go REACH levels up. A class, id or role counts as clutter only together with the points of the element.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn("text", run(F.col(html))).withColumn("n_chars", F.length("text").cast("long")).drop(*{html} - {"text", "n_chars"})
