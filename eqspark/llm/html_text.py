"""Main-text extraction from HTML by tree scoring.

A tolerant one-pass scanner builds the element tree. Paragraph-like elements earn points for length and commas and
pass them to their ancestors (whole to the parent, half to the grandparent, a third and so on above), each
ancestor's sum is discounted by its link density, and the best container is kept with its well-scoring siblings.

Elements that can never hold the article (navigation, footers, scripts, fields, hidden parts) are cut before scoring, and link lists
inside the container after it. What only hints at such a part (a class or id token, a role, a form, ``aria-hidden``) lowers the score of its
element and cuts it unless it holds most of the page's paragraph points, for then it is a wrapper of the article. Class and id are
read token by token, so ``no-comments``, ``with-sidebar``, ``notice-board`` or ``data-id="nav"`` cut nothing. A header cuts nothing inside an article.
If nothing is left, the page is taken without the hints, and then without the cuts.

The scanner reads each character a bounded number of times, whatever the markup: a quote that never ends is a part of a plain value, and a tag that never
ends is text.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are repaired as browsers do for
paragraphs, list items, table parts and formatting; a page without paragraphs falls back to any text outside the cut
parts; nesting beyond ``MAX_DEPTH`` is flattened, with no text lost; repeated rows give a row each; a null page_id
or url is carried; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 400
MIN_PARAGRAPH = 25
#: Words of a paragraph beside its controls, in characters.
MIN_PROSE = 10
#: An element that hints at a part beside the article is kept if it holds this share of all paragraph points; reader comments need more.
WRAPPER_SHARE, COMMENT_SHARE = 0.5, 0.9
SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
CUT = frozenset("head nav header footer aside select option dialog menu svg canvas object video audio map datalist fieldset input".split())
#: Parts of forms that prose may name ("press the OK button"); they are cut but for that.
CONTROLS = frozenset(("button", "label"))
PROSE = frozenset("p li dd td blockquote".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPHS = frozenset("p pre td blockquote dd div section article li".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CONTAINERS = frozenset("ul ol dl table div section".split())
HINT_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar note".split())
#: Words of a class or id token that hint at a part which is not the article.
HINT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comentarios commentaires kommentare cookie cookies consent disclaimer discussion disqus feedback footer gdpr login masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond responses share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Words that say where a part is or what it is made of; a token of these and hint words hints.
PLACE_WORDS = frozenset("a an and area article articles author bar blog block body bottom box btn button buttons by card center col column container content entry for form global group header holder icon inner item items left link links list local main mobile module news outer page panel part place placeholder policy post posts primary reader readers right row secondary section site slot small story tab tag text title top type unit user users visitor wrap wrapper zone".split())
#: A token that begins so speaks of something that is absent or elsewhere.
NEGATIONS = frozenset("no not non has have with without hide hides hidden show js is page layout body".split())
GOOD_WORDS = frozenset("article body content entry main page post text blog story".split())
#: Words that mark a paragraph as the article's opening.
LEAD_WORDS = frozenset("lead lede intro standfirst dek summary".split())
#: A token that ends so names a part beside the article, whatever comes before.
PART_NAMES = frozenset("notice notices banner disclaimer newsletter popup modal sidebar advert adverts advertisement".split())
#: Reader comments; an <article> is cut by these words alone.
COMMENT_WORDS = frozenset("comment comments comentarios commentaires kommentare reply replies response responses disqus discussion respond".split())
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3, "form": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute: its name, and a quoted or plain value. Possessive, so that a failed match is never tried again.
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
GAP = re.compile(r"[\s/=]*+")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I) for tag in RAW}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("anchors", "children", "cut", "good", "hidden", "hint", "links", "mass", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        #: hint: 0 none, 1 a part beside the article, 2 reader comments
        self.cut, self.hidden, self.good, self.hint = False, False, 0, 0
        self.points, self.mass, self.size, self.links, self.anchors = 0.0, 0.0, 0, 0, 0


def _hint_of(token: str) -> tuple[int, bool]:
    """What a class or id token says: its hint, and whether it speaks for the article."""
    words = WORDS.findall(CAMEL.sub(" ", token).lower())
    if not words or (len(words) > 1 and words[0] in NEGATIONS):
        return 0, False
    found = HINT_WORDS.intersection(words)
    if found and all(w in HINT_WORDS or w in PLACE_WORDS or w.isdigit() for w in words):
        return (2 if COMMENT_WORDS.intersection(found) else 1), False
    if words[-1] in PART_NAMES:
        return 1, False
    return 0, not found and bool(GOOD_WORDS.intersection(words) or LEAD_WORDS.issuperset(words))


def _judge_attributes(node: Node, found: dict[str, str]) -> None:
    for name in ("class", "id"):
        for token in found.get(name, "").split():
            hint, good = _hint_of(token)
            node.hint, node.good = max(node.hint, hint), node.good | good
    if node.tag in ("article", "main") and node.hint == 1:
        node.hint = 0
    role = found.get("role", "").split()
    if (role and role[0].lower() in HINT_ROLES) or found.get("aria-hidden", "").strip().lower() == "true":
        node.hint = max(node.hint, 1)
    if "hidden" in found or ("style" in found and UNSEEN.search(found["style"])):
        node.cut = node.hidden = True


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` (the first of a name counts) and the place after the tag's ``>``, or -1 if it never ends."""
    found: dict[str, str] = {}
    end = len(html)
    while True:
        m = ATTRIBUTE.match(html, at)
        if m:
            at = m.end()
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
            continue
        at = GAP.match(html, at).end()
        if at >= end:
            return found, -1
        if html[at] == ">":
            return found, at + 1


def _after_comment(html: str, at: int) -> int:
    """The place after a comment, declaration or stray mark that begins at ``at``."""
    if html.startswith("<!--", at):
        for short in ("<!-->", "<!--->"):
            if html.startswith(short, at):
                return at + len(short)
        stop, n = html.find("-->", at + 4), 3
    else:
        stop, n = html.find(">", at), 1
    return stop + n if stop >= 0 else len(html)


def parse(html: str) -> Node:
    """The tree; text children are whole runs between tags, not decoded."""
    root = Node("html", None)
    node, depth, at, end = root, 0, 0, len(html)
    last_end = html.rfind(">")
    unended: set[str] = set()  # raw elements that no end tag follows
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            node.children.append(html[at:])
            break
        mark = html[begin + 1 : begin + 2]
        closing = mark == "/"
        name = NAME.match(html, begin + 2 if closing else begin + 1)
        if name is None and mark not in ("!", "?", "/"):  # a bare <
            node.children.append(html[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            node.children.append(html[at:begin])
        if begin > last_end:  # no tag ends from here on: what looks like attributes is markup cut off, the rest is text
            rest = html[begin:]
            if name is not None and not closing and "=" not in rest:
                node.children.append(rest)
            break
        if name is None:
            at = _after_comment(html, begin)
            continue
        tag = name[0].lower()
        found, at = _attributes(html, name.end())
        if at < 0:
            break
        if closing:
            up, steps = node, 0
            while up is not None and up.tag != tag:
                if up.tag in ("td", "th", "table", "article", "main", "section") and tag not in BLOCKS:
                    up = None  # stray end of formatting does not close a block
                    break
                up, steps = up.parent, steps + 1
            if up is not None and up.parent is not None:
                node, depth = up.parent, depth - steps - 1
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.tag == "head":
                node, depth = node.parent, depth - 1
            if node.parent is None or tag == "html":
                continue
        if node.tag == "head" and tag in BLOCKS:
            node, depth = node.parent, depth - 1
        if tag in RAW:
            if tag in unended:
                continue
            close = RAW_END[tag].search(html, at)
            if close is None:
                unended.add(tag)
                at = end if tag in ("script", "style") else at
                continue
            stop = html.find(">", close.end())
            at = stop + 1 if stop >= 0 else end
            continue
        if tag in VOID:
            node.children.append(Node(tag, node))
            continue
        closes = _closed_by(tag, node)
        if closes is not None:
            while node is not closes:
                node, depth = node.parent, depth - 1
            node, depth = node.parent, depth - 1
        if depth >= MAX_DEPTH:
            if tag in BLOCKS:
                node.children.append(Node("br", node))
            continue
        new = Node(tag, node)
        new.cut = tag in CUT and not (tag == "header" and _within_article(node))
        new.hint = int(tag == "form")
        if found:
            _judge_attributes(new, found)
        node.children.append(new)
        if tag in BLOCKS or not html.endswith("/", 0, at - 1):
            node, depth = new, depth + 1
    return root


def _cut_controls(root: Node) -> None:
    """Cut labels and buttons but where a paragraph outside forms, without fields, says more than them."""
    stack = [(root, False)]
    while stack:
        node, in_form = stack.pop()
        in_form = in_form or node.tag in ("form", "fieldset")
        stack.extend((c, in_form) for c in node.children if c.__class__ is Node)
        if node.tag in CONTROLS:
            node.cut = True
    spare: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, in_form = stack.pop()
        in_form = in_form or node.tag in ("form", "fieldset")
        stack.extend((c, in_form) for c in node.children if c.__class__ is Node)
        if node.tag not in PROSE or in_form:
            continue
        inner = [c for c in node.children if c.__class__ is Node and c.tag not in BLOCKS]
        for x in inner:
            inner.extend(c for c in x.children if c.__class__ is Node and c.tag not in BLOCKS)
        own = [x for x in inner if x.tag in CONTROLS and not x.hidden]
        if own and not any(x.tag in ("input", "select") for x in inner) and len(_inline_text(node).strip()) >= MIN_PROSE:
            spare += own
    for x in spare:
        x.cut = False


def _within_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _closed_by(tag: str, node: Node) -> Node | None:
    """The open element that a start tag ends, if any."""
    if tag in CLOSES_P:
        up = node
        while up is not None and up.tag not in ("td", "th", "table", "article", "div", "section", "main", "button", "blockquote", "li" if tag != "li" else "ul"):
            if up.tag == "p" or up.tag == tag == "li" or (tag in ("dd", "dt") and up.tag in ("dd", "dt")):
                return up
            if tag == "li" and up.tag in ("ul", "ol", "menu"):
                return None
            up = up.parent
        return up if up is not None and up.tag == tag == "li" else None
    ends = {"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead"), "option": ("option",), "a": ("a",)}.get(tag)
    if ends:
        up = node
        while up is not None and up.tag != "table" and not (tag == "a" and up.tag in BLOCKS):
            if up.tag in ends:
                return up
            up = up.parent
    return None


def _text(piece: str) -> str:
    return unescape(piece) if "&" in piece else piece


def _measure(root: Node) -> list[Node]:
    """Sizes, link sizes and anchors of all kept nodes; the nodes, parents first."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        node.size = node.links = 0
        node.points = node.mass = 0.0
        node.anchors = int(node.tag == "a")
        order.append(node)
        stack.extend(c for c in reversed(node.children) if c.__class__ is Node)
    for node in reversed(order):
        own = "".join([_text(c) if c.__class__ is str else " " for c in node.children if c.__class__ is str or c.tag == "br"])
        node.size += len(" ".join(own.split()))
        if node.tag == "a":
            node.links = node.size
        if (up := node.parent) is not None:
            up.size += node.size
            up.links += node.links
            up.anchors += node.anchors
    return order


def _paragraph_points(order: list[Node]) -> list[tuple[Node, float]]:
    """Paragraph-like nodes with their points."""
    out = []
    for node in order:
        if node.tag in PARAGRAPHS and node.size and (text := " ".join(_inline_text(node).split())):
            n = len(text)
            out.append((node, (1 + text.count(",") + min(n / 100, 3)) if n >= MIN_PARAGRAPH else n / MIN_PARAGRAPH / 2))
    return out


def _judge_hints(order: list[Node]) -> bool:
    """Cut the nodes whose hint holds; true if any is cut. A node with most of the paragraph points is a wrapper of the article."""
    if not any(node.hint for node in order):
        return False
    for node, points in _paragraph_points(order):
        node.mass += points * (1 - _density(node))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.mass += node.mass
    total, some = order[0].mass, False
    for node in order:
        if node.hint and (not total or node.mass < (COMMENT_SHARE if node.hint == 2 else WRAPPER_SHARE) * total):
            node.cut = some = True
    return some


def _inline_text(node: Node) -> str:
    """Text of a paragraph with its formatting, without nested blocks."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            out.append(_text(x))
        elif x is node or not (x.cut or x.tag in BLOCKS):
            stack.extend(reversed(x.children))
    return "".join(out)


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _best(order: list[Node]) -> Node | None:
    candidates: dict[int, Node] = {}
    for node, points in _paragraph_points(order):
        share, up = 1, node.parent if node.tag in ("p", "pre", "td", "blockquote", "dd", "li") else node
        while up is not None and share <= 5:
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.points = TAG_POINTS.get(up.tag, 0) + 10 * up.good - 10 * bool(up.hint)
            up.points += points / share
            share, up = share + 1, up.parent
    for node in candidates.values():
        node.points *= 1 - _density(node)
    return max(candidates.values(), key=lambda x: x.points, default=None)  # ties: the first in page order


def _kept(best: Node) -> list[Node]:
    up = best
    while up is not None:  # parts of one article are not torn apart
        if up.tag == "article":
            best = up
            break
        up = up.parent
    if best.parent is None or best.tag in ("article", "main", "html"):
        return [best]
    least, out = max(10.0, 0.2 * best.points), []
    for x in best.parent.children:
        if x.__class__ is not Node or x.cut:
            continue
        if x is best or x.points >= least or x.tag in ("h1", "h2") and x.size or _alike(x, best):
            out.append(x)
        elif x.tag == "p" and x.size:
            text, density = _inline_text(x).strip(), _density(x)
            if x.good and density < 0.25 or len(text) > 80 and density < 0.25 or not density and text.endswith((".", "!", "?")):
                out.append(x)
    return out


def _alike(x: Node, best: Node) -> bool:
    """A part like the best one: of its tag, almost without links, and with a fifth of its points, both counted without what the tag itself gives."""
    given = TAG_POINTS.get(best.tag, 0)
    return x.tag == best.tag and bool(x.size) and not x.hint and _density(x) < 0.1 and x.points - given >= 0.2 * max(0.0, best.points - given - 10 * best.good)


def _is_link_list(node: Node) -> bool:
    return node.tag in CONTAINERS and node.anchors >= 2 and _density(node) >= 0.8


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif x.__class__ is str:
                run.append(_text(x))
            elif x.cut or _is_link_list(x):
                continue
            elif x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCKS:
                close()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
        close()
    return out


def _extracted(root: Node) -> str:
    order = _measure(root)
    if _judge_hints(order):
        order = _measure(root)
    best = _best(order)
    return "\n".join(_blocks(_kept(best) if best is not None else [root]))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _cut_controls(root)
    text = _extracted(root)
    if text:
        return text
    for every in (False, True):  # without the hints, then without the cuts
        stack = [root]
        while stack:
            node = stack.pop()
            node.hint = 0
            node.cut = not every and node.cut and (node.tag in CUT or node.tag in CONTROLS)
            stack.extend(c for c in node.children if c.__class__ is Node)
        if text := _extracted(root):
            return text
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 512):
            part = b.slice(start, 512)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, SCHEMA)
