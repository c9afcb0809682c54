"""Main text of web pages by tree scoring.

The page is cut into tags and text in one pass, as a browser does, and built into a tree, with the end tags that pages leave out. Then it
is told what isn't the article: scripts, styles and what is hidden; navigation, headers and footers of the page, asides, forms; and nodes whose
class, id or role name a sidebar, notice, advert, menu or reader comments. Headings never go by a name, and prose only by one that says nothing else. Names that only tell how something else is laid out (has-sidebar,
fixed-header, comments-open), and in an article or the best container those with a word that may be about the text (menu-history, related-work), count only on a small node that is mostly links, and a node that holds nearly all running text that isn't
otherwise left out is the article whatever its names, as is such a form; reader comments must hold a title or an article element for that.

Each paragraph gives points for itself, its commas and its length to its ancestors, up to six: whole to its parent, half
to the next, then a third and so on. A container's score is what it got, and what its element and names say, times the share
of its text that is not in links. If the best container is in an article or main element, all of that stays but nodes beside the container that are mostly links. Else
the container is kept with the siblings that score at least a fifth of it or are prose (short lines and bare text only within a common node, not right below the page), and with what stands between those and isn't mostly
links. Link lists inside stay, as those that an element or a name marks as menus are left out before.

A null, empty or tag-free page: a text without tags is one block; no text is ''. Ties go to the container that comes first. An
unclosed tag or comment ends with the page; very long pages are parsed whole, nested without recursion, in time in proportion to their length.
Repeated rows get equal texts; an empty table gives an empty result. Other columns are kept; those named like result columns give way.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import packed, table, unpacked

MADE = ["text", "n_chars"]
#: What may start markup; any other < is text.
OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]*+")
#: An attribute's name, and whether a value follows; then the value, if it isn't quoted.
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+(\s*+=\s*+)?")
GAP = re.compile(r"[\s/]*+")
PLAIN = re.compile(r"[^\s>]*+")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
#: Of these the content up to the end tag is no markup; without one, that of the first five is the rest of the page.
OPAQUE = frozenset("script style textarea title iframe noscript template svg".split())
TO_THE_END = frozenset("script style textarea title iframe".split())
DROPPED = frozenset("nav footer aside form button menu dialog fieldset input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of prose, which go by a name only if that says nothing else.
PROSE = frozenset("p pre blockquote q code em strong b i u cite abbr td th tr table caption dl dt dd figure figcaption ol ul li".split()) | HEADINGS
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words of class, id or role that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads adbanner adbox adcontainer adsbygoogle adsense adslot adunit adwrap advert advertisement advertisements adverts banner breadcrumb breadcrumbs combx comment comments community complementary consent contentinfo cookie cookies disqus disclaimer "
    "dropdown extra footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related "
    "remark replies reply search share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar tooltip widget alert alertdialog".split()
)
#: Beside those, words that say where or how large a node is; a name with any other word may be about what the node tells of (menu-history, related-work).
PLACES = frozenset(
    "area articles bar block bottom box btn button buttons cell col column component container form global group holder icon icons inner item items left link links list main message module outer page panel post posts primary region right row secondary section site slot stories top unit wrap wrapper zone".split()
)
LIKELY = frozenset("article articlebody body content entry hentry main page post story text blog".split())
#: With these, the word header marks an article's own.
OWN_HEADER = frozenset("article entry post story".split())
#: Reader comments: their own text may be longer than the article's.
COMMENTS = frozenset("combx comment comments disqus reply replies shoutbox".split())
#: Before or after a word, these tell of the layout of another node.
BEFORE = frozenset("has no not with without is fixed sticky hide show allow enable".split())
AFTER = frozenset("open opened closed on off enabled disabled visible fixed sticky expanded collapsed".split())
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: Any other element ends the head.
HEAD = frozenset("head meta link base script style title noscript template".split())
#: An end tag doesn't reach beyond these.
SCOPES = ("td", "th", "caption", "table")
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
BONUS = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ol": -3, "ul": -3, "dl": -3, "th": -5, "address": -3}
LEVELS = 6
#: Why a node may be left out: its names tell of another node's layout, a name that may be about its text, its names, its element; and for sure.
LAYOUT, VAGUE, NAMED, ELEMENT, SURE = 1, 2, 3, 4, 5
#: A node is the article if all other running text is at most a tenth of what it holds.
ALL_BUT = 0.1


class Node:
    __slots__ = ("children", "comma", "direct", "length", "linked", "mark", "name", "parent", "score", "words")

    def __init__(self, name: str, parent: Node | None, words: frozenset = frozenset(), mark: int = 0):
        self.name, self.parent, self.words, self.mark = name, parent, words, mark
        self.children: list = []  # nodes and strings
        self.score = 0.0
        self.length = self.linked = self.comma = self.direct = 0


def _attributes(html: str, at: int) -> tuple[dict[str, str] | None, int]:
    """A tag's attributes from `at` on and where the tag ends; None if it doesn't end. The first of a name counts."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        at = GAP.match(html, at).end()
        if at >= n:
            return None, n
        if html[at] == ">":
            return found, at + 1
        match = ATTRIBUTE.match(html, at)
        name, value = match[0], ""
        at = match.end()
        if match[1]:
            name = name[: -len(match[1])]
            if at < n and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None, n
                value, at = html[at + 1 : end], end + 1
            else:
                end = PLAIN.match(html, at).end()
                value, at = html[at:end], end
        found.setdefault(name.lower(), value)


def _named(attributes: dict[str, str]) -> tuple[frozenset, int]:
    """The words of class, id and role, and whether they mark the node itself (NAMED, or VAGUE if a name may be about its text) or the layout of others (LAYOUT)."""
    words: set[str] = set()
    own, layout, vague = set(), False, True
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").split():
            parts = WORD.findall(CAMEL.sub(" ", token).lower())
            words.update(parts)
            bad = UNLIKELY.intersection(parts)
            if bad and len(parts) > 1 and (parts[0] in BEFORE or parts[-1] in AFTER):
                layout = True
            elif bad:
                own |= bad
                vague = vague and any(x not in UNLIKELY and x not in PLACES for x in parts)
    if own == {"header"} and words & OWN_HEADER:
        own = set()
    return frozenset(words), (VAGUE if vague else NAMED) if own else LAYOUT if layout else 0


def build(html: str) -> Node:
    """The tree of the page; what is surely not text is left out, what may not be the article is marked."""
    root = Node("html", None)
    opened: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where in `opened` elements of a name are
    endless: set[str] = set()  # opaque elements that no end tag follows
    last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=0)
    position, n = 0, len(html)

    def push(node: Node) -> None:
        opened[-1].children.append(node)
        places.setdefault(node.name, []).append(len(opened))
        opened.append(node)

    def close(at: int) -> None:
        while len(opened) > at:
            places[opened.pop().name].pop()

    while position < n:
        start = OPEN.search(html, position)
        end = start.start() if start else n
        if end > position:
            opened[-1].children.append(html[position:end])
        if not start:
            break
        kind = start[0]
        if kind == "<!--":
            at = html.find("-->", end + 2)  # also <!-->
            position = at + 3 if at >= 0 else n
            continue
        if kind in ("<!", "<?"):
            at = html.find(">", end)
            position = at + 1 if at >= 0 else n
            continue
        match = NAME.match(html, start.end() - 1)
        name = match[0].lower()
        attributes, position = _attributes(html, match.end())
        if attributes is None:
            break
        if kind[1] == "/":
            at = places[name][-1] if places.get(name) else 0
            if at and (name in TABLE_PARTS or at > last(SCOPES)):
                close(at)
            elif name == "p":
                opened[-1].children.append(Node("p", opened[-1]))
            continue
        if name in VOID:
            if name == "br":
                opened[-1].children.append(" ")
            elif name == "hr":
                opened[-1].children.append(Node("hr", opened[-1]))
            continue
        if name in OPAQUE and name not in endless:
            found = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, position)
            if found or name in TO_THE_END:
                position = found.end() if found else n
                continue
            endless.add(name)
        if places.get("head") and name not in HEAD:
            close(places["head"][-1])
        if name in ("html", "body"):
            if name == "body" and opened[-1].name == "html":
                push(Node("body", opened[-1]))
            continue
        if name in BLOCKS and places.get("p") and places["p"][-1] > last(SCOPES):
            close(places["p"][-1])
        if name in CLOSES:
            closed, until = CLOSES[name]
            floor = last(until)
            if last(closed) > floor:
                close(min(at[bisect_right(at, floor)] for x in closed if (at := places.get(x)) and at[-1] > floor))
        words, mark = _named(attributes) if attributes else (frozenset(), 0)
        if name in ("article", "main") or name in HEADINGS or name in PROSE and mark < NAMED:
            mark = 0
        if mark == VAGUE and (places.get("article") or places.get("main")):
            mark = LAYOUT
        if name in DROPPED or name == "header" and not (places.get("article") or places.get("main")):
            mark = ELEMENT
        if name in RAW or "hidden" in attributes or NO_DISPLAY.search(attributes.get("style", "")):
            mark = SURE
        node = Node(name, opened[-1], words, mark)
        push(node)
    return root


def _in_order(root: Node, most: int) -> list[Node]:
    """The nodes in page order, without those of a mark over `most` and what is in them."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and c.mark <= most]
    return order


def _measure(order: list[Node], most: int) -> None:
    """Lengths of text, of text in links and commas, bottom up."""
    for node in order:
        node.length = node.linked = node.comma = node.direct = 0
        for i, child in enumerate(node.children):
            if isinstance(child, str):
                text = node.children[i] = unescape(child) if most == ELEMENT and "&" in child else child
                size = len(text.strip())
                node.direct += size
                node.length += size
                node.comma += sum(map(text.count, ",，、،"))
    for node in reversed(order):
        if node.name == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.comma += node.comma


def _holds(node: Node, names: tuple[str, ...]) -> bool:
    waiting = [node]
    while waiting:
        at = waiting.pop()
        if at.name in names and at.mark < VAGUE and not at.words & UNLIKELY:
            return True
        waiting += [c for c in at.children if not isinstance(c, str)]
    return False


def _settle(order: list[Node]) -> None:
    """Take marks off nodes that are no menus, and off those that hold nearly all running text that no deeper mark leaves out."""
    page = order[0].length
    held: dict[int, tuple[Node | None, bool]] = {}  # of each node: the marked one that holds it, whether it is in a link
    running: dict[Node | None, int] = {None: 0}
    inner: dict[Node | None, list[Node]] = {None: []}
    for node in order:
        if node.mark == LAYOUT:
            node.mark = NAMED if 4 * node.length < page and _mostly_links(node) else 0
        within, linked = held[id(node.parent)] if node.parent is not None else (None, False)
        if node.mark:
            inner[within].append(node)
            within = node
            running[node], inner[node] = 0, []
        linked = linked or node.name == "a"
        held[id(node)] = within, linked
        if not linked:
            running[within] += node.direct
    while True:
        may = [m for m in inner[None] if (m.mark in (VAGUE, NAMED) or m.name in ("form", "fieldset")) and running[m]]
        most = max(may, key=lambda m: running[m], default=None)
        if most is None or running[None] > ALL_BUT * running[most] or most.words & COMMENTS and not _holds(most, ("article", "main", "h1")):
            return
        most.mark = 0
        running[None] += running[most]
        inner[None] = [m for m in inner[None] if m is not most] + inner[most]


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _mostly_links(node: Node) -> bool:
    return _density(node) > 0.5


def _best(order: list[Node]) -> Node | None:
    scored: dict[int, Node] = {}
    for node in order:
        if node.parent is None or not (node.name in PARAGRAPHS or node.name in ("div", "section", "article", "main") and node.direct >= 25) or not node.length:
            continue
        if node.name in ("li", "dd") and _density(node) > 0.5:
            continue
        points = 1 + node.comma + min(node.length // 100, 3)
        points *= 1 - _density(node)
        up, level = (node.parent if node.name in PARAGRAPHS else node), 1
        while up is not None and level <= LEVELS:
            if id(up) not in scored:
                scored[id(up)] = up
                up.score = BONUS.get(up.name, 0) + 25 * bool(up.words & LIKELY) - 25 * bool(up.words & UNLIKELY)
            up.score += points / level
            up, level = up.parent, level + 1
    best = None
    for node in order:
        if id(node) in scored:
            node.score *= 1 - _density(node)
            if node.name in BLOCKS and (best is None or node.score > best.score):
                best = node
    return best


def _in_article(best: Node) -> Node | None:
    """The article (or main) element around the best container, of which all stays but nodes beside the container that are mostly links."""
    path, at = [best], best
    while at.name not in ("article", "main") and at.parent is not None:
        at = at.parent
        path.append(at)
    if at.name not in ("article", "main"):
        return None
    for inner, outer in zip(path, path[1:], strict=False):
        for node in outer.children:
            if node is not inner and not isinstance(node, str) and node.name not in HEADINGS and _mostly_links(node) and not _holds(node, ("h1",)):
                node.mark = node.mark or NAMED
    return at


def _kept(best: Node) -> list:
    """The best container and what beside it goes with it, in page order."""
    least = max(10.0, best.score * 0.2)
    top = _in_article(best) or best
    if top.parent is None:
        return [top]
    beside, before, own = [], True, top is best and top.parent.name not in ("html", "body")  # beside what fills the page stand a page's own lines
    for node in top.parent.children:
        if isinstance(node, str):
            beside.append((node, own and bool(node.strip())))
            continue
        if node.mark:
            continue
        bonus = best.score * 0.2 if node.words and node.words == top.words else 0
        prose = own and node.name in PROSE and bool(node.length) and _density(node) < 0.5
        running = node.name == "p" and node.length > 80 and _density(node) < 0.25
        same = node.name == top.name == "article"
        heading = before and node.length and _density(node) < 0.5 and (node.name in ("h1", "h2") or _holds(node, ("h1",)))
        before = before and node is not top
        beside.append((node, node is top or same or node.score and node.score + bonus >= least or running or prose or bool(heading)))
    first = next(i for i, (_, stays) in enumerate(beside) if stays)
    last = max(i for i, (_, stays) in enumerate(beside) if stays)
    between = lambda i, node: first < i < last and (isinstance(node, str) or bool(node.length) and not _mostly_links(node))
    return [node for i, (node, stays) in enumerate(beside) if stays or between(i, node)]


def _blocks(nodes: list) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                parts.append(item)
            else:
                block = item.name in BLOCKS
                if block:
                    close()
                    stack.append(None)
                stack += [c for c in reversed(item.children) if isinstance(c, str) or not c.mark]
    close()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = build(html)
    order = _in_order(root, ELEMENT)
    _measure(order, ELEMENT)
    _settle(order)
    order = _in_order(root, 0)
    _measure(order, 0)
    best = _best(order)
    if best is None:
        best = root
    waiting = [best]
    while waiting:  # names in the container that may be about its text
        node = waiting.pop()
        if node.mark == VAGUE and not _mostly_links(node):
            node.mark = 0
        waiting += [c for c in node.children if not isinstance(c, str) and c.mark <= VAGUE]
    return "\n\n".join(_blocks(_kept(best)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.decode() if x else None) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "row", "made", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with `text` and `n_chars`, its code points."""
    rows = packed(pages, html_col)
    kept = [c for c in pages.columns if c not in (html_col, *MADE)]
    slim = rows.select("text", F.struct(*(F.col(f"row.`{c}`").alias(c) for c in kept)).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row"))
    schema = T.StructType([slim.schema["text"], slim.schema["row"], T.StructField("made", T.StringType()), T.StructField("n_chars", T.LongType())])
    # the page itself does not travel back
    found = slim.mapInArrow(lambda it: (b.set_column(0, "text", pa.nulls(b.num_rows, pa.binary())) for b in _extracted(it)), schema)
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.col("made").alias("text"), "n_chars")


def op2_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
