"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtide.llm.common import importable

# Element names of HTML, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head textarea title select".split())
NEVER = RAW | frozenset("nav header footer aside form button menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
UNWANTED = re.compile(
    r"(^|[-_])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+"
    r"|signup|sign-up|login|share|sharing|social|related|recommend\w*|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?"
    r"|pagination|pager|comments?|commentlist|disqus|replies|respond|header|masthead|footer|copyright|toolbar|skip|hidden)([-_]|$)",
    re.I,
)
#: Names of places in a layout, which frames around everything also bear.
LAYOUT = re.compile(r"(^|[-_])(sidebar|side-bar|widget|menu|nav|navbar|navigation|header|masthead|footer|toolbar|overlay|skip)([-_]|$)", re.I)
#: Names that say what a page has, not what an element is.
HAS = re.compile(r"(has|have|with|no|without)[-_]", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WHOLE = frozenset("html body article main".split())

# Shares of a page's text from which a named element is taken for a frame around it: layout names, all others.
FRAME_SHARE, OTHER_FRAME_SHARE = 0.5, 0.9

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE_VALUE = re.compile(r"[^\s>]*")
_TAG_END = re.compile(r"[\s/]*>?")
#: Elements whose content is no markup.
TEXT_ONLY = RAW - frozenset("head object select svg math audio video canvas template noscript".split())
_RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I | re.A) for name in TEXT_ONLY}
_BLANK = re.compile(r"\s+")
_STOPS = frozenset("div article section td li body main html blockquote".split())


class Node:
    """An element; children are nodes and strings in page order.

    ``unwanted``: nothing inside counts.  ``doubtful``: its names say so, unless the page's text is inside.
    """

    __slots__ = ("name", "parent", "children", "score", "unwanted", "doubtful", "frame_share", "links", "size", "holds_main", "kept")

    def __init__(self, name: str, parent: Node | None, unwanted: bool = False, doubtful: bool = False, frame_share: float = 1.0) -> None:
        self.name, self.parent = name, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.unwanted, self.doubtful, self.frame_share = unwanted, doubtful, frame_share
        self.links = self.size = 0
        self.holds_main = self.kept = False


class _Reader:
    """Tags of a page, each character read a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none_after = {'"': len(page), "'": len(page)}

    def _quote(self, mark: str, at: int) -> int:
        """Where the next such mark is, or -1; a page without further marks is searched once."""
        if at >= self.none_after[mark]:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none_after[mark] = at
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes in order, the first of a name counts, and the place after the tag.

        A value whose quote is never closed ends with the tag at the next ``>``.
        """
        page, found = self.page, {}
        while match := _ATTRIBUTE.match(page, at):
            at, value = match.end(), ""
            if match[2]:
                mark = page[at : at + 1]
                if mark in self.none_after:
                    end = self._quote(mark, at + 1)
                    if end < 0:
                        return found, page.find(">", at) + 1 or len(page)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE_VALUE.match(page, at)
                    value, at = bare[0], bare.end()
            found.setdefault(match[1].lower(), value)
        return found, _TAG_END.match(page, at).end()


def parse(page: str) -> list[Node]:
    """The elements of any input in page order, the root first.

    Elements left open end where HTML's optional end tags would end them.
    """
    root = Node("html", None)
    nodes, path = [root], [root]
    opened: Counter[str] = Counter()
    reader = _Reader(page)
    at = 0

    def close(depth: int) -> None:
        opened.subtract(n.name for n in path[depth:])
        del path[depth:]

    while match := _MARKUP.search(page, at):
        if match.start() > at:
            path[-1].children.append(page[at : match.start()])
        start = match.start()
        named = _NAME.match(page, start + 1)
        if not named:
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + 1)
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name = named[1].lower()
        attributes, at = reader.attributes(named.end())
        if page[start + 1] == "/":
            close(_closed(path, opened, name))
            continue
        close(_implied(path, opened, name))
        node = _element(name, path[-1], attributes)
        path[-1].children.append(node)
        nodes.append(node)
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
        elif name not in VOID and not (page[at - 2 : at] == "/>" and name in ("svg", "math", "path")):
            path.append(node)
            opened[name] += 1
    if at < len(page):
        path[-1].children.append(page[at:])
    return nodes


def _element(name: str, parent: Node, attributes: dict[str, str]) -> Node:
    if not attributes:
        return Node(name, parent, name in NEVER)
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or "display:none" in _BLANK.sub("", attributes.get("style", "")).lower()
    )
    unwanted = name in NEVER or hidden or attributes.get("role", "").strip().lower() in ROLES
    if unwanted or name in WHOLE:
        return Node(name, parent, unwanted)
    marks = [m for k in ("class", "id") for m in attributes.get(k, "").split() if not HAS.match(m) and UNWANTED.search(m)]
    share = FRAME_SHARE if all(LAYOUT.search(m) for m in marks) else OTHER_FRAME_SHARE
    return Node(name, parent, False, bool(marks), share)


def _closed(path: list[Node], opened: Counter[str], name: str) -> int:
    """How many elements stay open after an end tag."""
    if opened[name] > 0:
        for depth in range(len(path) - 1, 0, -1):
            if path[depth].name == name:
                return depth
            if name not in BLOCK and path[depth].name in BLOCK:
                break  # an inline end tag does not close a block
    return len(path)


def _implied(path: list[Node], opened: Counter[str], name: str) -> int:
    """How many elements stay open before a start tag."""
    if name in ("html", "body"):
        return len(path)
    if name in ENDS_P and opened["p"] > 0:
        for depth in range(len(path) - 1, 0, -1):
            if path[depth].name in _STOPS:
                break
            if path[depth].name == "p":
                return depth
    closes, stops = CLOSED_BY.get(name, ((), ()))
    if any(opened[c] > 0 for c in closes):
        for depth in range(len(path) - 1, 0, -1):
            if path[depth].name in stops:
                break
            if path[depth].name in closes:
                return depth
    return len(path)


def _blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """Text blocks of the wanted part in page order: block element, text, characters in links."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links = 0
    owner = root

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((owner, text, min(links, len(text))))
        parts, links = [], 0

    # An explicit stack: pages may be nested deeper than Python calls may be.
    stack: list[tuple[Node, Iterator, bool, Node]] = [(root, iter(root.children), False, root)]
    while stack:
        node, children, in_link, block = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.name in BLOCK:
                flush()
                owner = stack[-1][3] if stack else root
        elif isinstance(child, str):
            parts.append(child)
            links += len(child.strip()) * in_link
        elif not child.unwanted:
            if child.name in BLOCK:
                flush()
                owner = child
            elif child.name == "br":
                parts.append(" ")
            stack.append((child, iter(child.children), in_link or child.name == "a", child if child.name in BLOCK else block))
    flush()
    return iter(out)


def _weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Characters in links and in all of each element."""
    for node in nodes:
        node.links = node.size = 0
    for block, text, links in blocks:
        block.links += links
        block.size += len(text)
    for node in reversed(nodes):  # children come after their parents
        if node.parent:
            node.parent.links += node.links
            node.parent.size += node.size


def _drop_doubtful(nodes: list[Node]) -> None:
    """Elements named like a page's parts go, but for frames around the page's text.

    A frame holds a ``main``, or, where no ``article`` stands outside such elements, a share of the page's text outside links
    that its name would not have.
    """
    root = nodes[0]
    _weigh(nodes, list(_blocks(root)))
    for node in reversed(nodes):
        if node.parent and not node.unwanted and (node.name == "main" or node.holds_main):
            node.parent.holds_main = True
    article = False
    for node in nodes:  # ``kept`` marks what stands in no doubtful element
        node.kept = not (node.doubtful or node.unwanted) and (node.parent is None or node.parent.kept)
        article = article or (node.kept and node.name in ("article", "main") and node.size > 0)
    for node in nodes:
        node.kept = False
        if node.doubtful and not node.holds_main:
            own = node.size - node.links
            node.unwanted = article or own == 0 or own < node.frame_share * (root.size - root.links)


def main_text(page: str, least: int = 25, sibling_share: float = 0.2) -> str:
    """Blocks of the best container and of its siblings that belong to it, joined by two line ends.

    A block of at least ``least`` characters gives points for its commas and its length to its
    ancestors: all to the parent, half to the next, a sixth to the third, each discounted by the
    share of its characters that stand in links.  The nearest ``article`` or ``main`` gets all of them at any distance, as
    page authors name the whole by it.  The container with most points wins, the outer one of
    equals.  Siblings stay if they have ``sibling_share`` of its points, or, beside a container that is no ``article`` or
    ``main``, are paragraphs with few links.

    The time is linear in the page, also for deep nesting and quotes that are never closed.
    """
    nodes = parse(page)
    root = nodes[0]
    if any(n.doubtful for n in nodes):
        _drop_doubtful(nodes)
    blocks = list(_blocks(root))
    _weigh(nodes, blocks)
    named: dict[int, Node | None] = {}
    for node in nodes:
        named[id(node)] = node if node.name in ("article", "main") else named[id(node.parent)] if node.parent else None
    scored = False
    for block, text, links in blocks:
        if len(text) < least:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
        node: Node | None = block.parent if block.parent and block.name not in ("div", "article", "section", "td", "main", "body", "html") else block
        whole = named[id(block)]
        scored = True
        for share in (1, 1 / 2, 1 / 6):
            if not node:
                break
            node.score += points * (share if node is not whole else 0)
            node = node.parent
        if whole:
            whole.score += points
    if not scored:
        best = _named(nodes)
        best.kept = True
    else:

        def value(node: Node) -> float:
            return node.score * (1 - node.links / node.size if node.size else 1)

        best = max(nodes, key=value)
        best.kept = True
        for sibling in best.parent.children if best.parent else ():
            if isinstance(sibling, Node) and sibling.size and sibling is not best:
                paragraph = sibling.name in ("p", "h1", "h2", "h3", "blockquote", "pre") and sibling.links < 0.25 * sibling.size
                if value(sibling) >= sibling_share * value(best) or (paragraph and best.name not in ("article", "main")):
                    sibling.kept = True
    for node in nodes:
        node.kept = node.kept or bool(node.parent and node.parent.kept)
    return "\n\n".join(t for b, t, _ in blocks if b.kept)


def _named(nodes: list[Node]) -> Node:
    """The first ``article`` with text, else ``main``, else the root: for pages without any long block."""
    return next((n for name in ("article", "main") for n in nodes if n.name == name and n.size), nodes[0])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars`` (code points).

    A null or empty page has an empty text; a very long one takes time in proportion; repeated rows come each; ids and URLs are passed on, null or
    not; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.record_batch({
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    importable(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
