"""Main text of web pages by tree scoring.

Elements that are furniture by kind, role or state, and readers' comments, are left out; where only the words of a
class or id say so, an element goes unless it holds more than half of the page's prose.  Paragraphs pass points for length and commas to their ancestors: all of them to the parent, half to the
grandparent, a share that falls with distance above.  A container's points are discounted by its link density; the best
one is found.  The article or main element around it is kept whole; where there is none, the headings, paragraphs, lists, tables,
figures, sections and texts beside it and beside its ancestors are kept too if few of their letters are linked.  Siblings
that score well enough or are plain paragraphs are always kept.

Defined results: a null or empty page gives an empty text; pages without scored paragraphs give what is left
of the body; ties go to the container that comes first; repeated rows are extracted each; an empty table gives an
empty result; extra columns are ignored; broken and hostile markup (tags or quotes that never close, end tags without a
beginning, deep nesting) takes time in proportion to the page.
"""

from __future__ import annotations

import html as codec
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the language, and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg math object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form button select option input menu dialog audio video applet".split())
READERS = frozenset("comment comments commentlist disqus discussion replies reply respond shoutbox".split())
FURNITURE = READERS | frozenset("ad ads adv advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline cookie cookies consent footer foot gdpr login masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related rss share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEEPERS = frozenset("article body html main".split())
WORTH = {"article": 25, "main": 20, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "address": -3, "th": -5}
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
CONTENT = frozenset("p pre blockquote ul ol dl table figure section hgroup details h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ABOUT = frozenset("has with no without hide show left right".split())  # such a word before says what a container has or lacks
MIN_PARAGRAPH, MAX_LINKED, BODY = 25, 0.33, 0.5

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
_TOKEN = re.compile(_OTHER + r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_PLAIN = re.compile(_OTHER + r"([^>]*)>", re.DOTALL)  # where a quote never closes
_OPEN = re.compile(r"<[A-Za-z/!?]")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_P_FENCES = frozenset("div article section main aside body html td th li dd blockquote figure table form header footer nav button details".split())


class Node:
    __slots__ = ("tag", "children", "parent", "length", "linked", "score", "scored", "doubt", "prose")

    def __init__(self, tag: str, parent: Node | None, doubt: bool = False):
        self.tag, self.parent, self.children, self.doubt = tag, parent, [], doubt
        self.length = self.linked = self.prose = 0
        self.score, self.scored = 0.0, False


def _words_of(tag: str, value: str) -> set[str]:
    """The words of a class or id that may name furniture.

    A paragraph's or heading's class counts only as a whole; a word after one like "has" or "no" describes what is around.
    """
    out: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if tag in HEADINGS or tag == "p":
            out |= set(words) if len(words) == 1 else set()
        else:
            out |= {w for k, w in enumerate(words) if not k or words[k - 1] not in ABOUT}
    return out


def _unwanted(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture by its kind, role or state; and whether the words of its class and id say so.

    Words alone are a doubt that the text below may settle, unless they name readers' comments. Ids of headings and
    paragraphs, and all ids in an article, are places in the text whose names come from titles.
    """
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, False
    if not attrs or tag in KEEPERS:
        return False, False
    doubt = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True, False
        if name == "id" and (inside_article or tag == "p" or tag in HEADINGS):
            continue
        if name in ("class", "id"):
            named = _words_of(tag, value) & FURNITURE
            if named & READERS:
                return True, False
            doubt |= bool(named)
    return False, doubt


class _Stack:
    """Open elements, and where those of each name are, so that no step looks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}
        self.skipping = self.article = 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag.lstrip("!"), []).append(len(self.nodes))
        self.nodes.append(node)
        self.skipping += node.tag[0] == "!"
        self.article += node.tag in ("article", "main")

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def pop(self, to: int) -> None:
        for node in self.nodes[to:]:
            self.places[node.tag.lstrip("!")].pop()
            self.skipping -= node.tag[0] == "!"
            self.article -= node.tag in ("article", "main")
        del self.nodes[to:]

    def close(self, names, fences) -> None:
        """End the last of ``names`` unless one of ``fences`` is open in it."""
        at = self.last(names)
        if at and at > self.last(fences):
            self.pop(at)


def parse(page: str) -> Node:
    """A tree of wanted nodes; children are nodes and strings with character references decoded."""
    root = Node("html", None)
    stack, at, token = _Stack(root), 0, _TOKEN

    def text(piece: str) -> None:
        if piece and not stack.skipping:
            stack.nodes[-1].children.append(codec.unescape(piece) if "&" in piece else piece)

    while True:
        begin = _OPEN.search(page, at)
        if not begin:
            text(page[at:])
            return root
        m = token.match(page, begin.start())
        if not m and token is _TOKEN and page[begin.start() + 1] not in "!?":
            plain = _PLAIN.match(page, begin.start())
            if plain:  # a quote that never closes: from here on quotes are as other characters
                token, m = _PLAIN, plain
            elif page.find(">", begin.start()) < 0:  # no tag ends any more
                text(page[at:])
                return root
        if not m:
            text(page[at : begin.start() + 2])
            at = begin.start() + 2
            if token is _PLAIN and page.find(">", at) < 0:
                text(page[at:])
                return root
            continue
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = stack.last((tag,))
            if k and (tag in BLOCK or k >= stack.last(("td", "th", "article", "main"))):
                stack.pop(k)
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            if not stack.skipping:
                stack.nodes[-1].children.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:  # a block ends an open paragraph, and some blocks end their like
            stack.close(("p",), _P_FENCES)
        if tag in _CLOSED_BY:
            stack.close(_CLOSED_BY[tag], _FENCES[tag])
        if tag in VOID:
            if not stack.skipping:
                stack.nodes[-1].children.append(Node(tag, stack.nodes[-1]) if tag == "hr" else " ")
            continue
        if m[3].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        unwanted, doubt = _unwanted(tag, m[3], stack.article > 0)
        node = Node("!" + tag if unwanted else tag, stack.nodes[-1], doubt)
        if not unwanted and not stack.skipping:
            stack.nodes[-1].children.append(node)
        stack.push(node)


def _settle(root: Node) -> None:
    """Take out the nodes whose names say furniture, but for those that hold most of the prose around them."""
    nodes = _order(root)
    for node in reversed(nodes):
        below = sum(c.prose for c in node.children if isinstance(c, Node))
        if node.tag in PARAGRAPHS or node.tag == "div":
            text, blocks = _own_text(node)
            if len(text) >= MIN_PARAGRAPH and not (blocks and node.tag == "div"):
                below += len(text)
        node.prose = 0 if node.tag == "a" else below
    # an article or main element that no doubt hangs over is where the prose is looked for
    placed, clear = {id(root): ""}, False
    for node in nodes:
        at = placed[id(node)] or ("article" if node.tag in ("article", "main") else "")
        clear |= at == "article"
        for c in node.children:
            if isinstance(c, Node):
                placed[id(c)] = "doubt" if c.doubt and not at else at
    for node in nodes:
        if any(isinstance(c, Node) and c.doubt for c in node.children):
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.doubt) or c.prose > BODY * root.prose and (not clear or placed[id(c)] == "article")]


def _order(root: Node) -> list[Node]:
    """Nodes in page order, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _own_text(node: Node) -> tuple[str, bool]:
    """A node's text below inline elements, and whether a block stands in it."""
    parts, blocks, todo = [], False, list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag in BLOCK:
            blocks = True
        else:
            todo.extend(reversed(c.children))
    return " ".join("".join(parts).split()), blocks


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.length = sum(len(c) if isinstance(c, str) else c.length for c in node.children)
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in node.children if isinstance(c, Node))


def _give(node: Node, points: float) -> None:
    if not node.scored:
        node.scored, node.score = True, WORTH.get(node.tag, 0)
    node.score += points


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _best(nodes: list[Node]) -> Node | None:
    for node in nodes:
        own = node.tag in PARAGRAPHS or node.tag == "div"
        if not own or not node.parent:
            continue
        text, blocks = _own_text(node)
        if node.tag == "div" and blocks and len(text) < 80 or len(text) < MIN_PARAGRAPH:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up, level = (node if node.tag == "div" else node.parent), 0
        while up is not None and level < 6:
            _give(up, points / (1, 2, 6, 9, 12, 15)[level])
            up, level = up.parent, level + 1
    best = None
    for node in nodes:
        if node.scored:
            node.score *= 1 - _density(node)
            if best is None or node.score > best.score:
                best = node
    return best


def _content(c: Node) -> bool:
    """Whether a neighbour of the main text looks like a part of it."""
    if not c.length or c.tag not in HEADINGS and _density(c) > MAX_LINKED:
        return False
    if c.tag in CONTENT or c.tag not in BLOCK:
        return True
    return any(x.tag in CONTENT for x in _order(c))  # a div of bare words is seldom a part


def _kept(best: Node) -> list[Node | str | None]:
    """What belongs to the article, in page order; None ends a line."""
    least, top = max(10.0, best.score * 0.2), best
    while top is not None and top.tag not in ("article", "main"):
        top = top.parent
    whole = top is not None
    node = top if whole else best
    out: list[Node | str | None] = [node]
    while node.parent is not None:
        before, after = [], []
        side = before
        for c in node.parent.children:
            if c is node:
                side = after
            elif isinstance(c, str):
                if not whole and node.tag != "td":
                    side.append(c)
            else:
                plain = c.tag == "p" and (c.length > 80 and _density(c) < 0.25 or 0 < c.length <= 80 and not c.linked and "." in _own_text(c)[0])
                near = node.tag not in ("td", "th", "tr") and _content(c)  # cells and rows beside it are columns of the page
                if plain or c.scored and c.score >= least or near and not whole:
                    side.append(c)
        if before or after:
            out = [*before, None, *out, None, *after]
        if whole:
            break
        node = node.parent
    return out


def _blocks(nodes: list[Node | str | None], whole: bool) -> list[str]:
    """Lines of text; outside an article element, lists and containers that are mostly links are menus."""
    out: list[str] = []
    parts: list[str] = []
    own = {id(c) for c in nodes}

    def end() -> None:
        line = " ".join("".join(parts).split())
        if line:
            out.append(line)
        parts.clear()

    todo: list = list(reversed(nodes))
    while todo:
        c = todo.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            parts.append(c)
        elif not whole and c.tag in ("ul", "ol", "dl", "table", "div", "section") and c.length and _density(c) > 0.6 and id(c) not in own:
            end()
        elif c.tag in BLOCK:
            end()
            todo.append(None)
            todo.extend(reversed(c.children))
        else:
            todo.extend(reversed(c.children))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: one line for each block."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    nodes = _order(root)
    _measure(nodes)
    best = _best(nodes)
    if not best:
        return "\n".join(_blocks([root], False))
    kept = _kept(best)
    return "\n".join(_blocks(kept, any(isinstance(c, Node) and c.tag in ("article", "main") for c in kept)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
