"""HTML extraction by tree scoring.

The page becomes a tree of blocks. Each paragraph passes points to its ancestors: one, one for each comma, one for each 100
characters up to three; the parent gets all of them, the grandparent half, and further ones less. A container's points are
discounted by its link density. The best container is kept (whole, with the article element that it lies in), with those
siblings that score near it or are good paragraphs by themselves: long ones, headings, and short ones that end a sentence and
have no links. Menus, headers and footers of the page, sidebars, notices, adverts, forms, comment sections, scripts and styles
are taken out before: by the element's name, its role, or its class and id names, which are read word by word.

Text: character references are decoded string by string, white space within a block becomes one space, blocks are trimmed and
joined by one space in page order. Nothing else is dropped: formulas and the inner text of embedded objects are inline text.

Null, empty and text-free pages give an empty text. Of containers with equal scores the first in page order wins. Rows that
are repeated each get a row. Very long pages are read whole, in time that grows with their length; nesting beyond ``DEEPEST``
counts as that depth, so hostile pages cost no recursion. An empty table gives an empty one. ``texts`` returns the columns it is
asked to keep beside text and n_chars; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEEPEST = 400

# Names of elements, by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and no text of the page.
RAW = frozenset("script style noscript template textarea title iframe".split())
DROPPED = frozenset("nav aside form button select option label fieldset menu dialog footer".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split()) | HEADINGS
CONTAINERS = frozenset("article body center div html main section td blockquote".split())
LISTS = frozenset("ul ol table dl".split())
#: A start tag closes an open element of these names, as the standard lets their end tags be left out.
CLOSES = {"p": BLOCKS - {"br", "body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class and id names. Those of furniture always count;
FURNITURE = frozenset(
    """ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disqus footer gdpr menu
    modal nav navbar navigation newsletter pager pagination popup related replies reply respond share sharing sidebar sidenav social sponsor sponsored subscribe toolbar tooltip""".split()
)
#: these only where no article word stands behind them, as in ``banner-content``.
LOOSE = frozenset("banner header masthead notice notices promo promoted promotion tag tags widget".split())
ARTICLE = frozenset("article body content entry main page post story text".split())
#: What an article's own header is called after: ``entry-header``, but not ``page-header``.
OWN = frozenset("article content entry post story".split())
#: An article or main element is furniture only if a name of it starts with one of these.
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments related replies reply sidebar sponsored".split())
#: First words, and others, of names that tell of a state: ``has-sidebar``, ``ad-free``, ``comments-open``.
STATES, STATED = frozenset("has hide is no not show with without".split()), frozenset("closed count disabled enabled free off on open".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،、，]")
_STOP = re.compile("[.!?…。！？؟][\"'”’»)\\]]*\\Z")


class Node:
    __slots__ = ("children", "commas", "depth", "furniture", "links", "name", "parent", "points", "size", "weight")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.children: list = []  # nodes and strings
        self.furniture, self.weight, self.points, self.size, self.links, self.commas = False, 0.0, 0.0, 0, 0, 0


def furniture_name(name: str, element: str = "div") -> bool:
    """Whether a class or id name marks what does not belong to an article."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in STATES or words[-1] in STATED:
        return False
    if element in ("article", "main", "body", "html"):
        return element in ("article", "main") and words[0] in NO_ARTICLE
    if not FURNITURE.isdisjoint(words):
        return True
    if LOOSE.isdisjoint(words) or words[-1] in ARTICLE:
        return False
    return not (words[-1] == "header" and len(words) > 1 and words[-2] in OWN)


def _attributes(source: str, node: Node) -> None:
    for m in _ATTRIBUTE.finditer(source):
        key = m[1].lower()
        if key in ("class", "id"):
            value = m[2] or m[3] or m[4] or ""
            if any(furniture_name(name, node.name) for name in value.split()):
                node.furniture = True
            elif any(w.lower() in ARTICLE for w in _WORD.findall(value)):
                node.weight += 25
        elif key == "hidden" or key == "role" and (m[2] or m[3] or m[4] or "").lower() in FURNITURE_ROLES:
            node.furniture = True


def _closed(attributes: str) -> bool:
    """Whether a start tag ends with a slash that is no part of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    _, equals, value = attributes[attributes.rfind(" ") + 1 :].partition("=")
    return not equals or value[:1] in ('"', "'", "/")


def parse(source: str) -> Node:
    """A tree from any markup at all: unclosed and stray tags are put right as browsers would, roughly."""
    root = Node("html", None)
    now, at, n = root, 0, len(source)
    open_names: Counter = Counter()

    def up_to(x: Node) -> Node:
        """Closes x and all that is open in it."""
        y = now
        while True:
            open_names[y.name] -= 1
            if y is x:
                return x.parent
            y = y.parent

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            now.children.append(source[at:])
            break
        if lt > at:
            now.children.append(source[at:lt])
        m = _TOKEN.match(source, lt)
        if m is None:
            now.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if open_names[name] > 0:
                x = now
                while x.name != name:
                    x = x.parent
                now = up_to(x)
            continue
        if name in RAW:
            end = _END[name].search(source, at)
            at = end.end() if end else n
            continue
        for kind, by in CLOSES.items():
            if name in by and open_names[kind] > 0:
                x = now
                while x.parent is not None and x.name != kind and x.name not in CONTAINERS and x.name not in LISTS:
                    x = x.parent
                if x.name == kind:
                    now = up_to(x)
        if name in ("html", "body", "head"):
            if name == "body":
                _attributes(m[3], root)
            continue
        node = Node(name, now)
        _attributes(m[3], node)
        now.children.append(node)
        if name not in VOID and node.depth < DEEPEST and not _closed(m[3]):
            open_names[name] += 1
            now = node
    return root


def _is_furniture(node: Node, inside: bool) -> bool:
    """inside: within an article or main element, whose own header belongs to it."""
    return node.furniture or node.name in DROPPED or node.name == "header" and not inside


def prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.name in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _is_furniture(c, inside)]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]


def _ordered(root: Node) -> list[Node]:
    """Parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def score(root: Node) -> list[Node]:
    """All nodes in page order, with sizes, commas and link characters of what lies below them (running sums), and points."""
    nodes, loose = _ordered(root), {}
    for node in reversed(nodes):
        size = commas = 0
        for c in node.children:
            if isinstance(c, str):
                k = len(_SPACE.sub(" ", c).strip())
                if k:
                    size += k
                    commas += len(_COMMA.findall(c))
                    node.links += k if node.name == "a" else 0
            else:
                node.size += c.size
                node.commas += c.commas
                node.links += c.size if node.name == "a" else c.links
        node.size += size
        node.commas += commas
        if size and node.name in CONTAINERS:
            loose[node] = size, commas
    for node in nodes:
        if node.name == "article":
            node.weight += 50
        elif node.name == "main":
            node.weight += 30
    for node in nodes:
        paragraph = node.name in PARAGRAPHS
        size, commas = (node.size, node.commas) if paragraph else loose.get(node, (0, 0))
        if size:
            points = (1 + commas + min(size / 100, 3)) * (1 - node.links / max(1, node.size))
            up, share = (node.parent if paragraph else node), 1.0
            level = 0
            while up is not None and level < 5:
                if up.name in CONTAINERS:
                    up.points += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (level * 3)
                up = up.parent
    return nodes


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block of these subtrees, in page order."""
    out, now = [], []

    def close():
        if now:
            if text := _SPACE.sub(" ", "".join(now)).strip():
                out.append(text)
            now.clear()

    for top in nodes:
        close()
        stack = [(top, iter(top.children))]
        while stack:
            node, rest = stack[-1]
            for c in rest:
                if isinstance(c, str):
                    now.append(entities.unescape(c))
                else:
                    if c.name in BLOCKS:
                        close()
                    stack.append((c, iter(c.children)))
                    break
            else:
                stack.pop()
                if node.name in BLOCKS:
                    close()
    close()
    return out


def _good(c: Node) -> bool:
    """Whether a paragraph beside the best container belongs to the article."""
    if c.size > 80:
        return c.links <= 0.25 * c.size
    return c.links == 0 and c.size > 0 and (c.name in HEADINGS or _STOP.search(" ".join(blocks([c]))) is not None)


def extract(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    prune(root)
    nodes = score(root)
    rank = lambda x: (x.points + (x.weight if x.points else 0)) * (1 - x.links / max(1, x.size))
    pool = [x for x in nodes if x.name in CONTAINERS and x.points > 0]
    if not pool:
        return " ".join(blocks([root]))
    best = max(pool, key=rank)
    least = max(10.0, 0.2 * rank(best))
    x = best
    while x is not None and x.name != "article":
        x = x.parent
    best = x or best
    if best.parent is None:
        return " ".join(blocks([best]))
    kept = []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        near = c.name in CONTAINERS and rank(c) >= least and c.links <= 0.25 * c.size
        if c is best or near or c.name in PARAGRAPHS and _good(c):
            kept.append(c)
    return " ".join(blocks(kept))


_HTML = "_leafwork_html"


def texts(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, and text and n_chars (code points) of each row's html."""
    common.prepare(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [extract(x) for x in batch.column(_HTML).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*keep, "text", "n_chars"])

    source = pages.select(*keep, F.col("html").cast("string").alias(_HTML))
    schema = source.drop(_HTML).withColumn("text", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")).schema
    return source.mapInArrow(common.by_batch(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(common.table(spark, sf_dir, "pages"), "page_id", "url")
