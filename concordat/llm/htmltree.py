"""Main text of web pages by a site style tree.

Pages are parsed by a forgiving scanner into element trees, and the trees of a
host are merged: two elements are one node of the style tree if all their
ancestors' child sequences agree.  Over the host's stories, an inner node's
importance is the entropy of its presentation styles, to the base of their number;
a leaf's is 1 less the mean entropy of its contents; elements without text below, such as
line breaks and images, take no part.  A story is all pages of a
host with one headline, so that copies of an article do not make it look like a
template; a node of fewer than ``LEAST_STORIES`` has importance 1.  A branch's
composite importance weighs its node against its children (GAMMA per child).

What the markup says of an element is a prior: the chance that it is text.  A
branch stays if its importance is at least 1 less the prior, or if a branch below
it stays.  So an unmarked block of menus, adverts or notices goes if the host repeats
it, within an article as well; an article's paragraph goes only if nearly all
stories have the same one there; a block of which a class word doubtfully speaks of noise
("share-price") stays only if the host varies it.  Where the prior is 0 the tree cannot
keep a branch: in declared menus, footers, sidebars, forms and adverts, whose texts vary
as much as articles do, and outside of a declared article or main part.

The host tables are sums by (host, node): partial sums come first, and a host
of a third of all pages is many nodes, each a few numbers wide.  They are written
before they are joined back, so that the skew of a host's common nodes can be split.

Defined results for odd input: a null or empty page has the empty text; a page
without url belongs to the nameless host; unclosed tags, comments and quotes
end where the page does; a quoted value of any length and content is no text; an
importance equal to the bound keeps its branch; pages of any length are read whole;
repeated rows give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches

GAMMA = 0.9
#: Stories of a host that must have a node before it can be of low importance.
LEAST_STORIES = 3
#: The chance that an element is text: of an article's or main part's text elements, of any
#: other, and of one of which a class word doubtfully speaks of noise.
ARTICLE_TEXT, PLAIN, DOUBTFUL = 0.95, 0.7, 0.3

RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open element that such a start tag closes, and where the search for it ends.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

NOISE_TAGS = RAW | frozenset("head nav aside footer form button select input fieldset object embed applet canvas audio video dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification popup modal "
    "newsletter subscribe subscription signup sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments disqus respond reply replies "
    "discussion share sharing social related recommended recommendations teaser teasers toolbar pagination pager login search searchbox form skiplink skip".split()
)
#: Words that say nothing beside a noise word: "site-footer" is a footer, "share-price" perhaps no share button.
FILLER_WORDS = frozenset("a area bar block body bottom box btn button buttons center col column container content desktop fixed global group header heading holder inner item items left "
    "line link links list main mobile module nav page panel post primary right row section secondary site slot sticky sub text title top unit wrap wrapper zone".split())
#: Only outside of an article: within it a header holds the headline.
OUTER_WORDS = frozenset("header masthead topbar".split())

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: From a tag's name to the ">" that ends it.  Only a quote after "=" opens a quoted
#: value, which only the same quote or the page's end closes.
_TAG_REST = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+))?+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("children", "doubt", "label", "noise", "parent", "parts", "tag")

    def __init__(self, tag: str, label: str, noise: int, doubt: bool, parent: Node | None):
        self.tag, self.label, self.noise, self.doubt, self.parent = tag, label, noise, doubt, parent
        self.children: list[Node] = []
        self.parts: list[Node | str] = []  # children and texts in order


def _declared(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(label of an element, 0 for text, 1 for noise, 2 for noise outside articles, 3 for the main part,
    whether a class word casts doubt)."""
    noise = 1 if tag in NOISE_TAGS else 2 if tag == "header" else 3 if tag in ("article", "main") else 0
    doubt = False
    label = tag
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                label += f" {name}={value}"
                if tag in ("html", "body"):
                    continue
                for name_ in value.split():
                    words = {w.lower() for w in _WORDS.findall(name_)}
                    if words & NOISE_WORDS and words <= NOISE_WORDS | FILLER_WORDS | OUTER_WORDS:
                        noise = 1
                    elif noise == 0 and words & OUTER_WORDS and words <= OUTER_WORDS | FILLER_WORDS:
                        noise = 2
                    doubt |= bool(words & (NOISE_WORDS | OUTER_WORDS))
            elif name == "role" and value:
                role = value.lower().strip()
                if role in NOISE_ROLES:
                    noise = 2 if role == "banner" else 1
                elif role in ("main", "article") and noise != 1:
                    noise = 3
            elif name == "itemprop" and value.lower() == "articlebody" and noise != 1:
                noise = 3
    return label, noise, doubt


def parse(page: str) -> tuple[Node, list[Node]]:
    """(root, elements in order) of a page."""
    root = Node("", "", 0, False, None)
    here, nodes, at, n = root, [], 0, len(page)
    known: dict[tuple[str, str], tuple[str, int, bool]] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            here.parts.append(html.unescape(text) if "&" in text else text)
        if lt == n:
            break
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:  # a bogus comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                here.parts.append("<")
                at = lt + 1
            continue
        close = _TAG_REST.match(page, m.end())
        if close is None:
            break
        end = close.end() - 1
        tag, at = m[0].lower(), end + 1
        if closing:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag not in INLINE:
                here.parts.append(" ")
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            targets, stops = IMPLIED.get(tag, ({"p"}, {"article", "body", "td", "th", "table", "button", "div", "section", "li"}))
            node, last = here, None
            while node is not root and node.tag not in stops:
                if node.tag in targets:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        attributes = page[m.end() : end]
        key = tag, attributes
        if key not in known:
            known[key] = _declared(tag, attributes)
        node = Node(tag, *known[key], here)
        here.children.append(node)
        here.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if close is None:
                at = n
            else:
                end = page.find(">", close.start())
                at = n if end < 0 else end + 1
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
        elif attributes.endswith("/") and tag not in VOID:
            here = node  # html has no self-closing elements
    return root, nodes


def _main_parts(nodes: list[Node]) -> list[Node]:
    """The declared articles, else the declared main parts; none within noise or each other."""
    found = {}
    for node in nodes:
        if node.noise == 3:
            up = node.parent
            while up is not None and up.noise != 1:
                up = up.parent
            if up is None:
                found[id(node)] = node
    articles = [x for x in found.values() if x.tag == "article"]
    out = articles or list(found.values())
    chosen = {id(x) for x in out}

    def inner(node):
        up = node.parent
        while up is not None:
            if id(up) in chosen:
                return True
            up = up.parent
        return False

    return [x for x in out if not inner(x)]


def _collect(node: Node, outer: bool, gone: set[int], out: list[str]) -> None:
    """Texts below a node in page order; a block's edges are spaces."""
    stack = [iter(node.parts)]
    spaces = [" "]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                out.append(part)
                continue
            if part.noise == 1 or (outer and part.noise == 2) or id(part) in gone:
                out.append(" " if part.tag not in INLINE else "")
                continue
            space = "" if part.tag in INLINE else " "
            out.append(space)
            stack.append(iter(part.parts))
            spaces.append(space)
            break
        else:
            stack.pop()
            out.append(spaces.pop())


def main_text(page: str | None, low: dict[int, float] | None = None) -> str:
    """The text of a page; low: importances under 1 by element number."""
    if not page:
        return ""
    root, nodes = parse(page)
    parts, out = _main_parts(nodes), []
    gone = _low_branches(nodes, low or {}, parts)
    for part in parts or [root]:
        _collect(part, not parts, gone, out)
        out.append(" ")
    return " ".join("".join(out).split())


#: Elements that hold an article's text.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption br hr hgroup header address details summary".split())


def _within(nodes: list[Node], parts: list[Node]) -> set[int]:
    """The elements of the main parts, themselves included."""
    out = {id(x) for x in parts}
    for node in nodes:  # parents come first
        if id(node.parent) in out:
            out.add(id(node))
    return out


def prior(node: Node, within: bool) -> float:
    """The chance that an element is text, as far as its markup tells."""
    if node.noise == 1:
        return 0.0
    if node.doubt:
        return DOUBTFUL
    return ARTICLE_TEXT if within and node.tag in TEXT_TAGS else PLAIN


def _own_text(node: Node) -> str:
    return " ".join("".join(p for p in node.parts if isinstance(p, str)).split())


def _with_text(nodes: list[Node]) -> set[int]:
    """The elements with text of their own or below, declared noise left out.  The others
    (line breaks, images, spacers) say nothing of a branch and lose nothing with it."""
    out: set[int] = set()
    for node in reversed(nodes):  # children come after their parents
        if node.noise != 1 and (any(id(x) in out for x in node.children) or _own_text(node)):
            out.add(id(node))
    return out


def _low_branches(nodes: list[Node], low: dict[int, float], parts: list[Node] = ()) -> set[int]:
    """Elements whose composite importance is under 1 - prior and that hold none that stays."""
    if not low:
        return set()
    within, texted = _within(nodes, parts), _with_text(nodes)
    composite: dict[int, float] = {}
    gone: set[int] = set()
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        c, below = low.get(i, 1.0), [x for x in node.children if id(x) in texted]
        if below:
            weight = GAMMA ** len(below)
            c = (1 - weight) * c + weight * sum(composite[id(x)] for x in below) / len(below)
        composite[id(node)] = c
        if c < 1 - prior(node, id(node) in within) and all(id(x) in gone for x in below):
            gone.add(id(node))
    return gone


def story_of(nodes: list[Node]) -> str:
    """The page's headline: the first h1, else h2, else title, with text; else nothing."""
    for tag in ("h1", "h2", "title"):
        for node in nodes:
            if node.tag == tag:
                out: list[str] = []
                _collect(node, False, set(), out)
                if text := " ".join("".join(out).split()):
                    return text
    return ""


def style_nodes(page: str | None) -> list[tuple[int, str, str, int, str, float | None]]:
    """(element number, path, feature, 1 for content, story, bound) of the elements with
    text that are not below declared noise.

    The feature is the sequence of child labels, or for an element with text of
    its own that text and its label.  An element that ends a branch goes if its importance
    is under the bound; other elements' bound is 0, as they go only with one that ends a
    branch; elements outside of a page's main parts have none, as their texts are never
    collected, whatever the tree says.
    """
    if not page:
        return []
    root, nodes = parse(page)
    story = story_of(nodes) or page
    parts = _main_parts(nodes)
    inside, texted = _within(nodes, parts), _with_text(nodes)

    def bound(node: Node) -> float | None:
        if parts and id(node) not in inside:
            return None
        return 0.0 if any(id(x) in texted for x in node.children) else 1 - prior(node, id(node) in inside)

    style = lambda node: "|".join(x.label for x in node.children)
    known = {id(root): ("", style(root), False)}  # path, style, whether within declared noise
    seen: dict[int, int] = {}
    out = []
    for i, node in enumerate(nodes):
        up = id(node.parent)
        key, styles, hidden = known[up]
        place = seen[up] = seen.get(up, -1) + 1
        if hidden or node.noise == 1:
            known[id(node)] = ("", "", True)
            continue
        key = xxhash.xxh3_128_hexdigest(f"{key}\0{styles}\0{place}")
        styles = style(node)
        known[id(node)] = (key, styles, False)
        if id(node) not in texted:
            continue
        own = _own_text(node)
        content = bool(own)
        out.append((i, key, f"{node.label}\0{own}" if content else styles, int(content), story, bound(node)))
    return out


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """page and id (of a page), number, node (of its host), feature, leaf, story, bound."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            at, rows = [], []
            for i, (url, page) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                host = host_of(url)
                own = [(number, _hash(f"{host}\0{key}"), _hash(feature), leaf, _hash(story) >> 32, bound) for number, key, feature, leaf, story, bound in style_nodes(page)]
                at += [i] * len(own)
                rows += own
            cols = list(zip(*rows, strict=True)) or [()] * 6
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page", "id", "number", "node", "feature", "leaf", "story", "bound"])

    rows = pages.select("_page", F.col("page_id").cast("string"), "url", "html")
    return rows.mapInArrow(run, "page long, id string, number int, node long, feature long, leaf int, story int, bound double")


def importances(parsed: DataFrame) -> DataFrame:
    """node, importance of the merged trees; from 1 - DOUBTFUL, the highest bound, on it counts as 1.

    With m stories that have a node and c of them alike in a feature, presentation
    entropy is the mean of -log_m(c / m) over them, and a content's entropy is log_m(c).
    A story of several features counts once for each.
    """
    once = parsed.groupBy("node", "leaf", "feature", "story").agg(F.lit(1).alias("_"))
    alike = once.groupBy("node", "leaf", "feature").agg(F.count(F.lit(1)).alias("c"))
    sums = alike.groupBy("node").agg(
        F.sum("c").alias("m"),
        F.sum(F.col("c") * F.log("c")).alias("c_log_c"),
        F.sum(F.log("c")).alias("log_c"),
        F.count(F.lit(1)).alias("features"),
        F.max("leaf").alias("leaf"),
    )
    m = F.log("m")
    inner = (m - F.col("c_log_c") / F.col("m")) / m
    leaf = 1 - F.col("log_c") / F.col("features") / m
    out = sums.filter(F.col("m") >= LEAST_STORIES).select("node", F.when(F.col("leaf") == 1, leaf).otherwise(inner).alias("importance"))
    return out.filter(F.col("importance") < 1 - DOUBTFUL)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("_page"))
    parsed = materialize(_parsed(keyed), "html-nodes")
    found = materialize(importances(parsed), "html-importances")
    # A page's own elements, as often as its row comes; a page none of whose branches ends
    # under its bound loses nothing and needs none of them.
    low = parsed.filter("bound is not null").join(found, "node").groupBy("page", "id")
    low = low.agg(F.collect_set(F.struct("number", "importance")).alias("low"), F.max(F.col("importance") < F.col("bound")).alias("loses"))
    low = materialize(low.filter("loses").select("page", "id", "low"), "html-low")
    rows = keyed.join(low, (F.col("_page") == F.col("page")) & F.col("page_id").cast("string").eqNullSafe(F.col("id")), "left")
    return text_of(rows.select("page_id", "url", "html", F.col("low.number").alias("number"), F.col("low.importance").alias("importance")))


def text_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, dict(zip(number or (), importance or (), strict=True))) for page, number, importance in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
