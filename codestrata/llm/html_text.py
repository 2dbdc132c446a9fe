"""Main text of web pages by composite text density.

A page is read into a tree (implied end tags as browsers close them; unclosed
and cut pages end where they end). Left out from the start is what cannot be text
of the page: scripts, styles, form controls, embedded objects, hidden parts. Then
each element has

    density = C/T * log_b( C/L * T/K ),   b = ln(C/(C-L) * L + Lb/Cb * C + e)

with C its characters, T its tags, L its link characters, K its link tags and
Cb, Lb the body's characters and link characters (0 counts as 1), so links make
an element thin. The block with the greatest sum of its children's densities (its
own bare text counts as a child) is the main block; of equal sums the innermost. The
least density on the path from it up to the body is the threshold: blocks that
reach it elsewhere on the page are content too. A main block inside an
``article`` (or else a ``main`` element) brings in that whole element, whose
headings and short blocks may be thin, but for lists of links in it; so does any
other article with a block as dense as those of this one are on average. Of a ``main`` element around an article
the ``h1`` comes too, the rest as elsewhere.

Adverts, notices and reader comments are often as dense as paragraphs, so what a
page itself names by tag, role, class or id as such counts as link text: it has
density 0, makes what holds it thin and is left out. Of a class or id the last
telling word counts ("comment-list" names comments, "legal-analysis" an analysis).
Class and id names count for containers only; for paragraphs and headings only names of adverts do, for inline
elements only outside running text. Not so named are: a form that holds most of the
page's text, what stands around an article or a main heading, and, on pages
without one, what holds most of the text.

Text. Character references are decoded, white space inside a block is one space,
blocks are trimmed and joined in page order by one line feed.

Defined cases: null and empty pages, and pages without text, give the empty
text; rows are neither merged nor dropped; nothing of a block is cut. Work and
memory are linear in the page however deep it nests; the tree is walked without
recursion.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codestrata.llm.arrow import column, map_rows

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements that may hold an article; the main block is one of these.
HOLDERS = frozenset("article body center dd div form html main section table tbody td tr".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body button caption html legend optgroup option tbody td tfoot th thead tr".split())
#: Start tags that end an open element of the listed names, up to the boundary names.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table body".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table body".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table body".split())),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "body"])),
    "td": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table", "body"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table", "body"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table", "body"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "body"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "body"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
SCOPE = frozenset("table td th caption button object applet marquee template html".split())
#: Elements that are never text of the page.
DROPPED = frozenset(
    "script style noscript template head title meta link iframe object embed applet canvas svg math audio video map button input select textarea datalist noembed noframes".split()
)
#: Tags and roles by which a page names what is no part of the article.
ASIDE = frozenset("nav footer aside form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note tablist".split())
#: Words of class and id values (split at case changes and signs) that do so.
NAMED = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs sidebar aside rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe "
    "subscription signup login register share sharing social follow comment comments commentlist reply replies respond disqus discussion reactions related recommended "
    "recommendations recirc trending popular widget pagination pager copyright disclaimer legal paywall skip tags tagcloud toc search hidden userposts usercomments ugc guestbook".split()
)
#: Words that may follow such a word in a name ("comment-list", "ad-slot-2"); others make it a name of something else ("legal-analysis").
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom bottombar box boxes btn button buttons card cards cell col column container content count embed entry feed form frame group head header heading hero holder icon icons inner "
    "input item items label layer layout left link links list main message module news note outer page panel post posts region right row section sections sidebar slot small large space stories story strip tab text thread tile title top "
    "topics unit view wrap wrapper zone bloc boxed sticky fixed dialog".split()
)
ADVERTS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted cookie cookies newsletter".split())
#: Blocks of running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption summary".split())
KEPT_TAGS = frozenset("html body main h1".split())
#: Containers that are lists of links from so many links on.
LINK_LISTS, MANY_LINKS = frozenset("div ul ol section menu dl table".split()), 4
#: The share of a page's characters from which an element is the page rather than a part beside the article.
MOST = 0.8

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|(\Z))|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|(\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("_running", "attributes", "children", "dropped", "name", "parent")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Node | str] = []
        self.dropped = False
        self._running: bool | None = None

    def running(self) -> bool:
        """Whether text stands among the children; looked up once, when the tree is whole."""
        if self._running is None:
            self._running = any(isinstance(c, str) and not c.isspace() for c in self.children)
        return self._running


def parse(page: str) -> Node:
    """The page's tree. Children are nodes and decoded texts in page order."""
    root = Node("html", None)
    stack = [root]
    places: dict[str, list[int]] = {}  # of each name the open elements' places in the stack

    def nearest(names: frozenset[str]) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(k: int) -> None:
        """Closes the element at a place and all inside it."""
        for node in stack[k:]:
            places[node.name].pop()
        del stack[k:]

    def close_to(names: frozenset[str], limits: frozenset[str]) -> bool:
        """Closes the innermost open element of these names, unless a limit is nearer."""
        k = nearest(names)
        if k and k >= nearest(limits):
            close(k)
            return True
        return False

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, cut_end, opening, attributes, cut = found.groups()
        if cut_end is not None or cut is not None:
            break  # the page ends inside a tag
        if closing:
            name = closing.lower()
            if name not in ("html", "body"):
                close_to(frozenset([name]), frozenset(["table"]) if name != "table" else frozenset())
            continue
        if not opening:
            continue
        name = opening.lower()
        if name == "html":
            root.attributes = root.attributes or attributes
            continue
        if name in ENDS_P:
            close_to(frozenset(["p"]), SCOPE)
        if name in IMPLIED:
            names, limits = IMPLIED[name]
            while close_to(names, limits) and name in ("tr", "tbody", "thead", "tfoot"):
                pass
        node = Node(name, stack[-1], attributes)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if body:
                node.children.append(body)
            continue
        if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def hidden(node: Node) -> bool:
    """Whether the element is not shown."""
    if not node.attributes or node.name in KEPT_TAGS:
        return False
    found = _attributes(node.attributes)
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def named(node: Node) -> bool:
    """Whether class or id name the element as no part of the article."""
    if not node.attributes or node.name in KEPT_TAGS:
        return False
    if node.name in TEXTUAL:
        names = ADVERTS
    elif node.name in BLOCKS:
        names = NAMED
    elif node.parent is None or node.parent.name in TEXTUAL or node.parent.running():
        return False  # inside running text
    else:
        names = NAMED
    found = _attributes(node.attributes)
    return any(_says(token, names) for token in f"{found.get('class', '')} {found.get('id', '')}".split())


def _says(token: str, names: frozenset[str]) -> bool:
    """Whether one class or id says so: a word of ``names`` that nothing but plain words and numbers follow."""
    for word in reversed(_PART.findall(token)):
        if word.lower() in names:
            return True
        if word.lower() not in PLAIN_WORDS and not word.isdigit() and len(word) > 1:
            return False
    return False


def aside(node: Node, in_article: bool) -> bool:
    """Whether tag or role name the element as no part of the article."""
    if node.name in ASIDE or (node.name == "header" and not in_article):
        return True
    return bool(node.attributes) and node.name not in KEPT_TAGS and _attributes(node.attributes).get("role", "").lower() in ASIDE_ROLES


class _Measures:
    __slots__ = ("chars", "density", "link_chars", "link_tags", "own", "tags", "total")

    def __init__(self) -> None:
        self.chars = self.own = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _density(m: _Measures, body: _Measures) -> float:
    if not m.chars:
        return 0.0
    tags, links, link_tags = max(m.tags, 1), max(m.link_chars, 1), max(m.link_tags, 1)
    plain = max(m.chars - m.link_chars, 1)
    base = math.log(m.chars / plain * m.link_chars + body.link_chars / max(body.chars, 1) * m.chars + math.e)
    inner = m.chars / links * tags / link_tags
    return m.chars / tags * (math.log(max(inner, 1.0)) / math.log(base) if base > 1 else math.log(max(inner, 1.0)))


def _around(root: Node) -> tuple[set[Node], bool]:
    """(what stands around the page's article marks, whether it has any).

    Elements around the article keep their place whatever their names ("layout with-sidebar"): if every element that
    marks an article stands inside named ones, those inside the fewest keep what is around them.
    """
    marks: list[tuple[int, Node]] = []
    walk = [(root, 0)]
    while walk:
        node, inside = walk.pop()
        if node is not root and (node.name in DROPPED or node.name == "header" or (node.name in ASIDE and node.name != "form")):
            continue
        own = named(node) or node.name == "form"
        if node.name in ("main", "h1") or (node.name == "article" and not own):
            marks.append((inside, node))
        walk.extend((c, inside + own) for c in node.children if isinstance(c, Node))
    least = min((n for n, _ in marks), default=0)
    around: set[Node] = set()
    for inside, node in marks if least else []:
        up = node.parent if inside == least else None
        while up is not None and up not in around:
            around.add(up)
            up = up.parent
    return around, bool(marks)


def _measured(order: list[Node], thin: set[Node]) -> dict[Node, _Measures]:
    """The nodes' characters and tags; those of links and of ``thin`` elements as link characters and link tags."""
    measures: dict[Node, _Measures] = {}
    for node in reversed(order):  # children before parents
        m = measures[node] = _Measures()
        for child in node.children:
            if isinstance(child, str):
                m.own += len(_SPACE.sub("", child))
            elif not child.dropped:
                c = measures[child]
                m.chars += c.chars
                m.link_chars += c.link_chars
                m.tags += c.tags + 1
                m.link_tags += c.link_tags
        m.chars += m.own
        if node in thin:
            m.link_chars, m.link_tags = m.chars, m.tags + 1
        elif node.name == "a":
            m.link_chars, m.link_tags = m.chars, m.link_tags + 1
    return measures


def content_roots(root: Node) -> list[Node]:
    """The subtrees that make the main text, in page order; what they leave out is marked."""
    order: list[Node] = []
    articles: set[Node] = set()  # inside an article
    stack = [root]
    while stack:
        node = stack.pop()
        if node is not root and (node.name in DROPPED or hidden(node)):
            node.dropped = True
            continue
        order.append(node)
        if node.parent in articles or node.name in ("article", "main"):
            articles.add(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    body = next((n for n in order if n.name == "body"), root)
    plain = _measured(order, set())
    around, marked = _around(root)
    # What the page names as no part of the article, and all inside it.
    thin: set[Node] = set()
    for node in order:
        if node is root or node.parent in thin:
            if node is not root:
                thin.add(node)
        elif node not in around:
            share = plain[node].chars / max(plain[body].chars, 1)
            if aside(node, node.parent in articles):
                beside = node.name != "form" or share * 2 <= 1
            else:
                beside = named(node) and (marked or share < MOST)
            if beside:
                thin.add(node)
    measures = _measured(order, thin)
    whole = measures[body]
    if not any(measures[n].own for n in order if n not in thin):
        return []
    for node in order:
        measures[node].density = _density(measures[node], whole)
    for node in order:
        m, own = measures[node], _Measures()
        own.chars = m.own
        m.total = _density(own, whole) + sum(measures[c].density for c in node.children if isinstance(c, Node) and not c.dropped)
    able = [n for n in order if n.name in HOLDERS and n not in thin and measures[n].chars]
    if not able:
        return []
    best = max(reversed(able), key=lambda n: measures[n].total)
    threshold, node = measures[best].density, best
    while node is not body and node.parent is not None:
        threshold = min(threshold, measures[node].density)
        node = node.parent
    for node in thin:
        node.dropped = measures[node].density <= 0 or measures[node].density < threshold
    able_text = lambda n: n.name in BLOCKS and measures[n].chars and not n.dropped and not _links(measures[n])
    # The article around the main block comes in whole; only where there is none, its main element.
    lifted, node = {}, best
    while node is not None:
        if node.name in ("article", "main"):
            lifted[node.name] = node
        node = node.parent
    best = lifted.get("article") or lifted.get("main") or best
    above, node = set(), best.parent
    while node is not None:
        above.add(node)
        node = node.parent
    # So does any other article with a block as dense as this one's are on average; and the heading that a main element has beside its article.
    whole_ones, usual = _other_articles([n for n in order if able_text(n)], best, measures)
    if best.name == "article":
        threshold = max(threshold, usual)  # beside an article only what is as dense as its text
    outer = lifted.get("main")
    roots, inside, in_main = [], set(), set()
    for node in order:
        if node is outer or node.parent in in_main:
            in_main.add(node)
        if node.parent in inside:
            inside.add(node)
        elif node.dropped or node in above:
            continue
        elif node is best or (able_text(node) and (measures[node].density >= threshold or node in whole_ones or (node.name == "h1" and node in in_main))):
            roots.append(node)
            inside.add(node)
    if best.name in ("article", "main"):
        _drop_lists_of_links(best, measures)
    return roots


def _other_articles(blocks: list[Node], best: Node, measures: dict[Node, _Measures]) -> tuple[set[Node], float]:
    """(the articles beside ``best`` with a block of running text as dense as those in ``best`` are on average, that average by characters)."""
    within: dict[Node, Node] = {}  # the outermost article, or best, that a block stands in
    densest: dict[Node, float] = {}
    weighed = chars = 0.0
    for node in blocks:
        place = within.get(node.parent) or (node if node is best or node.name == "article" else None)
        if place is None:
            continue
        within[node] = place
        if node.name in TEXTUAL and measures[node].chars:
            if place is best:
                weighed += measures[node].density * measures[node].chars
                chars += measures[node].chars
            else:
                densest[place] = max(densest.get(place, 0.0), measures[node].density)
    usual = weighed / max(chars, 1)
    return {n for n, density in densest.items() if chars and density >= usual}, usual


def _drop_lists_of_links(article: Node, measures: dict[Node, _Measures]) -> None:
    """Inside an element that comes in whole, containers of several links and hardly anything else are no text of it."""
    stack: list[Node] = [article]
    while stack:
        node = stack.pop()
        m = measures[node]
        if node is not article and node.name in LINK_LISTS and m.link_tags >= MANY_LINKS and m.chars - m.link_chars <= m.link_chars * 0.1:
            node.dropped = True
            continue
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)


def _links(m: _Measures) -> bool:
    return m.link_chars * 2 > m.chars


def block_texts(roots: list[Node]) -> list[str]:
    """The blocks' texts in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    for root in roots:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                parts.append(item)
            elif item.dropped:
                continue
            elif item.name == "br":
                parts.append(" ")
            elif item.name in BLOCKS:
                flush()
                stack.append(None)
                stack.extend(reversed(item.children))
            else:
                stack.extend(reversed(item.children))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The page's main text; see the module's text."""
    return "\n".join(block_texts(content_roots(parse(page)))) if page else ""


def extract_text(pages: DataFrame, *, html_column: str = "html", text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """All rows and columns but the page itself, with its main text and that text's code points. Nothing is shuffled."""
    kept = [c for c in pages.columns if c not in (html_column, text_column, chars_column)]
    rows = pages.select(*kept, html_column)
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(text_column, T.StringType()), T.StructField(chars_column, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p) for p in column(part, html_column).to_pylist()]
                yield {c: column(part, c) for c in kept} | {text_column: texts, chars_column: [len(t) for t in texts]}

    return map_rows(rows, schema, run)
