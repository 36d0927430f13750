"""Main text of web pages by wrapper induction.

1. A host's pages are dealt to `LAYOUTS` classes by which structural elements they use, and in each class the page with the
   smallest hash that has text is the exemplar. Every page is aligned with the exemplar of its class by simple tree
   matching: nodes of equal tag, in order, parents with parents, so that most nodes are paired. For each exemplar node
   with text of its own it is counted, over all pages, how often the aligned node has the same text. Counts of equal
   nodes of a host's exemplars are added up.
2. Nodes with the same text on nearly all pages are template, inside articles too; the others are slots. A page most of
   whose main text is the exemplar's is a copy and tells nothing about that (else repeated articles would be template),
   and neither does a page with few elements at the exemplar's places, which has another layout.
3. A page's blocks are the slots of its article (or main) element, or of the whole body where it has neither. As
   furniture may also differ from page to page, elements that name it (menus, headers, footers, sidebars, notices,
   adverts, forms, comments, related articles, scripts, styles) are left out by element, role, or class and id. Inside an
   article a class word needs more: it takes nothing that is most of the article, and words that articles use
   for their own parts (related, discussion, notice, menu) take only what is mostly links.

Counts are summed per exemplar node before they are exchanged. A host's pages meet their exemplar and their wrapper in
joins that Spark may split when one host holds a third of all pages.

Defined cases: null or empty html gives an empty text; broken markup is read as browsers do in broad terms (implied
ends of p, li, dt, dd, option, tr, td, th; quotes count only after an equals sign; a tag or quote that never ends takes the
rest of the page; unclosed elements end with their parent); a null url is a host of its own name ""; rows that repeat a
page_id are answered one by one; of pages with one hash (repeated rows) any is the exemplar, as they are equal; a host with
one page has no template; an empty table gives an empty result; other columns are not read, whatever their names. No part of
a page's text is cut for its length, and no depth of nesting changes what is done.
"""

from __future__ import annotations

import html as entities
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, pieces

#: Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg canvas object dialog menu head title search".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table select tr body article section div".split())
#: Words of a class or id that name furniture, if all its other words only say where or what kind of box it is.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar sidebars comment comments reply replies respond disqus related recommended recommendations share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer newsletter subscribe subscription signup login pagination pager toolbar topbar widget widgets skip discussion responses".split()
)
PLACES = frozenset(
    "site page global top bottom main left right center inner outer box bar block list section sections wrapper wrap container area region zone slot unit panel row col column item items link links button buttons icon icons form message msg text content body title heading area primary secondary article articles post posts entry story stories news reader readers user users media more also you and the in to by on of by for policy label info warning success error danger thread count author meta small large fixed sticky floating hidden visible desktop mobile js no".split()
)
#: Those of these words that name parts of articles too: inside one, they say something only of what is mostly links.
WEAK = frozenset("banner banners alert alerts notice notices promotion promotions reply replies respond related recommended recommendations menu menus discussion responses footer skip widget widgets subscription".split())
#: What readers write may be longer than the article.
COMMENTS = frozenset("comment comments disqus".split())
#: With one of these they name lists of other articles.
FEEDS = frozenset("posts articles stories news links items".split())
#: A header is the page's, not the article's, if its other words say so.
HEADERS = frozenset("header head top bar wrapper container inner box section area".split())
SITES = frozenset("site global masthead nav".split())
PAGES = frozenset("page main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that tell layouts apart.
STRUCTURE = ("aside", "main", "article", "section", "ul", "ol", "table", "form")

#: As the HTML standard reads a tag: quotes count only where a value begins.
_VALUE = r"(?>\s*=\s*(?>\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|[^\s/>][^\s/>=]*{_VALUE}?)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?>\s*=\s*(?>\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

#: At least so many aligned pages, and this share of them with the same text, make a node template.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.9
#: A page that shares this much of its main text with the exemplar is a copy of it.
COPY_SHARE = 0.75
#: A page with less than this share of its places among the exemplar's has another layout.
LAYOUT_SHARE = 0.5
#: Classes of layouts that a host's pages are dealt to.
LAYOUTS = 4
#: Cells of an alignment's table that are held at once; a larger one is halved until it fits.
CELLS = 1 << 20


def names_furniture(name: str, inside: bool) -> int:
    """Whether one class or id names furniture: 0 no, 1 by words that name parts of articles too, 2 yes, 3 readers' comments. Inside
    an article a header is furniture only if it is the site's."""
    words = {w.lower() for w in _WORDS.findall(name)}
    if words & NAMES and words <= NAMES | PLACES:
        return 3 if words & COMMENTS else 1 if words & NAMES <= WEAK and not words & FEEDS else 2
    more = SITES if inside else SITES | PAGES
    return 2 * ("header" in words and words <= HEADERS | more and (not inside or bool(words & SITES)))


class Node:
    __slots__ = ("tag", "names", "role", "parts", "up", "hidden", "shape", "size", "at", "text", "chars", "linked")

    def __init__(self, tag: str, up):
        self.tag, self.up, self.names, self.role, self.parts, self.hidden = tag, up, (), "", [], False
        self.shape, self.size, self.at, self.text, self.chars, self.linked = 0, 1, 0, None, 0, 0

    def children(self) -> list[Node]:
        return [x for x in self.parts if x.__class__ is Node]

    def own_text(self) -> str:
        """Its own text nodes, white space made one blank; kept, as nodes do not change once a page is parsed."""
        if self.text is None:
            self.text = " ".join(" ".join([x for x in self.parts if x.__class__ is str]).split())
        return self.text

    def furniture(self, inside: int) -> bool:
        """Whether the element names itself furniture; the header of an article is not. inside: the characters of the article that it
        stands in, or 0. There a class word alone takes nothing that is most of the article (but readers' comments), and a word that articles use too
        takes only what is mostly links."""
        if self.hidden or self.tag in FURNITURE or self.role in ROLES:
            return True
        if self.tag in ("html", "body", "main"):
            return False
        if self.tag == "header" and not inside:
            return True
        named = max((names_furniture(x, inside > 0) for x in self.names), default=0)
        if not inside or not named:
            return named > 0
        return named == 3 or 2 * self.chars <= inside and (named == 2 or 2 * self.linked > self.chars)


def parse(page: str) -> Node:
    root = now = Node("#root", None)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            now.parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            now.parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            x = now
            while x is not None and x.tag != tag:
                x = x.up
            if x is not None and x.up is not None:
                now = x.up
            continue
        if tag in ENDS_P:
            x = now
            while x.up is not None and x.tag not in BLOCKS:
                x = x.up
            if x.tag == "p":
                now = x.up
        if tag in SIBLINGS:
            x = now
            while x.up is not None and x.tag not in SCOPES and x.tag not in SIBLINGS[tag]:
                x = x.up
            if x.tag in SIBLINGS[tag] and x.up is not None:
                now = x.up
                if tag == "tr" and now.tag == "tr":
                    now = now.up
        node = Node(tag, now)
        if m[3].strip():
            names: list[str] = []
            for name, x, y, z in _ATTRIBUTE.findall(m[3]):
                name = name.lower()
                if name in ("class", "id"):
                    names += entities.unescape(x or y or z).split()
                elif name == "role":
                    node.role = (x or y or z).strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and (x or y or z).lower() == "true"):
                    node.hidden = True
            node.names = tuple(names)
        now.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.parts.append(body)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            now = node
        elif tag not in VOID and tag not in ("svg", "path"):
            now = node  # the slash of a non-void element says nothing
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Of all nodes: size of the subtree, shape (equal for subtrees of equal tags), and place (a hash of the tags and names
    that lead there, equal on all pages of one layout)."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if x.up is not None:
            x.at = xxhash.xxh3_64_intdigest(" ".join((x.tag, *x.names)), x.up.at)
        stack += [c for c in x.parts if c.__class__ is Node]
    for x in reversed(order):
        below = [c for c in x.parts if c.__class__ is Node]
        x.size = 1 + sum(c.size for c in below)
        x.chars = (sum(len(c.strip()) for c in x.parts if c.__class__ is str) if x.tag not in RAW else 0) + sum(c.chars for c in below)
        x.linked = x.chars if x.tag == "a" else sum(c.linked for c in below)
        x.shape = hash((x.tag, *(c.shape for c in below)))


class Matching:
    """Simple tree matching: the largest mapping of two trees that keeps tags, order and parents.

    Subtrees of equal shape match whole, so their weight is their size, and equal first or last children can always
    be paired. What is between is aligned by a table over the children, row by row; weights of pairs of shapes are
    remembered. Nothing here recurses with the depth of the trees.
    """

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def _middle(self, a: Node, b: Node) -> tuple[list[Node], list[Node], list[Node], list[Node], int]:
        """Both nodes' children, and those without equal ends; how many equal ones come first."""
        left, right = a.children(), b.children()
        most = min(len(left), len(right))
        head = 0
        while head < most and left[head].shape == right[head].shape:
            head += 1
        tail = 0
        while tail < most - head and left[-1 - tail].shape == right[-1 - tail].shape:
            tail += 1
        return left, right, left[head : len(left) - tail], right[head : len(right) - tail], head

    def weight(self, a: Node, b: Node) -> int:
        """Pairs of the largest mapping of two subtrees with equal tags at the top."""
        if a.shape == b.shape:
            return a.size
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x.shape, y.shape) in self.known:
                todo.pop()
                continue
            left, right, some, others, _ = self._middle(x, y)
            need = {}
            for p in {p.shape: p for p in some}.values():
                for q in {q.shape: q for q in others}.values():
                    if p.tag == q.tag and p.shape != q.shape and (p.shape, q.shape) not in self.known:
                        need[p.shape, q.shape] = (p, q)
            if need:
                todo += need.values()
                continue
            total = 1 + sum(p.size for p in left) - sum(p.size for p in some)
            if some and others:
                total += int(self._row(some, others)[-1])
            self.known[x.shape, y.shape] = total
            todo.pop()
        return self.known[a.shape, b.shape]

    def _table(self, some: list[Node], others: list[Node]):
        """Row of weights of each node in some with all others."""
        kinds = {q.shape: q for q in others}
        codes = {s: k for k, s in enumerate(kinds)}
        where = np.fromiter((codes[q.shape] for q in others), np.int64, len(others))
        rows: dict[int, np.ndarray] = {}
        for p in some:
            if p.shape not in rows:
                rows[p.shape] = np.array([0 if p.tag != q.tag else p.size if p.shape == q.shape else self.known[p.shape, q.shape] for q in kinds.values()], np.int64)[where]
        return rows

    def _row(self, some: list[Node], others: list[Node]) -> np.ndarray:
        """Best weight of some with each beginning of others."""
        rows, best = self._table(some, others), np.zeros(len(others) + 1, np.int64)
        for p in some:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[p.shape]))
        return best

    def _aligned(self, some: list[Node], others: list[Node]):
        """Pairs of a best alignment of children; large tables are halved at a best place."""
        todo = [(some, others)]
        while todo:
            left, right = todo.pop()
            if not left or not right:
                continue
            if len(left) > 1 and len(left) * len(right) > CELLS:
                half = len(left) // 2
                ahead = self._row(left[:half], right) + self._row(left[half:][::-1], right[::-1])[::-1]
                cut = int(ahead.argmax())
                todo += [(left[:half], right[:cut]), (left[half:], right[cut:])]
                continue
            rows = self._table(left, right)
            best = np.zeros((len(left) + 1, len(right) + 1), np.int64)
            for i, p in enumerate(left):
                best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + rows[p.shape]))
            i, j = len(left), len(right)
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    yield left[i - 1], right[j - 1]
                    i, j = i - 1, j - 1

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of a largest mapping of two trees with equal tags at the top."""
        if len(self.known) > self.keep:
            self.known.clear()
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.shape == y.shape:
                todo += zip(x.children(), y.children())
                continue
            self.weight(x, y)
            left, right, some, others, head = self._middle(x, y)
            todo += zip(left[:head], right[:head])
            todo += zip(left[head + len(some) :], right[head + len(others) :])
            todo += self._aligned(some, others)
        return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    return Matching().pairs(a, b)


def mark(node: Node, text: str) -> int:
    """What names a text at a place."""
    return xxhash.xxh3_64_intdigest(text, node.at) - 2**63


def _tops(root: Node) -> tuple[list[Node], int]:
    """The elements that hold the main text, and their characters (one at least), or 0 if the page names none.

    Of articles those count that do not name themselves furniture, if there are such; several in one main element are that element.
    """
    found = _outermost(root, "article")
    found = [x for x in found if not any(names_furniture(n, False) for n in x.names)] or found
    if len(found) > 1:
        around = {id(m): m for x in found for m in [_around(x, "main")]}
        found = [m for m in around.values() if m is not None] if len(around) == 1 and None not in around.values() else found
    found = found or _outermost(root, "main") or [x for x in _all(root) if x.role == "main"][:1]
    return found or [root], max(1, sum(x.chars for x in found)) if found else 0


def _around(x: Node, tag: str) -> Node | None:
    """The innermost element of this tag around x."""
    while x is not None and x.tag != tag:
        x = x.up
    return x


def body_text(page: str, template: frozenset[int] = frozenset()) -> str:
    tops, named = _tops(parse(page))
    blocks: list[str] = []
    for top in tops:
        line: list[str] = []
        _walk(top, named, template, line, blocks)
        _close(line, blocks)
    return "\n\n".join(blocks)


def _main_nodes(root: Node) -> list[Node]:
    """The elements of the main text that are no furniture."""
    tops, named = _tops(root)
    out, stack = [], list(tops)
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in x.children() if not c.furniture(named)]
    return out


def _all(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children()))


def _outermost(node: Node, tag: str) -> list[Node]:
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag == tag and not x.hidden and x.role not in ROLES:
            found.append(x)  # whatever its class says
            continue
        if x.up is not None and x.furniture(0):
            continue
        stack.extend(reversed(x.children()))
    return found


def _close(line: list[str], blocks: list[str]) -> None:
    text = _SPACE.sub(" ", "".join(line)).strip()
    if text:
        blocks.append(text)
    line.clear()


def _walk(top: Node, inside: int, template: frozenset[int], line: list[str], blocks: list[str]) -> None:
    """Collect blocks below top in page order, without recursion (pages may nest deeply)."""
    stack: list = [(top, None)]
    while stack:
        x, end = stack.pop()
        if end:
            _close(line, blocks)
            continue
        if isinstance(x, str):
            line.append(x)
            continue
        if x is not top and x.up is not None and x.furniture(inside):
            continue
        if template and x.up is not None and (own := x.own_text()) and mark(x, own) in template:
            kept = x.children()
        else:
            kept = x.parts
        if x.tag in ("br", "wbr"):
            line.append(" " if x.tag == "br" else "")
            continue
        if x.tag in BLOCKS:
            _close(line, blocks)
            stack.append((None, True))
        stack.extend((p, None) for p in reversed(kept))


class _Exemplars:
    """The last parsed exemplars of this task, with their places."""

    def __init__(self, keep: int = 256):
        self.keep, self.known = keep, OrderedDict()

    def get(self, page: str) -> tuple[Node, set[int]]:
        key = xxhash.xxh3_128_intdigest(page)
        if key not in self.known:
            root = parse(page)
            self.known[key] = root, {x.at for x in _all(root)}
            if len(self.known) > self.keep:
                self.known.popitem(last=False)
        self.known.move_to_end(key)
        return self.known[key]


def told(model: Node, places: set[int], page: Node, matching: Matching) -> list[tuple[Node, str, bool]]:
    """(exemplar node, its text, whether the page has the same there), if the page tells something about the template."""
    own = {x.at for x in _all(page)}
    if len(own & places) < LAYOUT_SHARE * len(own):
        return []
    found = [(a, b, text, text == b.own_text()) for a, b in matching.pairs(model, page) if a.up is not None and (text := a.own_text())]
    main = {id(x): len(x.own_text()) for x in _main_nodes(page)}
    if sum(main.get(id(b), 0) for _, b, _, same in found if same) >= COPY_SHARE * max(1, sum(main.values())):
        return []
    return [(a, text, same) for a, _, text, same in found]


def _align(batches):
    trees, matching = _Exemplars(), Matching()
    seen: dict[tuple[str, int], list[int]] = {}

    def out():
        rows = [(h, m, n, s) for (h, m), (n, s) in seen.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "mark", "n", "same"])

    for batch in pieces(batches, "html"):
        for host, page, model in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "exemplar"))):
            for node, text, same in told(*trees.get(model or ""), parse(page or ""), matching):
                count = seen.setdefault((host, mark(node, text)), [0, 0])
                count[0] += 1
                count[1] += same
        if len(seen) > 200_000:
            yield out()
    if seen:
        yield out()


def _extract(batches):
    for batch in pieces(batches, "html"):
        texts = [body_text(page or "", frozenset(marks or ())) for page, marks in zip(batch.column("html").to_pylist(), batch.column("marks").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def _afresh(name: str) -> Column:
    """The column as a new expression: the few rows per host are then dealt once more, right below the join, and a
    join whose sides both come straight from an exchange is one that Spark can split when one host holds a third of the pages."""
    return F.concat(F.col(name), F.lit("")).alias(name)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, marks): the marks of the template nodes of each host that has some. pages: host, layout, html."""
    told_ = F.col("html").rlike(r">\s*[^<\s]")  # a page without text has no nodes to learn from
    exemplar = pages.groupBy("host", "layout").agg(F.min(F.when(told_, F.struct(F.xxhash64("html"), "html"))).alias("x")).select(_afresh("host"), "layout", F.col("x.html").alias("exemplar"))
    counts = pages.join(exemplar, ["host", "layout"]).transform(by_batches, _align, "host string, mark long, n long, same long")
    total = counts.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    fixed = total.where((F.col("n") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SHARE * F.col("n")))
    every = F.explode(F.sequence(F.lit(0), F.lit(LAYOUTS - 1))).alias("layout")  # so that both joins can use one exchange of the pages
    return fixed.groupBy("host").agg(F.collect_list("mark").alias("marks")).select(_afresh("host"), every, "marks")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    bits = sum((F.when(F.contains(F.col("html"), F.lit(f"<{tag}")), F.lit(1 << k)).otherwise(0) for k, tag in enumerate(STRUCTURE)), F.lit(0))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#:]+)", 1), F.lit(""))).alias("host"),
    ).withColumn("layout", F.coalesce(F.pmod(F.xxhash64(bits), F.lit(LAYOUTS)).cast("int"), F.lit(0)))
    # a layout that cannot be null needs no filter in either join, so both use one exchange
    return rows.join(wrappers(rows), ["host", "layout"], "left").transform(by_batches, _extract, "page_id long, url string, text string, n_chars long")
