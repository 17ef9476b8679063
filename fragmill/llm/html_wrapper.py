"""Main text of pages by wrapper induction on the pages of each host.

1. Every page is parsed to a tolerant DOM, whose block structure is folded to a shape: flow elements of
   one parent with equal labels (paragraphs, list items, cells ...) become one node, and so do other
   siblings that are built alike.
2. The most frequent shape of a host is its template.  Simple tree matching aligns every other
   shape of the host to it (largest common ordered tree of equal labels), once for each shape.  A shape that
   aligns by less than half is a layout of its own.
3. Lines of text are counted by slot, their node of the template: (host, slot, digest of the line) ->
   pages, characters, link characters.  A line that a further page of the host would hold with a
   probability of ``SURE`` or more, (pages with it) / (pages + 2), is constant and belongs to the template;
   all others vary and are content.  Counts are pre-aggregated and keyed by line, so a host that
   holds a third of all pages meets in no task.
4. The rule of a host comes from its slots.  Its container is the most explicit kind of element (article; main; a
   class that names content) whose slots hold at least half of all varying text outside links, else the
   body.  Slots that are mostly links or constant text are furniture: a class that might name a
   notice, a search box or related links counts only where the slot is furniture as well.
5. Each page is aligned again and gives the varying lines of its container's slots, without menus,
   headers, footers, asides, adverts, forms, notices, scripts, styles and comments, which their elements,
   roles and unmistakable classes show.  Rules are joined to the pages, by broadcast only where
   they are smaller than Spark's threshold for that.

A page with nothing but constant lines keeps them; a page of a layout of its own, or without any of the
container's slots, is judged by its own text in the same way.

Defined results: null or empty html gives an empty text; null url is a host of its own; broken
markup is closed where a browser would close it; elements below ``DEEPEST`` levels are siblings, as in
browsers; character references are decoded, unknown ones stay as written; repeated rows are kept;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import pieces, shared_table, trimmed

#: Probability from which a line counts as the template's.
SURE = 0.7
#: Share of the text from which a slot is furniture or a container.
HALF = 0.5
#: Levels of elements.
DEEPEST = 512

# Element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hr caption".split())
DROPPED = frozenset("nav footer aside form script style noscript template textarea iframe button select option input svg canvas object embed dialog head title menu xmp noembed noframes audio video map datalist fieldset".split())
CLOSES_P = FLOW | frozenset("div section article aside nav header footer main form address center details fieldset hr menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "td", "th", "article", "section", "div", "main", "body", "li", "blockquote"}}
# Classes and ids, as whole words, that name what is no article; roles start with "role-".
NAMED = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense ad-banner ad-container ad-slot sponsored cookie-notice
    cookie-banner cookie-consent cookie-bar consent-banner gdpr sidebar side-bar nav navbar navbar-nav navigation menu main-menu site-nav
    breadcrumb breadcrumbs comment comments comment-list comments-area comments-section respond disqus disqus_thread replies newsletter
    newsletter-signup pagination pager footer site-footer page-footer site-header masthead toolbar topbar popup modal share-buttons
    sharing social-share social-links related-posts related-articles related-stories login-form search-form searchbox skip-link
    widget-area role-navigation role-banner role-contentinfo role-complementary role-search role-dialog role-alertdialog role-alert
    role-form role-menu role-menubar role-toolbar""".split()
)
# Words that name such parts on some pages, and content on others.
LIKELY = frozenset("related recommended recommendations share social search side aside alert alerts notice notices notification notifications promo promos promotion promotions sponsor sponsors widget widgets banner banners overlay subscribe subscription signup login cookie cookies consent popups modals".split())
# Words that name the main part, or its header.
MAIN = frozenset("main content article post entry story articlebody article-body article-content article-text post-content post-body entry-content story-body story-content main-content page-content body-content content-main content-body role-main role-article".split())
HEADER = frozenset("header page-header top-header".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*$", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)


class Node:
    __slots__ = ("tag", "names", "hidden", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children = tag, []
        self.names: tuple[str, ...] = ()
        self.hidden = False
        if attrs:
            names = set()
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    self.hidden = True
                elif name == "itemprop":
                    names |= {value} & {"articlebody"}
                elif name == "role":
                    names |= {f"role-{v}" for v in value.split()}
                elif name in ("class", "id"):
                    names |= {*value.split()}
            self.names = tuple(sorted(names))

    def boilerplate(self) -> bool:
        """Does the element show that no article holds it?"""
        return self.hidden or self.tag in DROPPED or (bool(self.names) and self.tag not in ("html", "body") and not NAMED.isdisjoint(self.names))

    def label(self) -> str:
        return ".".join([self.tag, *dict.fromkeys(re.sub(r"[^a-z:_-]+", "", n) for n in self.names)]) if self.names else self.tag


def parse(page: str) -> Node:
    """A DOM of elements and strings; unclosed elements end where their parent does."""
    root = Node("#root")
    stack = [root]
    beyond: dict[str, int] = {}  # open elements below the deepest level
    at = 0
    while True:
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            stack[-1].children.append(entities.unescape(page[at:stop]))
        if not m:
            return root
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, BARRIER["p"])
        if tag in CLOSES:
            _close(stack, CLOSES[tag], BARRIER.get(tag, set()))
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            if not end:
                return root
            at = page.find(">", end.start())
            at = len(page) if at < 0 else at + 1
        elif tag not in VOID and not m[3].endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                beyond[tag] = beyond.get(tag, 0) + 1


def _close(stack: list[Node], tags: set[str], barrier: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


class Shape:
    """A node of the folded tree: label, folded children, the DOM nodes it stands for, and all this as text."""

    __slots__ = ("label", "children", "nodes", "text")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.children = label, nodes, []


def fold(nodes: list[Node], label: str) -> Shape:
    shape = Shape(label, nodes)
    flow: dict[str, list[Node]] = {}
    alike: dict[str, Shape] = {}
    order: list = []
    for kid in _structure(nodes):
        name = kid.label()
        if kid.tag in FLOW:
            if name not in flow:
                order.append(name)
            flow.setdefault(name, []).append(kid)
        else:
            one = fold([kid], name)
            if one.text in alike:
                _merge(alike[one.text], one)
            else:
                alike[one.text] = one
                order.append(one)
    shape.children = [fold(flow[x], x) if isinstance(x, str) else x for x in order]
    shape.text = f"[{','.join([json.dumps(label), *(c.text for c in shape.children)])}]"
    return shape


def _merge(a: Shape, b: Shape) -> None:
    """Add the nodes of a shape that is built alike."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        x.nodes += y.nodes
        stack.extend(zip(x.children, y.children))


def _structure(nodes: list[Node]) -> list[Node]:
    """The block elements right below, those in inline elements included."""
    out, stack = [], [c for n in reversed(nodes) for c in reversed(n.children)]
    while stack:
        c = stack.pop()
        if isinstance(c, Node) and c.tag not in RAW and c.tag != "head":
            if c.tag in INLINE:
                stack.extend(reversed(c.children))
            elif c.tag not in VOID:
                out.append(c)
    return out


def preorder(shape: Shape) -> list[Shape]:
    out, stack = [], [shape]
    while stack:
        s = stack.pop()
        out.append(s)
        stack.extend(reversed(s.children))
    return out


@functools.lru_cache(maxsize=20_000)
def align(template: str, shape: str) -> tuple[int, ...]:
    """Simple tree matching: the template's node for each node of the shape in preorder, or -1."""
    a, b = json.loads(template), json.loads(shape)
    if template == shape:
        return tuple(range(shape.count("[")))
    sizes: dict[int, int] = {}

    def size(t) -> int:
        if id(t) not in sizes:
            sizes[id(t)] = 1 + sum(map(size, t[1:]))
        return sizes[id(t)]

    tables: dict[tuple[int, int], list[list[int]]] = {}

    def match(x, y) -> int:
        if x[0] != y[0]:
            return 0
        rows, cols = len(x), len(y)
        m = [[0] * cols for _ in range(rows)]
        for i in range(1, rows):
            for j in range(1, cols):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x[i], y[j]))
        tables[id(x), id(y)] = m
        return 1 + m[-1][-1]

    out = [-1] * size(b)

    def walk(x, y, p: int, q: int) -> None:
        out[q] = p
        m = tables[id(x), id(y)]
        i, j = len(x) - 1, len(y) - 1
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                walk(x[i], y[j], p + 1 + sum(map(size, x[1:i])), q + 1 + sum(map(size, y[1:j])))
                i, j = i - 1, j - 1

    size(a)
    if match(a, b):
        walk(a, b, 0, 0)
    return tuple(out)


def slots(shape: Shape, template: str) -> list[int]:
    """The template's node for each node of the shape in preorder, or -1; -1 throughout for a layout of its own."""
    at = align(template, shape.text)
    return list(at) if sum(p >= 0 for p in at) >= HALF * len(at) else [-1] * len(at)


def lines(nodes: list[Node], dropped) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) of each line below; elements that ``dropped`` takes are left out."""
    out, now, links, link = [], [], 0, 0
    owners: list[Node] = []

    def end() -> None:
        nonlocal links
        text = " ".join("".join(now).split())
        if text:
            out.append((owners[-1], text, min(links, len(text))))
        now.clear()
        links = 0

    opened, closed, unlinked, found = range(4)
    stack: list = [(opened, n) for n in reversed(nodes)]
    while stack:
        kind, c = stack.pop()
        if kind == closed:
            end()
            owners.pop()
        elif kind == unlinked:
            link -= 1
        elif isinstance(c, str):
            now.append(c)
            links += len(c.strip()) if link else 0
        elif kind == found and c.tag == "br":
            now.append(" ")
        elif kind == found and dropped(c):
            if c.tag not in INLINE:
                end()
        elif kind == found and c.tag in INLINE:
            if c.tag == "a":
                link += 1
                stack.append((unlinked, None))
            stack.extend((found, x) for x in reversed(c.children))
        else:
            if owners:
                end()
            owners.append(c)
            stack.append((closed, None))
            stack.extend((found, x) for x in reversed(c.children))
    return out


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def choose(template: str, varying: dict[int, tuple[int, int]], constant: dict[int, int]) -> tuple[list[int], list[int]]:
    """(slots of the container, slots of furniture) from (characters, link characters) of varying lines and characters of constant ones."""
    tree = json.loads(template)
    flat: list[tuple[str, frozenset[str], int, bool]] = []  # tag, names, end of the subtree, inside an article or main part
    stack = [(tree, False)]
    order: list[tuple[list, bool]] = []
    while stack:
        t, inside = stack.pop()
        tag, _, names = t[0].partition(".")
        inside = inside or tag in ("article", "main") or not MAIN.isdisjoint(names.split("."))
        order.append((t, inside))
        stack.extend((c, inside) for c in reversed(t[1:]))
    size: dict[int, int] = {}
    for t, _ in reversed(order):
        size[id(t)] = 1 + sum(size[id(c)] for c in t[1:])
    for at, (t, inside) in enumerate(order):
        tag, _, names = t[0].partition(".")
        flat.append((tag, frozenset(names.split(".")), at + size[id(t)], inside))

    out: set[int] = set()
    furniture: list[int] = []
    for at, (tag, names, end, inside) in enumerate(flat):
        if at in out:
            continue
        chars, links, same = (sum(x) for x in zip(*((*varying.get(i, (0, 0)), constant.get(i, 0)) for i in range(at, end))))
        mostly = lambda x, total: total > 0 and x >= HALF * total
        named = tag not in ("html", "body", "#root") and not NAMED.isdisjoint(names)
        doubtful = not LIKELY.isdisjoint(names) or (not inside and (tag == "header" or not HEADER.isdisjoint(names)))
        listed = not inside and tag not in ("html", "body", "#root") and mostly(links, chars)
        if named or tag in DROPPED or listed or (doubtful and (mostly(links, chars) or mostly(same, chars + same) or tag == "header")):
            furniture.append(at)
            out |= set(range(at, end))
    content = lambda at: sum(varying.get(i, (0, 0))[0] - varying.get(i, (0, 0))[1] for i in range(at, flat[at][2]) if i not in out)
    whole = content(0)
    kinds = (lambda tag, names: tag == "article", lambda tag, names: tag == "main" or not names.isdisjoint(("articlebody", "role-main")), lambda tag, names: tag not in ("html", "body", "#root") and tag not in INLINE and not MAIN.isdisjoint(names))
    for kind in kinds:
        found, end = [], 0
        for at, (tag, names, stop, _) in enumerate(flat):
            if at >= end and at not in out and kind(tag, names):
                found.append(at)
                end = stop
        if found and sum(map(content, found)) >= HALF * whole:
            return found, furniture
    return [next((at for at, x in enumerate(flat) if x[0] == "body"), 0)], furniture


def slot_text(page_lines, slot_of) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """What ``choose`` takes, from the lines of one page: all of them vary."""
    varying: dict[int, tuple[int, int]] = {}
    for owner, text, links in page_lines:
        n, k = varying.get(slot_of[id(owner)], (0, 0))
        varying[slot_of[id(owner)]] = n + len(text), k + links
    return varying, {}


@functools.lru_cache(maxsize=4096)
def read_rule(text: str) -> dict:
    """template, container, furniture, and constant: slot -> digests (slot -1: of other layouts, anywhere)."""
    rule = json.loads(text)
    constant: dict[int, set[int]] = {}
    for slot, d in rule["constant"]:
        constant.setdefault(slot, set()).add(d)
    return rule | {"container": set(rule["container"]), "furniture": set(rule["furniture"]), "constant": constant}


def extract(page: str, rule: dict | None) -> str:
    """Main text of one page under its host's rule."""
    root = parse(page)
    shape = fold([root], "#root")
    flat = preorder(shape)
    at = slots(shape, rule["template"]) if rule else [-1] * len(flat)
    container = [n for s, p in zip(flat, at) if rule and p in rule["container"] for n in s.nodes]
    known = bool(container)
    if known:
        furniture = {id(n) for s, p in zip(flat, at) if p in rule["furniture"] for n in s.nodes}
    else:
        own = {id(n): k for k, s in enumerate(flat) for n in s.nodes}
        chosen, parts = choose(shape.text, *slot_text(lines([root], Node.boilerplate), own))
        container = [n for k in chosen for n in flat[k].nodes]
        furniture = {id(n) for k in parts for n in flat[k].nodes}
    if len(container) > 1:  # in page order
        place = {id(n): k for k, n in enumerate(preorder_nodes(root))}
        container.sort(key=lambda n: place[id(n)])
    found = lines(container, lambda n: n.boilerplate() or id(n) in furniture)
    constant = rule["constant"] if rule else {}
    if not constant:
        return "\n".join(text for _, text, _ in found)
    slot_of = {id(n): p for s, p in zip(flat, at) for n in s.nodes} if known else {}
    varying = [text for owner, text, _ in found if digest(text) not in constant.get(slot_of.get(id(owner), -1), ())]
    return "\n".join(varying or (text for _, text, _ in found))


def preorder_nodes(root: Node):
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


_STUDIED = "host string, shape_id long, node int, digest long, n long, chars long, links long, shape string"


def _studied(batches):
    """host, html -> pages of each shape (node -1), and of each line by shape and node."""
    for batch in pieces(batches, 2048):
        sums: dict[tuple, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py())
            shape = fold([root], "#root")
            sid = digest(shape.text)
            node = {id(n): k for k, s in enumerate(preorder(shape)) for n in s.nodes}
            sums.setdefault((host, sid, -1, 0), [0, 0, 0, shape.text])[0] += 1
            once = set()
            for owner, text, links in lines([root], Node.boilerplate):
                key = (host, sid, node[id(owner)], digest(text))
                row = sums.setdefault(key, [0, 0, 0, None])
                row[0] += key not in once
                row[1] += len(text)
                row[2] += links
                once.add(key)
        keys, rows = list(sums), list(sums.values())
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        cols = [*([k[c] for k in keys] for c in range(4)), *([r[c] for r in rows] for c in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _STUDIED.split(", ")])


def _aligned(batches):
    """host, shape_id, n, shape, template -> the slot of each node."""
    for batch in pieces(batches):
        host, sid, pages, shape, template = (batch.column(i).to_pylist() for i in range(5))
        out: list[tuple] = []
        for h, i, n, s, t in zip(host, sid, pages, shape, template):
            at = align(t, s)
            own = sum(p >= 0 for p in at) < HALF * len(at)
            out += [(h, i, k, -1 if own else p, n) for k, p in enumerate(at)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["host", "shape_id", "node", "slot", "pages"])


def _ruled(batches):
    """host, template, slots, constant -> the host's rule as text."""
    for batch in pieces(batches):
        out = []
        for template, found, constant in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            found = found or []
            varying = {x["slot"]: (x["chars"], x["links"]) for x in found if x["slot"] >= 0}
            same = {x["slot"]: x["same"] for x in found if x["slot"] >= 0}
            container, furniture = choose(template, varying, same)
            out.append(json.dumps({"template": template, "container": container, "furniture": furniture, "constant": sorted([x["slot"], x["digest"]] for x in constant or [])}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rule_host", "rule"])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def rules(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """rule_host, rule: what was learnt from all pages of each host; pages are parsed once for it."""
    source = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "links")]
    # A shape's text goes with its own row alone, and as a key, as hash aggregation takes no text as a value.
    study = source.mapInArrow(trimmed(_studied), _STUDIED).groupBy("host", "shape_id", "node", "digest", "shape").agg(*sums)
    study = shared_table(study, "wrapper-lines")
    shapes = study.where("node < 0").select("host", "shape_id", "n", "shape")
    template = shapes.groupBy("host").agg(F.max(F.struct("n", "shape"))["shape"].alias("template"))
    aligned = shapes.join(template, "host").select("host", "shape_id", "n", "shape", "template").mapInArrow(_aligned, "host string, shape_id long, node int, slot int, pages long")
    aligned = shared_table(aligned, "wrapper-slots")
    # Lines of a layout of its own are counted by its shape and node; all others by slot.
    by = ["host", "slot", "own", "own_node"]
    own = F.when(F.col("slot") < 0, F.col("shape_id")).alias("own"), F.when(F.col("slot") < 0, F.col("node")).alias("own_node")
    seen = aligned.select("host", "slot", *own, "pages").groupBy(*by).agg(F.sum("pages").alias("pages"))
    told = study.where("node >= 0").join(aligned.drop("pages"), ["host", "shape_id", "node"]).select("host", "slot", *own, "digest", "n", "chars", "links")
    told = told.groupBy(*by, "digest").agg(*sums)
    same = [told[c].eqNullSafe(seen[c]) for c in by]
    told = told.join(seen, same[0] & same[1] & same[2] & same[3]).select(*[told[c] for c in (*by, "digest", "n", "chars", "links")], (F.col("n") >= SURE * (F.col("pages") + 2)).alias("constant"))
    told = shared_table(told, "wrapper-counts")
    of = lambda c, constant: F.sum(F.when(F.col("constant") == constant, F.col(c)).otherwise(0))
    text = told.groupBy("host", "slot").agg(of("chars", False).alias("chars"), of("links", False).alias("links"), of("chars", True).alias("same"))
    text = text.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", "same")).alias("slots"))  # as many as the template has
    constant = told.where("constant").groupBy("host").agg(F.collect_set(F.struct("slot", "digest")).alias("constant"))  # as many as a page has
    known = template.join(text, template["host"].eqNullSafe(text["host"]), "left").select(template["host"], "template", "slots")
    known = known.join(constant, known["host"].eqNullSafe(constant["host"]), "left").select(known["host"], "template", "slots", "constant")
    return shared_table(known.mapInArrow(_ruled, "rule_host string, rule string"), "wrapper-rules")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, text of every page."""
    known = rules(pages, url_col, html_col)

    def run(batches):
        for batch in pieces(batches):
            out = []
            for page, rule in zip(batch.column(3), batch.column(4)):
                out.append(extract(page.as_py(), read_rule(rule.as_py()) if rule.is_valid else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["page_id", "url", "host", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = source.join(known, F.col("host") == F.col("rule_host"), "left").select("page_id", "url", "host", "html", "rule")
    return rows.mapInArrow(trimmed(run), "page_id long, url string, host string, text string")
