"""Main text of web pages by wrapper induction.

Pages become trees of block elements (runs of like siblings are one list node). Each host has one
reference tree; every page's tree is aligned with it by simple tree matching, so equal places of the
host's pages meet in the reference's nodes. What the pages have at a node is counted over all pages
of the host: nodes whose text stays the same are template, nodes whose text varies are slots. The
slot is the main or article element, or else the least container, that holds most of the varying text.
Template nodes and parts with a boilerplate role (menus, forms, adverts, comments, ...) are left out,
everything else in the slot is kept. Outside a main element nothing is kept, outside an article the
other articles, and around any other container all text but that in places made of links, since parts
of the text can stand beside the largest one. Roles by name count for whole class tokens or ids; those
by a part of one (content-widget), of a form, or of an element with a main, article or h1 in it are
taken back where they would leave out most of the host's text. A wrapper fits a page if half the page's tree matches, the content's container has a partner on
it and most of its text isn't in places that the reference lacks. The pages of a host that its wrapper
doesn't fit (another layout) get a wrapper of their own in the same way, up to LAYOUTS wrappers a host;
pages that none of them fits are their own reference.

Four passes over the pages, none of which shuffles them: a reference page for each host (least id
with text), counts for each node, a search for pages of other layouts (these are written and go through
the same passes again), extraction. References and wrappers are written and small; Spark
broadcasts them if their files are below its threshold and joins by host otherwise.

Defined cases: null html has empty text; a null or odd url belongs to the host ''; hosts with fewer
than MIN_PAGES pages have no template nodes; repeated rows are extracted alike; broken markup closes
as browsers do it (an open p ends at the next block, missing end tags at the end of the page).
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import table, written

#: Pages of a host from which a text that never changes is called template, and the share of pages that must have it.
MIN_PAGES, MIN_SHARE = 5, 0.8
#: The slot is found by entering containers: one is entered if it has this share of the varying text around it.
DOMINANT = 0.6
#: A page whose match is below this share of its own tree is its own reference.
MIN_FIT = 0.5
#: Wrappers of a host, each for the pages that those before don't fit.
LAYOUTS = 4
MAX_DEPTH = 100

# Element names of HTML.
BLOCKS = frozenset("html body main article section div header footer nav aside form fieldset menu dialog details summary figure figcaption h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address hr center".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td center form ul ol".split())
DROPPED = frozenset("script style noscript template title textarea svg math iframe object select button canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDED_BY_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
WHOLE = frozenset("main article".split())  # entered no further
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLE = re.compile(r"ads?|advert\w*|banners?|cookies?|notices?|consent|gdpr|sidebar|menu|nav\w*|breadcrumbs?|comments?|replies|respond|disqus|related|share|sharing|social|promo\w*|sponsor\w*|popup|modal|newsletter|subscribe|footer|masthead|toolbar|widget|pagination", re.I)
UNNAMED = frozenset("html body main article".split())  # have no role by name
STATES = frozenset("has no not is with without hide enabled disabled".split())  # has-sidebar is no sidebar
#: Roles that the share of text can take back, and certain ones.
LIKELY, CERTAIN = 1, 2

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
#: Characters of a tag that are looked at by one regular expression; longer ones go by the page's list of quotes.
_NEAR = 1024
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Scanner:
    """Tags of a page from front to back. Broken quotes cost no more than sound ones: where a tag ends is worked out once for each quote of the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special: list[int] | None = None  # places of >, " and '
        self.same: list[int] = []  # for each, the number of the next one of its kind, -1 without one
        self.end: dict[int, int] = {}

    def _listed(self) -> list[int]:
        if self.special is None:
            self.special = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.same, following = [-1] * len(self.special), {}
            for k in range(len(self.special) - 1, -1, -1):
                c = self.page[self.special[k]]
                self.same[k] = following.get(c, -1)
                following[c] = k
        return self.special

    def _closed(self, at: int) -> int:
        """The end of a tag whose attributes begin at a place: after the first > outside quotes, -1 if a quote stays open."""
        near = _REST.match(self.page, at, min(at + _NEAR, len(self.page)))
        if near:
            return near.end()
        special = self._listed()
        k, path, found = bisect_left(special, at), [], -1
        while k < len(special):
            if k in self.end:
                found = self.end[k]
                break
            path.append(k)
            if self.page[special[k]] == ">":
                found = special[k] + 1
                break
            if self.same[k] < 0:
                break
            k = self.same[k] + 1
        self.end.update(dict.fromkeys(path, found))
        return found

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next tag; the name is empty for comments and declarations."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if at > self.last:
                at = page.find("<!--", at)  # no other tag can end
                if at < 0:
                    return None
                continue
            if page[at] in "!?":
                return start, page.find(">", at) + 1, "", "", ""
            name = _NAME.match(page, at)
            if name:
                end = self._closed(name.end())
                if end < 0:
                    end = page.find(">", name.end()) + 1
                if end > 0:
                    return start, end, name[1], name[2], page[name.end() : end - 1]
        return None


class Node:
    """A place in a page's tree; like siblings in a row share one. role: 0, LIKELY or CERTAIN."""

    __slots__ = ("label", "children", "role", "id")

    def __init__(self, label: str, role: int):
        self.label, self.children, self.role, self.id = label, [], role, -1


def _named(words: str) -> int:
    role = 0
    for token in words.split():
        parts = re.split("[-_]", token.lower())
        if ROLE.fullmatch(token):
            return CERTAIN
        if parts[0] not in STATES and parts[-1] not in STATES and any(ROLE.fullmatch(x) for x in parts):
            role = LIKELY
    return role


def _label(tag: str, attributes: str) -> tuple[str, int]:
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    name = re.sub(r"\d+", "", ((found.get("class") or found.get("id") or "").split() or [""])[0])
    role = 0
    if tag not in UNNAMED:
        role = _named(found.get("class", "") + " " + found.get("id", "")) if found else 0
        if found.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "form") or tag in BOILERPLATE:
            role = max(role, LIKELY if tag in ("form", "fieldset") or found.get("role") == "form" else CERTAIN)
    name += "!" * (name != "" and role > 0)  # apart from like siblings without a role
    return f"{tag}.{name}" if name else tag, role


def parse(page: str | None) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page, and its text blocks in order: place, text, characters inside links."""
    root = Node("page", 0)
    stack: list[list] = [[root, "page", -1]]  # place, tag, position among the place's children
    blocks: list[tuple[Node, str, int]] = []
    text, links, link_chars = [], 0, 0
    is_open: Counter[str] = Counter()
    page = page or ""
    lower = None

    def flush():
        nonlocal text, link_chars
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                blocks.append((stack[-1][0], joined, link_chars))
            text, link_chars = [], 0

    def add(piece: str):
        nonlocal link_chars
        if piece:
            text.append(piece)
            if links:
                link_chars += len(piece)

    def opened(tag: str, attributes: str):
        top = stack[-1]
        if len(stack) > MAX_DEPTH:
            stack.append([top[0], tag, top[2]])
            is_open[tag] += 1
            return
        label, role = _label(tag, attributes)
        children = top[0].children
        for k in range(max(top[2], 0), len(children)):
            if children[k].label == label:
                break
        else:
            k = max(top[2] + 1, 0)
            children.insert(k, Node(label, role or CERTAIN * (tag == "header" and not (is_open["article"] or is_open["main"]))))
        top[2] = k
        stack.append([children[k], tag, -1])
        is_open[tag] += 1

    def closed(k: int):
        for _, tag, _ in stack[k:]:
            is_open[tag] -= 1
        del stack[k:]

    at, scanner, unclosed = 0, Scanner(page), set()
    while (found := scanner.after(at)) is not None:
        start, end, slash, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if tag in DROPPED and not slash:
            if attributes.endswith("/"):
                continue
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == len(page) else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = -1 if tag in unclosed else lower.find(f"</{tag}", at)
            if end < 0:
                unclosed.add(tag)
            end = end if end >= 0 else (len(page) if tag != "head" else at)
            at = page.find(">", end) + 1 or len(page) if end > at or tag != "head" else at
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 0 if slash else 1
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if slash:
                if is_open[tag]:
                    closed(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag))
                continue
            if tag in CLOSES_P and stack[-1][1] == "p":
                closed(len(stack) - 1)
            elif tag in ENDED_BY_LIKE and is_open[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == tag:
                        closed(k)
                        break
                    if stack[k][1] in ENDED_BY_LIKE[tag]:
                        break
            opened(tag, attributes)
    add(page[at:])
    flush()
    return root, blocks


def numbered(root: Node) -> list[Node]:
    """All nodes in document order, with their ids set."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.id = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def skeleton(root: Node) -> str:
    """The tree as text: labels with their depth, in document order."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {int(node.role)} {node.label}")
        todo.extend((c, depth + 1) for c in reversed(node.children))
    return "\n".join(out)


def from_skeleton(text: str) -> Node:
    path: list[Node] = []
    for line in text.split("\n"):
        depth, role, label = line.split(" ", 2)
        node = Node(label, int(role))
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-keeping match of trees with equal roots, and its pairs."""
    if a.label != b.label:
        return 0, []
    rows, columns = a.children, b.children
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    below: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(rows):
        for j, y in enumerate(columns):
            w = 0
            if x.label == y.label:
                w, below[i, j] = (found := match(x, y))[0], found
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs, i, j = [(a, b)], len(rows), len(columns)
    while i and j:
        if (i - 1, j - 1) in below and best[i][j] == best[i - 1][j - 1] + below[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            pairs += below[i, j][1]
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(rows)][len(columns)] + 1, pairs


def aligned(root: Node, reference: Node) -> dict[int, int] | None:
    """Reference id for each node id of a page (nodes without a partner have their parent's, marked by ~); None if they don't fit. Both trees must be numbered."""
    size, pairs = match(root, reference)
    if size < MIN_FIT * sum(1 for _ in _walk(root)):
        return None
    partner = {a.id: b.id for a, b in pairs}
    out: dict[int, int] = {}
    for node, parent in _walk(root):
        of = out[parent.id] if parent else -1
        out[node.id] = partner.get(node.id, of if of < 0 else ~of)
    return out


def _walk(root: Node):
    todo = [(root, None)]
    while todo:
        node, parent = todo.pop()
        yield node, parent
        todo.extend((c, node) for c in reversed(node.children))


def settle(nodes: list[Node], chars: list[int]) -> None:
    """Takes back LIKELY roles, and those by name around a heading, main or article, of nodes with most of the text. nodes: as of numbered(), chars: text at each."""
    below, heads = list(chars), [n.label.split(".")[0] in ("main", "article", "h1") for n in nodes]
    for node in reversed(nodes):
        for c in node.children:
            heads[node.id] |= heads[c.id]
            below[node.id] += below[c.id] if c.role != CERTAIN or _doubtful(c, heads) else 0
    for node in nodes:
        if node.role and 2 * below[node.id] > below[0] and (node.role == LIKELY or _doubtful(node, heads)):
            node.role = 0


def _doubtful(node: Node, heads: list[bool]) -> bool:
    tag = node.label.split(".")[0]
    return heads[node.id] and tag not in BOILERPLATE and tag != "header"


def wrapper(reference: Node, seen: dict[int, tuple[int, int, int, int]], pages: int) -> tuple[int, frozenset[int]]:
    """The content's node and the template nodes of a host; settles the roles in its reference.

    seen: for each node id: pages with text there, distinct texts, characters, characters in links.
    """
    nodes = numbered(reference)
    template = {k for k, (n, distinct, _, _) in seen.items() if pages >= MIN_PAGES and distinct == 1 and n >= MIN_SHARE * pages}
    varying = [0] * len(nodes)
    for k, (_, _, chars, links) in seen.items():
        if k not in template and 2 * links <= chars:
            varying[k] = chars
    if not any(varying):
        template = set()
        for k, (_, _, chars, _) in seen.items():
            varying[k] = chars
    settle(nodes, varying)
    total = [0] * len(nodes)
    for node in reversed(nodes):
        total[node.id] = 0 if node.role else varying[node.id] + sum(total[c.id] for c in node.children)
    at = reference
    while True:
        best = max((c for c in at.children if c.label.split(".")[0] in CONTAINERS), key=lambda c: total[c.id], default=None)
        if best is None or not total[best.id] or total[best.id] < DOMINANT * total[at.id]:
            return at.id, frozenset(template)
        at = best
        if at.label.split(".")[0] in WHOLE:
            return at.id, frozenset(template)


def places(root: Node, ids: dict[int, int], slot: int, reference: Node) -> dict[int, int]:
    """For each node id: 2 inside the slot, 1 in other places of the content, 0 outside it, -1 in a part with a boilerplate role (as the reference has it where it has a partner). ids: see aligned()."""
    roles = {n.id: n.role for n, _ in _walk(reference)}
    whole = next((n.label.split(".")[0] for n, _ in _walk(root) if ids[n.id] == slot), "")
    out: dict[int, int] = {}
    for node, parent in _walk(root):
        if ids[node.id] == slot:
            out[node.id] = 2
        elif roles.get(ids[node.id], node.role) or parent and out[parent.id] < 0:
            out[node.id] = -1
        elif whole == "article" and node.label.split(".")[0] == whole:
            out[node.id] = max(out[parent.id], 1)
        else:
            out[node.id] = out[parent.id] if parent else int(whole not in WHOLE)
    return out


def _linked(blocks) -> set[int]:
    """Ids of the page's nodes whose text is mostly links."""
    chars: dict[int, int] = {}
    for node, text, links in blocks:
        chars[node.id] = chars.get(node.id, 0) + len(text) - 2 * links
    return {k for k, n in chars.items() if n < 0}


def content(blocks, ids: dict[int, int], at: dict[int, int], template: frozenset[int]) -> str:
    """The blocks of the content that are neither template nor boilerplate, joined by one blank. at: see places()."""
    linked = _linked(blocks)
    return " ".join(text for node, text, _ in blocks if (at[node.id] == 2 or at[node.id] == 1 and node.id not in linked) and ids[node.id] not in template)


def fitted(root: Node, blocks, reference: Node, slot: int, template: frozenset[int]) -> str | None:
    """The text of a page by a wrapper, None if it doesn't fit. Both trees must be numbered."""
    ids = aligned(root, reference)
    if ids is None or slot not in ids.values():
        return None
    at = places(root, ids, slot, reference)
    text = content(blocks, ids, at, template)
    linked = _linked(blocks)
    strange = sum(len(t) for node, t, _ in blocks if at[node.id] in (0, 1) and ids[node.id] < 0 and node.id not in linked)
    held = sum(len(t) for node, t, _ in blocks if at[node.id] > 0 and (at[node.id] == 2 or ids[node.id] >= 0))
    return text if strange <= held else None


@functools.lru_cache(1000)
def _reference(text: str) -> Node:
    root = from_skeleton(text)
    numbered(root)
    return root


def _own(root: Node, blocks) -> str:
    nodes = numbered(root)
    seen: dict[int, list[int]] = {}
    for node, text, links in blocks:
        x = seen.setdefault(node.id, [1, 1, 0, 0])
        x[2], x[3] = x[2] + len(text), x[3] + links
    slot, _ = wrapper(root, {k: tuple(x) for k, x in seen.items()}, 1)
    ids = {n.id: n.id for n in nodes}
    return content(blocks, ids, places(root, ids, slot, root), frozenset())


def extract(page: str | None, layouts: list[dict] | None) -> str:
    """layouts: reference, slot and template of each wrapper of the host; the first that fits counts."""
    root, blocks = parse(page)
    numbered(root)
    for x in layouts or ():
        text = fitted(root, blocks, _reference(x["reference"]), x["slot"], frozenset(x["template"] or ()))
        if text is not None:
            return text
    return _own(root, blocks)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.withColumn("__host", host)


def references(pages: DataFrame) -> DataFrame:
    """host, reference (skeleton): the page with the least id among those with text; pages has __host."""
    filled = pages.where(F.length("html") > 0)
    first = filled.groupBy("__host").agg(F.min_by("html", F.struct(F.coalesce("page_id", F.lit(2**63 - 1)), F.xxhash64("html"))).alias("html"))

    def run(batches):
        for b in batches:
            trees = [skeleton(parse(h)[0]) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__host"), pa.array(trees, pa.string())], names=["host", "reference"])

    return written(first.mapInArrow(run, "host string, reference string"), "references")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, reference, slot, template of each host; pages has __host."""
    trees = references(pages)
    joined = pages.select("__host", "html").join(trees, pages["__host"] == trees["host"]).select("host", "html", "reference")

    def count(batches):
        known: dict[str, Node] = {}
        for b in batches:
            rows: dict[tuple, list[int]] = {}
            for host, page, text in zip(*(b.column(c).to_pylist() for c in ("host", "html", "reference"))):
                if (tree := known.get(host)) is None:
                    if len(known) > 10_000:
                        known.clear()
                    tree = known[host] = from_skeleton(text)
                    numbered(tree)
                root, blocks = parse(page)
                numbered(root)
                ids = aligned(root, tree)
                own: dict[int, list] = {}
                for node, block, links in blocks if ids else ():
                    if ids[node.id] >= 0:
                        x = own.setdefault(ids[node.id], [0, 0, 0])
                        x[0], x[1], x[2] = zlib.crc32(block.encode("utf-8", "surrogatepass"), x[0]), x[1] + len(block), x[2] + links
                for k, (h, chars, links) in [*own.items(), (-1, (0, 0, 0))]:
                    y = rows.setdefault((host, k, h), [0, 0, 0])
                    y[0], y[1], y[2] = y[0] + 1, y[1] + chars, y[2] + links
            cols = [[k[i] for k in rows] for i in range(3)] + [[v[i] for v in rows.values()] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5))], names=["host", "node", "hash", "n", "chars", "links"])

    counted = joined.mapInArrow(count, "host string, node long, hash long, n long, chars long, links long")
    by_text = counted.groupBy("host", "node", "hash").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])
    by_node = by_text.groupBy("host", "node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    by_host = by_node.groupBy("host").agg(F.collect_list(F.struct("node", "n", "texts", "chars", "links")).alias("nodes"))  # as many as the reference has nodes

    def induce(batches):
        for b in batches:
            trees, slots, templates = [], [], []
            for text, nodes in zip(b.column("reference").to_pylist(), b.column("nodes").to_pylist()):
                pages = next(x["n"] for x in nodes if x["node"] == -1)
                tree = from_skeleton(text)
                slot, template = wrapper(tree, {x["node"]: (x["n"], x["texts"], x["chars"], x["links"]) for x in nodes if x["node"] >= 0}, pages)
                trees.append(skeleton(tree))
                slots.append(slot)
                templates.append(sorted(template))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(trees, pa.string()), pa.array(slots, pa.int32()), pa.array(templates, pa.list_(pa.int32()))], names=["host", "reference", "slot", "template"])

    return written(by_host.join(trees, "host").mapInArrow(induce, "host string, reference string, slot int, template array<int>"), "wrappers")


def unfitted(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of pages (with __host) that the wrapper of their host doesn't fit."""
    names = pages.columns
    joined = pages.where(F.length("html") > 0).join(found, pages["__host"] == found["host"]).select(*names, "reference", "slot", "template")

    def run(batches):
        for b in batches:
            keep = []
            for page, *x in zip(*(b.column(c).to_pylist() for c in ("html", "reference", "slot", "template"))):
                root, blocks = parse(page)
                numbered(root)
                keep.append(fitted(root, blocks, _reference(x[0]), x[1], frozenset(x[2])) is None)
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return written(joined.mapInArrow(run, pages.schema), "unfitted")


def layouts(pages: DataFrame) -> DataFrame:
    """host, layouts (reference, slot, template of each wrapper, in the order of their making); pages has __host."""
    rest, parts = pages, []
    while True:
        found = wrappers(rest)
        parts.append(found.select("host", F.struct(F.lit(len(parts)).alias("k"), "reference", "slot", "template").alias("x")))
        if len(parts) == LAYOUTS:
            break
        rest = unfitted(rest, found)
        if rest.isEmpty():
            break
    every = functools.reduce(DataFrame.union, parts)
    return written(every.groupBy("host").agg(F.sort_array(F.collect_list("x")).alias("layouts")), "layouts")  # LAYOUTS at most


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    pages = with_host(pages.select(F.col("page_id").cast("long"), "url", "html"))
    found = layouts(pages)
    joined = pages.join(found, pages["__host"] == found["host"], "left").select("page_id", "url", "html", "layouts")

    def run(batches):
        for b in batches:
            texts = [extract(*row) for row in zip(*(b.column(c).to_pylist() for c in ("html", "layouts")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
