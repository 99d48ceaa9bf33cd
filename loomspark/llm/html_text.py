"""Main text of pages by wrapper induction.

A first pass over all pages of a host counts the pages that hold each block of text at its node path
(names of the nodes above it). A block, all text directly in one element, is template if it is on most
pages that have its path. Pages count once that are alike but for such blocks, so copies of a page
don't make its article a template: a first round tells which blocks are constant over different pages,
a second one counts again by the digest of what the first round left of each page.

The second pass drops those blocks, one by one, so varying neighbours stay. Then pages are folded (runs
of like siblings become one repeating node) and aligned with a growing template by simple tree
matching: the order-preserving matching of children that pairs the most nodes. Each template node
gathers what it held on its pages. A node with the same text on most pages is template; a varying slot
is content unless its tag, class or role names furniture (menu, advert, notice, form, comments ...) or
it is mostly links. The main region is the article or main element where there is one, else the slot
that holds most of the varying text.

For the second pass a host's pages are dealt into groups of about PER_GROUP by a hash, as many as the
host has pages for, so a host with a third of all pages is as many tasks; each group gets those
constant blocks of its host that its pages hold.

Defined results: null or empty html, or a page without text, gives the empty text. Elements nested
deeper than DEPTH become siblings at that depth, as in browsers; no text is lost and its order stays. A null or odd
url belongs to a host of its own name. Repeated rows give repeated results. Pages are read whole.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard

PER_GROUP = 64
#: Levels of nesting that are kept apart, and cells of the table of a tree matching.
DEPTH, MOST_CELLS = 200, 1 << 18
#: Hosts of more than one group, up to which their sizes are broadcast; beyond it the pages are joined by a shuffle.
FEW_HOSTS = 100_000
#: Share and number of pages from which one text makes a slot template, outside and inside the article.
CONSTANT, LEAST_PAGES = 0.6, 3
CONSTANT_INSIDE, LEAST_INSIDE = 0.9, 8
LINKED = 0.6
#: Tags and names that mark furniture, and those that mark the article.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_TAGS = frozenset("head script style nav footer aside form noscript template iframe svg button select textarea dialog menu object canvas audio video map".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer comment comments reply replies disqus respond discussion share sharing social related recommended recommendations pagination pager login signup search copyright masthead toolbar toc skip".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
MAIN_NAMES = frozenset("article content post entry story maintext articlebody".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "head")}


class Node:
    """A block element, or `#text` with the blocks of running text directly in its parent."""

    __slots__ = ("tag", "sig", "drop", "main", "kids", "blocks", "linked")

    def __init__(self, tag: str, sig: str, drop: bool = False, main: bool = False) -> None:
        self.tag, self.sig, self.drop, self.main = tag, sig, drop, main
        self.kids: list[Node] = []
        self.blocks: list[str] = []
        self.linked = 0


def element(tag: str, attributes: str) -> Node:
    names: set[str] = set()
    sig, drop = tag, tag in DROP_TAGS
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), "").lower(), name.lower()
            if name in ("class", "id"):
                names.update(x for x in re.split(r"[^a-z]+", value) if x)
                sig += f".{re.sub(r'[0-9]+', '0', value)}"
            elif name == "role":
                drop |= value in DROP_ROLES
                names |= {"article"} & ({"article"} if value in ("main", "article") else set())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                drop = True
    main = tag in ("article", "main") or bool(names & MAIN_NAMES)
    return Node(tag, sig, drop or (bool(names & DROP_NAMES) and tag not in ("article", "main")), main)


def parse(page: str) -> Node:
    """The block tree of a page."""
    root = Node("html", "html")
    stack, links, run, run_links, at = [root], 0, [], 0, 0
    opened: Counter = Counter()
    dropped = 0  # elements beyond DEPTH, counted from the first of them that is furniture

    def place() -> Node:
        """The node that takes what comes next: the innermost one, or beyond DEPTH the one there; text of furniture stays in it."""
        return stack[-1] if len(stack) <= DEPTH else stack[dropped] if dropped else stack[DEPTH - 1]

    def flush() -> None:
        nonlocal run_links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                kids = place().kids
                if not kids or kids[-1].sig != "#text":
                    kids.append(Node("#text", "#text"))
                kids[-1].blocks.append(text)
                kids[-1].linked += min(run_links, len(text))
        run_links = 0

    def close(depth: int) -> None:
        nonlocal dropped
        flush()
        opened.subtract(x.tag for x in stack[depth:])
        del stack[depth:]
        if dropped >= depth:
            dropped = 0

    for token in iter(lambda: TOKEN.search(page, at), None):
        if token.start() > at:
            piece = page[at : token.start()]
            run.append(piece)
            if links:
                run_links += len(piece.strip())
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        ends = token[1] or token[4]
        if tag in INLINE and tag != "wbr":
            if tag == "a":
                links = max(0, links - 1) if ends else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if ends:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
            else:
                flush()
            links = 0
            continue
        flush()
        links = 0
        if tag in RAW_END and tag in DROP_TAGS or tag == "title":
            end = RAW_END[tag].search(page, at)
            if tag != "head":
                at = end.end() if end else len(page)
                continue
            if end:
                at = end.end()
                continue
        if tag in ("html", "body", "head"):
            continue
        if stack[-1].tag == "p" and tag != "p":
            close(len(stack) - 1)
        ends_here = CLOSES.get(tag, (tag,) if tag == "p" else ())
        for depth in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends_here) else ():
            if stack[depth].tag in ends_here:
                close(depth)
                break
            if stack[depth].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "main"):
                break
        node = element(tag, token[3] or token[6] or "")
        if tag == "header" and not any(x.main for x in stack[: DEPTH + 1]):
            node.drop = True
        place().kids.append(node)
        stack.append(node)
        opened[tag] += 1
        if node.drop and len(stack) > DEPTH and not dropped:
            dropped = len(stack) - 1
    if at < len(page):
        run.append(page[at:])
    flush()
    return root


def key_of(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=8).digest()


def number(key: bytes) -> int:
    return int.from_bytes(key, "little", signed=True)


def places(tree: Node, host: str) -> Iterator[tuple[Node, int, int, bool]]:
    """(#text node, key of its text at its path, key of its path, whether inside an article) in order, outside furniture; an odd path key is inside."""
    stack = [(tree, key_of(host.encode("utf-8", "surrogatepass")), False)]
    while stack:
        node, path, inside = stack.pop()
        if node.sig == "#text":
            yield node, number(key_of(path, b"\0", "\n".join(node.blocks).encode("utf-8", "surrogatepass"))), number(path) & ~1 | inside, inside
        else:
            for kid in reversed(node.kids):
                if not kid.drop:
                    below = inside or kid.main
                    stack.append((kid, path if kid.sig == "#text" else key_of(path, bytes([below]), kid.sig.encode("utf-8", "surrogatepass")), below))


def blocks_of(tree: Node, host: str) -> dict[int, int]:
    """Path key of each different block key of a page, in order."""
    return {key: path for _, key, path, _ in places(tree, host)}


def constant_blocks(pages: list[dict[int, int]]) -> set[int]:
    """Blocks that stand on most of the different pages that have their path."""
    different, found = {tuple(p): p for p in pages}, set()
    for _ in range(2):
        rests = [(hash(tuple(k for k in p if k not in found)), p) for p in different.values()]
        seen = {(rest, key, of) for rest, p in rests for key, of in [*p.items(), *((x, None) for x in p.values())]}
        n = Counter((key, of) for _, key, of in seen)
        found = {key for (key, of), c in n.items() if of is not None and c >= (LEAST_INSIDE if of & 1 else LEAST_PAGES) and c >= (CONSTANT_INSIDE if of & 1 else CONSTANT) * n[of, None]}
    return found


def prune(tree: Node, host: str, constant: set[int]) -> Node:
    """tree without constant blocks and, outside articles, texts that are mostly links; each sibling is judged by itself."""
    for node, key, _, inside in places(tree, host):
        if key in constant or not inside and node.linked >= LINKED * sum(map(len, node.blocks)):
            node.blocks = []
    return tree


def fold(node: Node) -> Node:
    """Runs of siblings with one signature become one repeating node; nodes without text go."""
    kids: list[Node] = []
    for kid in node.kids:
        if kids and kids[-1].sig == kid.sig:
            last = kids[-1]
            last.kids += kid.kids
            last.blocks += kid.blocks
            last.linked += kid.linked
        else:
            kids.append(kid)
    node.kids = [k for k in map(fold, kids) if k.blocks or k.kids]
    return node


@dataclass
class Slot:
    """A template node: what it held on the pages that have it."""

    sig: str
    kids: list[Slot] = field(default_factory=list)
    pages: int = 0
    texts: Counter = field(default_factory=Counter)


def in_order(slots: list[Slot], nodes: list[Node]) -> list[tuple[int, int]]:
    """For long child lists: the k-th slot of a signature meets its k-th node, and of those pairs a longest increasing run stays."""
    places, seen = {}, Counter()
    for i, x in enumerate(slots):
        places[x.sig, seen[x.sig]] = i
        seen[x.sig] += 1
    seen.clear()
    tails: list[int] = []
    ends: list[tuple[int, int, tuple | None]] = []
    for j, x in enumerate(nodes):
        i = places.get((x.sig, seen[x.sig]))
        seen[x.sig] += 1
        if i is not None:
            at = bisect_left(tails, i)
            link = (i, j, ends[at - 1] if at else None)
            tails[at : at + 1], ends[at : at + 1] = [i], [link]
    pairs, link = [], ends[-1] if ends else None
    while link:
        pairs.append(link[:2])
        link = link[2]
    return pairs[::-1]


def matching(slots: list[Slot], nodes: list[Node], weights: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: (pairs of nodes matched below, index pairs). Lists of over MOST_CELLS pairs are matched by in_order."""
    key = (id(slots), id(nodes))
    if key in weights:
        return weights[key]
    n, m = len(slots), len(nodes)
    if n * m > MOST_CELLS:
        pairs = in_order(slots, nodes)
        weights[key] = sum(1 + matching(slots[i].kids, nodes[j].kids, weights)[0] for i, j in pairs), pairs
        return weights[key]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = 1 + matching(slots[i - 1].kids, nodes[j - 1].kids, weights)[0] if slots[i - 1].sig == nodes[j - 1].sig else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w if w else 0)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    weights[key] = best[n][m], pairs[::-1]
    return weights[key]


def align(slot: Slot, node: Node, of: dict[int, Slot], weights: dict) -> None:
    """Enter node's children below slot; children without partner become further slots."""
    pairs = dict((j, i) for i, j in matching(slot.kids, node.kids, weights)[1])
    kids, done = [], 0
    old = slot.kids
    for j, kid in enumerate(node.kids):
        if j in pairs:
            kids += old[done : pairs[j] + 1]
            done = pairs[j] + 1
            target = old[pairs[j]]
        else:
            target = Slot(kid.sig)
            kids.append(target)
        of[id(kid)] = target
        align(target, kid, of, weights)
    slot.kids = kids + old[done:]


def varying(node: Node) -> tuple[str, ...]:
    """The blocks outside furniture."""
    return (*node.blocks, *(x for k in node.kids if not k.drop for x in varying(k)))


def count(node: Node, of: dict[int, Slot]) -> int:
    """Enter what the nodes below hold into their slots; a number that tells this node's text from others."""
    below = []
    for kid in node.kids:
        slot, text = of[id(kid)], count(kid, of)
        slot.pages += 1
        slot.texts[text] += 1
        below.append(text)
    return hash((tuple(node.blocks), tuple(below)))


def furniture(node: Node, slot: Slot | None, inside: bool) -> bool:
    """Whether the node is template or furniture rather than content."""
    if node.drop:
        return True
    share, least = (CONSTANT_INSIDE, LEAST_INSIDE) if inside else (CONSTANT, LEAST_PAGES)
    return bool(slot and not node.main and slot.pages >= least and slot.texts.most_common(1)[0][1] >= share * slot.pages)


def pieces(node: Node, of: dict[int, Slot], inside: bool = False) -> list[str]:
    out = list(node.blocks)
    for kid in node.kids:
        if not furniture(kid, of.get(id(kid)), inside):
            out += pieces(kid, of, inside or kid.main)
    return out


def mains(node: Node, of: dict[int, Slot]) -> list[Node]:
    """The topmost article or main elements outside furniture."""
    out = []
    for kid in node.kids:
        if not furniture(kid, of.get(id(kid)), False):
            out += [kid] if kid.main else mains(kid, of)
    return out


def masses(node: Node, of: dict[int, Slot], out: dict[int, int]) -> int:
    """Code points of the content at and below each node."""
    out[id(node)] = sum(map(len, node.blocks)) + sum(masses(k, of, out) for k in node.kids if not furniture(k, of.get(id(k)), False))
    return out[id(node)]


def region(node: Node, of: dict[int, Slot]) -> Node:
    """Down to the child that holds most of the text, as long as there is one with blocks of its own; paragraphs stay with their siblings."""
    mass: dict[int, int] = {}
    masses(node, of, mass)
    while True:
        kids = [(mass[id(k)], i, k) for i, k in enumerate(node.kids) if any(x.sig != "#text" for x in k.kids) and id(k) in mass]
        if not kids or max(kids)[0] < 0.6 * mass[id(node)]:
            return node
        node = max(kids)[2]


def extract(node: Node, of: dict[int, Slot]) -> str:
    tops = mains(node, of)
    if tops:
        inner = [mains(t, of) for t in tops]
        parts = [x for t, below in zip(tops, inner, strict=True) for b in (below or [t]) for x in pieces(b, of, True)]
        whole = sum(map(len, pieces(node, of)))
        if sum(map(len, parts)) >= 0.25 * whole:
            return " ".join(parts)
    return " ".join(pieces(region(node, of), of))


def induce(pages: list[str], host: str = "", constant: set[int] | None = None) -> list[str]:
    """Main texts of pages of one host; constant: its constant blocks, by default as these pages tell them."""
    raw = [parse(p) for p in pages]
    if constant is None:
        constant = constant_blocks([blocks_of(t, host) for t in raw])
    template, trees, seen = Slot("html"), [fold(prune(t, host, constant)) for t in raw], set()
    of: dict[int, Slot] = {}
    for tree in trees:
        align(template, tree, of, {})
        blocks = hash(varying(tree))
        if blocks not in seen:
            seen.add(blocks)
            count(tree, of)
    return [extract(tree, of) for tree in trees]


def host_constants(dealt: DataFrame) -> DataFrame:
    """(host, group, key): those of constant_blocks() of each host, over all its pages, that the group's pages hold; by counts in pre-aggregated shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(parse(h), host) for host, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], names=["host", "group", "keys", "paths"])

    read = dealt.select("host", "group", "html").mapInArrow(run, "host string, group long, keys array<long>, paths array<long>")
    blocks = cut(read.where(F.size("keys") > 0), "blocks")
    pages = blocks.groupBy("host", F.xxhash64("keys").alias("page")).agg(F.any_value("keys").alias("keys"), F.any_value("paths").alias("paths"))
    held = F.transform(F.arrays_zip("keys", "paths"), lambda x: F.struct(x["keys"].alias("key"), x["paths"].alias("of")))
    above = F.transform(F.array_distinct("paths"), lambda x: F.struct(x.alias("key"), F.lit(None).cast("long").alias("of")))
    inside = F.col("of").bitwiseAND(1) == 1
    often = F.col("n") >= F.when(inside, LEAST_INSIDE).otherwise(LEAST_PAGES)
    most = F.col("n") >= F.when(inside, CONSTANT_INSIDE).otherwise(CONSTANT) * F.col("pages")

    def constant(counted: DataFrame, name: str) -> DataFrame:
        paths = counted.where("of IS NULL").select("host", F.col("key").alias("of"), F.col("n").alias("pages"))
        return cut(counted.where(F.col("of").isNotNull() & often).join(paths, ["host", "of"]).where(most).select("host", "key"), name)

    single = pages.select("host", "page", F.inline(F.concat(held, above)))
    first = constant(single.groupBy("host", "key", "of").agg(F.count("*").alias("n")), "frequent")
    varied = pages.select("host", "page", F.explode("keys").alias("key")).join(first.withColumn("on", F.lit(True)), ["host", "key"], "left")
    rest = varied.groupBy("host", "page").agg(F.coalesce(F.bit_xor(F.when(F.col("on").isNull(), F.xxhash64("key"))), F.lit(0)).alias("rest"))
    different = single.join(rest, ["host", "page"]).select("host", "rest", "key", "of").distinct()
    second = constant(different.groupBy("host", "key", "of").agg(F.count("*").alias("n")), "constants")
    found = cut(blocks.select("host", "group", F.explode("keys").alias("key")).join(second, ["host", "key"], "left_semi").distinct(), "told")
    discard(blocks, first, second)
    return found


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    keyed = rows.withColumn("host", host)
    large = cut(keyed.groupBy("host").agg(F.ceil(F.count("*") / PER_GROUP).alias("groups")).where("groups > 1"), "hosts")
    few = large.count() <= FEW_HOSTS
    sized = keyed.join(F.broadcast(large) if few else large, "host", "left")
    dealt = sized.withColumn("group", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1))).cast("long")).drop("groups")
    told = host_constants(dealt)
    if not few:  # else the join's partitions, whole hosts, would serve for the groups too
        dealt = dealt.repartition("host", "group")

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        table = table.sort_by([("page_id", "ascending"), ("url", "ascending")])
        texts = induce(table.column("html").to_pylist(), table.column("host")[0].as_py(), set(known.column("key").to_pylist())) if table.num_rows else []
        return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return dealt.groupBy("host", "group").cogroup(told.groupBy("host", "group")).applyInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
