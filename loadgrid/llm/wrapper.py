"""Main text of web pages by wrapper induction.

The block trees of a host's pages are aligned by label and merged into one template: neighbours of one label are a run, and a run's
partners are those of its number among the runs of its label (of several such runs on a page, the content root's is found by simple tree matching).
A template node whose text differs between pages is a slot, one with the same text on every page is
template. The content root is the deepest container that holds nearly all varying text that
is not navigation; a page is aligned with its host's template to find the root, and everything
below it except constant nodes and page furniture is its main text. Text beside the root is left out only
where it is constant, furniture or a list of links.

How it is spread: partial templates per host are merged inside each partition, then per (host,
partition group), then per host - a template's size follows the host's layouts, not its pages, so a
host with a third of all pages costs no task more than its share. Merging is a union by label and number with sums, the same in any order
and grouping; nothing depends on the size of a template or on the number of pages beyond SURE. Extraction is one more pass.

Defined results: null or empty html gives empty text; null url is a host of its own; broken markup is
closed where HTML implies it and ends with the text; blocks nested more than MAX_DEPTH deep have their text in the block at that
depth, in order and whole; class names and ids are one vote, never against an article or main element or against the blocks that hold nearly all
of a host's varying text; a host with one page has no evidence of
constant text and keeps everything in the content root. Repeated rows give equal rows. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from collections import Counter
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgrid.llm.common import checkpointed, ship_code, small_side

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas xmp noembed noframes textarea title".split())
#: Elements that start a new block of text; all others are part of their block's text.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption "
                   "nav header footer aside form fieldset address details summary dialog center hgroup search".split())
#: Page furniture, by element, by ARIA role, and by class or id. A name counts if all its words are furniture or plain, one furniture at least:
#: ``site-footer`` and ``related-posts`` do, ``has-sidebar``, ``menu-open`` and ``post-header`` don't.
FURNITURE = frozenset("nav footer aside form fieldset dialog head select button menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
WORDS = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
                  "footer header masthead banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share "
                  "sharing social related recommended trending widget comment comments disqus respond reply replies pagination pager toolbar".split())
PLAIN = frozenset("site page main top bottom left right primary secondary global mobile desktop area areas box bar bars list lists wrapper wrap container inner outer section block blocks button "
                  "buttons link links item items posts articles stories form text widgets zone slot unit row col column js".split())
#: Those that an element inside the content root keeps: an article's own header is part of it.
INSIDE = frozenset(["header", "masthead", "banner"])
CONTAINERS = frozenset("html body article main section div td table tbody tr center blockquote".split())
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
          "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Distinct texts and pages that a template remembers of a node and of itself; from how many distinct pages equal text is template.
KEPT, SURE = 8, 5
#: Class names of one element fall into so many labels, so that names made up per page don't let a level of the template grow without end.
LABELS = 4_096
#: Elements that hold main text.
NAMED = ("article", "main")
#: Share of the varying text that the content root must hold; varying text beside it is kept as well.
HOLDS = 0.9
BROADCAST_HOSTS = 20_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")
#: Blocks nested deeper than this have their text in the block at this depth.
MAX_DEPTH = 150


class Node:
    """A block: its label, whether it is furniture for certain (``bad``), by its name, or only outside the content root (``soft``), and its parts in order (text pieces and blocks)."""

    __slots__ = ("label", "tag", "bad", "named", "soft", "parts", "links", "depth")

    def __init__(self, label: str, tag: str, bad: bool = False, named: bool = False, soft: bool = False, depth: int = 0):
        self.label, self.tag, self.bad, self.named, self.soft, self.parts, self.links, self.depth = label, tag, bad, named, soft, [], 0, depth

    def blocks(self) -> list["Node"]:
        return [x for x in self.parts if x.__class__ is Node]

    def own(self) -> str:
        return " ".join(_html.unescape("".join(x if x.__class__ is str else " " for x in self.parts)).split())


def _furniture_names(names: str) -> set[str]:
    """The furniture words of the class names and ids that count."""
    found: set[str] = set()
    for name in names.split():
        words = {w for w in _SPLIT.split(name) if w}
        if words & WORDS and words <= WORDS | PLAIN:
            found |= words & WORDS
    return found


def _label(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """Label, furniture by element, role or state, furniture by name, and furniture only outside the content root. Names don't count against an article or main element."""
    bad, named, soft, cls = tag in FURNITURE, False, tag == "header", ""
    if attrs and not attrs.isspace():
        a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)}
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        cls = ".".join(re.sub(r"[0-9]+", "#", names).split()[:2])
        words = _furniture_names(names) if tag not in NAMED else set()
        soft = soft or bool(words & INSIDE) or a.get("role") == "banner"
        named = bool(words - INSIDE)
        bad = bad or a.get("role") in ROLES - {"banner"} or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
    return f"{tag}.{zlib.crc32(cls.encode()) % LABELS}" if cls else tag, bad, named, soft


def parse(text: str) -> Node:
    """The block tree of a page; elements that are not blocks add their text to the block around them."""
    root = Node("html", "html")
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements and the block that their text belongs to
    low = None
    i = skip = 0
    while True:
        m = _TOKEN.search(text, i)
        block = stack[-1][1]
        if m is None:
            if i < len(text) and not skip:
                block.parts.append(text[i:])
            return root
        if m.start() > i and not skip:
            piece = text[i:m.start()]
            block.parts.append(piece)
            if any(t == "a" for t, _ in stack[-3:]):
                block.links += len(piece)
        i = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not close:
            if tag in RAW:
                if low is None:
                    low = text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]+", lambda x: x[0].lower(), text)
                end = low.find(f"</{tag}", i)
                if end < 0:
                    return root
                i = text.find(">", end) + 1 or len(text)
                continue
            if tag in VOID:
                if tag in ("br", "hr") and not skip:
                    block.parts.append(" ")
                continue
            if tag in ("html", "head", "body"):
                if tag == "head":
                    stack.append(("head", Node("head", "head", True)))
                elif tag == "body":
                    while stack[-1][0] == "head":
                        stack.pop()
                continue
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    open_ = stack[k][0]
                    if open_ in CLOSES and tag in CLOSES[open_]:
                        del stack[k:]
                        break
                    if open_ in BLOCKS and open_ != "p":
                        break
                block = stack[-1][1]
                label, bad, named, soft = _label(tag, attrs)
                if block.depth < MAX_DEPTH or (bad or named) and block.depth == MAX_DEPTH:
                    node = Node(label, tag, bad, named, soft, block.depth + 1)
                    block.parts.append(node)
                    stack.append((tag, node))
                else:
                    block.parts.append(" ")
                    stack.append((tag, block))
            elif not attrs.rstrip().endswith("/"):
                label, bad, named, _ = _label(tag, attrs)
                if (bad or named) and block.depth <= MAX_DEPTH:  # furniture inside a line is a block, so that it can be left out
                    node = Node(label, tag, bad, named, False, block.depth + 1)
                    block.parts.append(node)
                    stack.append((tag, node))
                else:
                    stack.append((tag, block))
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "body", "td", "th") and tag not in BLOCKS:
                    break


# A template node is a list: [label, tag, furniture, pages, characters, link characters, hashes of its distinct texts, children].
L, T, B, N, C, A, H, K = range(8)
#: Bits of B: furniture, furniture by name, and another view of the texts of a run (by its number from the end, by the label before it): no block of its own.
BAD, NAME, VIEW = 1, 4, 8


def runs(blocks: list, label) -> list[list]:
    """Neighbours of one label together."""
    return [list(same) for _, same in groupby(blocks, label)]


def summary(node: Node) -> list:
    """A page's block tree as a template of one page, equal neighbours folded into one node."""
    own = node.own()
    bad, named = node.bad or node.soft and node.tag == "header", node.named or node.soft and node.tag not in ("header", *NAMED)
    out = [node.label, node.tag, BAD * bool(bad) + NAME * bool(named), 1, len(own), node.links, [zlib.crc32(own.encode())] if own else [], []]
    kids = [reduce(_one_page, map(summary, same)) for same in runs(node.blocks(), lambda x: x.label)]
    left, views, before = Counter(k[L] for k in kids), {}, ""
    for k in kids:
        for view in (f"{k[L]} -{left[k[L]]}", f"{k[L]} {before}"):
            v = [view, "", k[B] | VIEW, 1, 0, 0, k[H], []]
            views[view] = _one_page(views[view], v) if view in views else v
        left[k[L]] -= 1
        before = k[L]
    out[K] = [*kids, *views.values()]
    return folded(out)


def _one_page(a: list, b: list) -> list:
    return merge(a, b, pages=False)


def _match(a: list, b: list, memo: dict) -> tuple[int, list]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and the matched pairs of children."""
    if a[L] != b[L]:
        return 0, []
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a[K], b[K]
    if len(x) == len(y) and all(p[L] == q[L] and not p[K] and not q[K] for p, q in zip(x, y)):
        memo[key] = 1 + len(x), [(i, i) for i in range(len(x))]
        return memo[key]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    w = [[_match(p, q, memo)[0] if p[L] == q[L] else 0 for q in y] for p in x]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = 1 + m[-1][-1], pairs[::-1]
    return memo[key]


def _numbered(kids: list) -> dict:
    """Children by label and number among those of their label."""
    seen: Counter = Counter()
    out = {}
    for k in kids:
        out[k[L], seen[k[L]]] = k
        seen[k[L]] += 1
    return out


def merge(a: list, b: list, pages: bool = True) -> list:
    """Two templates as one; children without a partner stay as they are."""
    x, y = _numbered(a[K]), _numbered(b[K])
    kids = [merge(x[k], y[k], pages) if k in x and k in y else x[k] if k in x else y[k] for k in sorted({*x, *y})]
    return [a[L], a[T], a[B] | b[B], a[N] + b[N] if pages else max(a[N], b[N]), a[C] + b[C], a[A] + b[A], sorted({*a[H], *b[H]})[:KEPT], kids]


def _count(t: list, least: int = 1) -> int:
    """Nodes on at least so many pages."""
    return (t[N] >= least) + sum(_count(k, least) for k in t[K])


def folded(t: list) -> list:
    """A template with the children in the order of their labels, those of one label in page order, whatever its size."""
    t[K].sort(key=lambda k: k[L])
    return t


def _merged(a: list | None, b: list) -> list:
    """Templates with the hashes of their pages: [template, distinct pages]."""
    if a is None:
        return b
    return [merge(a[0], b[0]), sorted({*a[1], *b[1]})[:KEPT]]


def rule(template: list, pages: list) -> dict:
    """The path of the content root as the templates on it, each with its children's labels, the constant texts by the labels from the page's root, and
    the blocks (by those labels) that are no furniture though their name says so.

    A name is one vote: where the blocks with such names hold nearly all of the varying text of the host, the heaviest of them is opened, and so on inside it.
    """
    sure = len(pages) >= SURE

    def own_weight(t):
        varying = len(t[H]) > 1 or t[N] < SURE or not sure
        return t[C] if varying and t[A] * 2 <= t[C] else 0

    def all_weight(t):
        return 0 if t[B] & BAD else own_weight(t) + sum(map(all_weight, t[K]))

    opened: set[str] = set()

    def weight(t, at):
        """Characters of slots that are not furniture or link lists, over the subtree."""
        if t[B] & BAD or t[B] & NAME and at not in opened:
            return 0
        return own_weight(t) + sum(weight(k, f"{at}/{k[L]}") for k in t[K])

    def closed(t, at):
        """Blocks closed by their name alone, the outermost ones."""
        for k in t[K]:
            here = f"{at}/{k[L]}"
            if k[B] & NAME and not k[B] & BAD and here not in opened:
                yield all_weight(k), here
            elif not k[B] & BAD:
                yield from closed(k, here)

    everything = all_weight(template)
    while everything and weight(template, "") < (1 - HOLDS) * everything:
        most, at = max(closed(template, ""), default=(0, ""))
        if not most:
            break
        opened.add(at)
    spot = ""
    path, node = [], template
    while True:
        kids = [k for k in node[K] if not k[B] & VIEW]
        weights = [weight(k, f"{spot}/{k[L]}") for k in kids]
        total = weight(node, spot)
        named = [i for i, k in enumerate(kids) if k[T] in NAMED and not k[B] & BAD and weights[i] >= total / 2]
        best = named[0] if named else max(range(len(weights)), key=weights.__getitem__, default=None)
        if best is None or not total or kids[best][T] not in CONTAINERS or not named and weights[best] < HOLDS * total:
            break
        same = [i for i, k in enumerate(kids) if k[L] == kids[best][L]]  # the order of other labels is not kept
        path.append([same.index(best), [[k[L], [x[L] for x in k[K] if not x[B] & VIEW] if len(same) > 1 else []] for k in (kids[i] for i in same)]])
        node = kids[best]
        spot = f"{spot}/{node[L]}"
        if node[T] == "article":
            break
    constant: dict[str, list[int]] = {"": template[H]} if sure and len(template[H]) == 1 else {}

    def fixed(t, at, inside):
        for k in t[K]:
            here = f"{at}/{k[L].split(' ')[0]}"
            within = inside or k[T] in NAMED
            if (k[B] & BAD or k[B] & NAME and here not in opened) and not within:
                continue
            if sure and len(k[H]) == 1 and k[N] >= SURE and k[N] * 10 >= t[N] * 9:
                constant[here] = sorted({*constant.get(here, ()), *k[H]})
            fixed(k, here, within)
    fixed(template, "", False)
    return {"path": path, "constant": constant, "opened": sorted(opened)}


def aligned(node: Node, best: int, kids: list) -> list[Node]:
    """The blocks below ``node`` that align with child ``best`` of a template node with these children."""
    blocks = node.blocks()
    if [label for label, _ in kids].count(kids[best][0]) == 1:
        return [b for b in blocks if b.label == kids[best][0]]
    def stub(label, below):
        return [label, "", 0, 0, 0, 0, [], [[x, "", 0, 0, 0, 0, [], []] for x in below]]

    at = [same for same in runs(blocks, lambda b: b.label) if same[0].label == kids[best][0]]
    have = [stub(same[0].label, sorted(part[0] for b in same[:1] for part in runs([x.label for x in b.blocks()], str))) for same in at]  # folded as in the template
    pairs = dict(_match(["", "", 0, 0, 0, 0, [], [stub(*k) for k in kids]], ["", "", 0, 0, 0, 0, [], have], {})[1])
    return at[pairs[best]] if best in pairs else []


def _named(node: Node) -> bool:
    """Whether an article or main element is below ``node``."""
    return any(not b.bad and (b.tag in NAMED or not b.named and _named(b)) for b in node.blocks())


def main_text(page: Node, path: list, constant: dict, opened: list | tuple = ()) -> str:
    """The page's text without furniture and constant nodes, and beside the content root without lists of links; blocks
    joined by one blank. A page without the path's next block has its articles as roots, else the last block that aligned."""
    out: list[str] = []

    def walk(n: Node, at: str, path: list, beside: bool, inside: bool):
        run = aligned(n, *path[0]) if path else []
        if n.tag in NAMED:
            beside, inside = False, True
        if path:
            beside = bool(run) or _named(n)
        keep = not (beside and n.links and n.links * 2 > len(n.own())) and not (at in constant and zlib.crc32(n.own().encode()) in constant[at])
        for x in n.parts:
            if x.__class__ is str:
                if keep:
                    out.append(x)
                continue
            root, here = any(x is b for b in run), f"{at}/{x.label}"
            if root or not (x.bad or (x.named or x.soft and not inside) and here not in opened):
                out.append("\n")
                walk(x, here, path[1:] if root else [], beside and not root, inside)
                out.append("\n")

    walk(page, "", path, False, False)
    # References are decoded in each run of text; the pieces are runs already.
    return " ".join("".join(_html.unescape(x) for x in out).split())


def extract(text: str | None, r: dict) -> str:
    return main_text(parse(text), r["path"], r["constant"], r.get("opened", ())) if text else ""


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _induct(batches):
    """Partial templates of the hosts of a partition."""
    hosts: dict[str, list] = {}

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(x) for x in hosts.values()], pa.string())], names=["host", "template"])
        hosts.clear()

    for b in batches:
        for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            if text:
                hosts[host] = _merged(hosts.get(host), [summary(parse(text)), [zlib.crc32(text.encode())]])
        if len(hosts) > 2_000:
            yield from flush()
    yield from flush()


def _combine(last: bool):
    def run(key, table):
        got = None
        for x in sorted(table.column("template").to_pylist()):
            got = _merged(got, json.loads(x))
        host = key[0].as_py()
        return pa.table({"host": pa.array([host], pa.string()), "template": pa.array([json.dumps(rule(*got) if last else got)], pa.string())})

    return run


def rules(pages: DataFrame, parts: int = 16) -> DataFrame:
    """(host, template): the extraction rule of every host, as JSON."""
    schema = "host string, template string"
    ship_code(pages.sparkSession)
    partial = pages.select("host", "html").mapInArrow(_induct, schema)
    partial = partial.withColumn("_part", F.pmod(F.xxhash64("template"), F.lit(parts)))
    merged = partial.groupBy("host", "_part").applyInArrow(_combine(False), schema)
    return merged.groupBy("host").applyInArrow(_combine(True), schema)


def _extract(batches):
    kept: dict[str, dict] = {}
    empty = {"path": [], "constant": {}, "opened": []}
    for b in batches:
        texts = []
        for text, template in zip(b.column("html").to_pylist(), b.column("template").to_pylist()):
            if template not in kept:
                if len(kept) > 10_000:
                    kept.clear()
                kept[template] = json.loads(template) if template else empty
            texts.append(extract(text, kept[template]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    of = small_side(checkpointed(rules(rows)), BROADCAST_HOSTS)
    return rows.join(of, "host", "left").select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
