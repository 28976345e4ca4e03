"""N-gram Jaccard join by chosen paths.

A text is the set of its windows of five words; two texts are linked if the Jaccard similarity of
their sets is at least 0.8. Each set is embedded as a sketch of min-hashes. From a root that holds
all sets, every set moves on to the buckets of the sketch entries that a hash of (path, entry)
picks, 1 / threshold of them on average; buckets of up to ``LIMIT`` sets are compared by brute force,
larger ones are split again. The runs are repeated as often as the target recall asks for, and every
pair that the sketches leave open is verified on the exact sets.

Equal sets are one node, so copies are never expanded. No pair is ever a row: a bucket yields for
each member its number of linked documents and one edge to the root of its spanning tree. A pair
counts in the first (smallest) bucket that both members share, so its links add up over buckets.
A bucket that does not get smaller is cut into tiles that are compared two by two.

Result: doc_id, class_id (the least doc_id of the documents connected by links), n_links (the
number of documents linked to it, equal sets included).

Defined results: null and blank text has no words, hence no links: class_id is its own doc_id. A
text of one to four words is one window of all its words. Rows of null doc_id take part and carry
their class's least doc_id, null if it has none. Repeated rows are linked copies. Texts are read
whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgrid.llm.common import checkpointed, ship_code, written

WIDTH, THRESHOLD = 5, 0.8
#: Entries of a sketch; equal entries from which a pair is verified (at 0.8 their mean is 51, their deviation 3.2).
SKETCH, OPEN = 64, 36
#: Sets that a bucket compares without another split, sets of a tile, and levels of splits.
LIMIT, TILE, LEVELS = 128, 1024, 3
#: Probability that a pair at the threshold is found.
RECALL = 0.999
KEPT_WORDS = 1_000_000

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, sketch: int = SKETCH, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with this probability: in a run, its shared
    entries branch like a process with sketch * threshold chances of 1 / (threshold * sketch)."""
    lost = 0.0
    for _ in range(levels):
        lost = (1 - (1 - lost) / (threshold * sketch)) ** (threshold * sketch)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each of x."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def windows(text: str | None, words: dict, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's windows."""
    split = (text or "").lower().encode().split()
    if not split:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(ids) - width + 1)
    h = np.full(n, min(width, len(ids)), np.uint64)
    for k in range(min(width, len(ids))):
        h = mixed(h * _M3 + ids[k:k + n])
    return np.unique(h)


def _factors(sketch: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.integers(1, 1 << 63, sketch, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, sketch, dtype=np.uint64)


def min_hashes(items: np.ndarray, factors) -> np.ndarray:
    """The sketch of a set: for each entry the least of 32 bits over the items."""
    a, b = factors
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(items), 2048):
        out = np.minimum(out, ((items[i:i + 2048, None] * a + b) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def _embed(width: int, sketch: int, sets: bool):
    """doc_id, _text, the set's 128-bit hash, and its sketch (or the set itself)."""

    def run(batches):
        words, factors = _Words(), _factors(sketch)
        for b in batches:
            keys, values = [], []
            for t in b.column("text").to_pylist():
                s = windows(t, words, width)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(None if not len(s) else s.tobytes() if sets else min_hashes(s, factors).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                                             names=["doc_id", "_text", "node", "items" if sets else "sketch"])

    return run


def _children(threshold: float, sketch: int, roots: int = 0):
    """Rows (path, node) of the buckets that each set moves on to, from ``roots`` roots or from the row's path."""
    limit = np.uint64(int(2 ** 64 / (threshold * sketch)))
    entry = mixed(np.arange(1, sketch + 1, dtype=np.uint64) * _M3)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(-1, sketch).astype(np.uint64) + entry
            nodes = b.column("node")
            for r in range(max(1, roots)):
                path = mixed(np.full(b.num_rows, r + 1, np.uint64) * _M3) if roots else b.column("path").to_numpy().view(np.uint64)
                u = mixed(mixed(sk) + path[:, None] * _M1)
                row, col = np.nonzero(u < limit)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(u[row, col] + _M2).view(np.int64)), nodes.take(pa.array(row))], names=["path", "node"])

    return run


def _groups(batches, keys: list[str]):
    """Whole groups from batches sorted by ``keys``: tables cut where the key changes, and the cuts."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts) > 1:
            yield t.slice(0, int(cuts[-1])), cuts
        rest = t.slice(int(cuts[-1]))
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """For the sorted lists of numbers of each member: how many numbers each two share."""
    every, at = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    shared = np.flatnonzero(np.bincount(at, minlength=len(every)) > 1)
    place = np.full(len(every), -1)
    place[shared] = np.arange(len(shared))
    keep = place[at] >= 0
    owner, at = owner[keep], place[at][keep]
    out = np.zeros((len(lists), len(lists)), np.float32)
    for lo in range(0, len(shared), 4096):
        part = (at >= lo) & (at < lo + 4096)
        m = np.zeros((len(lists), min(4096, len(shared) - lo)), np.float32)
        m[owner[part], at[part] - lo] = 1
        out += m @ m.T
    return out


def _open_pairs(path: int, low: int, high: int, tile: np.ndarray, sk: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    """Matrix of the pairs (upper triangle) of a bucket's tile that this bucket is the first to hold and whose sketches leave the link open."""
    n = len(sk)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if low != high:
        pairs &= tile[:, None] != tile[None, :]
    same = np.zeros((n, n), np.uint8)
    for k in range(sk.shape[1]):
        same += sk[:, k, None] == sk[None, :, k]
    pairs &= same >= OPEN
    if pairs.any():
        earlier = [p[p < path] for p in paths]
        pairs &= _common(earlier) == 0
    return pairs


def _bucket(t: pa.Table, i: int, j: int, sketch: int):
    part = t.slice(i, j - i)
    sk = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(-1, sketch)
    paths = [np.array(p, np.int64) for p in part.column("paths").to_pylist()]
    one = part.slice(0, 1).to_pylist()[0]
    return part, _open_pairs(one["path"], one["low"], one["high"], part.column("tile").to_numpy(), sk, paths)


KEYS = ["path", "low", "high"]


def _wanted(sketch: int):
    """The rows of the members that have an open pair in their bucket."""

    def run(batches):
        for t, cuts in _groups(batches, KEYS):
            keep = np.zeros(t.num_rows, bool)
            ends = [*cuts[1:].tolist(), t.num_rows] if cuts[-1] != t.num_rows else cuts[1:].tolist()
            for i, j in zip(cuts.tolist(), ends):
                if j - i > 1:
                    open_ = _bucket(t, i, j, sketch)[1]
                    keep[i:j] = open_.any(0) | open_.any(1)
            yield from t.filter(pa.array(keep)).to_batches()

    return run


def _linked(threshold: float, sketch: int):
    """Of each bucket: for each member with links their number of documents, and the root of its tree."""

    def run(batches):
        for t, cuts in _groups(batches, KEYS):
            node, root, links = [], [], []
            ends = [*cuts[1:].tolist(), t.num_rows] if cuts[-1] != t.num_rows else cuts[1:].tolist()
            for i, j in zip(cuts.tolist(), ends):
                if j - i < 2:
                    continue
                part, pairs = _bucket(t, i, j, sketch)
                sets = [np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]
                inter = _common(sets)
                size = np.array([len(x) for x in sets])
                # At least the threshold, in whole numbers: inter / (a + b - inter) >= 4/5.
                ok = pairs & (inter * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6)
                if not ok.any():
                    continue
                ok |= ok.T
                n = part.column("n").to_numpy()
                names = part.column("node").to_pylist()
                got = (ok @ n.astype(float)).astype(np.int64)
                tree = np.arange(j - i)
                for a, b in zip(*np.nonzero(np.triu(ok))):
                    while tree[a] != a:
                        tree[a] = tree[tree[a]]
                        a = tree[a]
                    while tree[b] != b:
                        tree[b] = tree[tree[b]]
                        b = tree[b]
                    tree[max(a, b)] = min(a, b)
                for a in np.flatnonzero(got):
                    r = a
                    while tree[r] != r:
                        r = tree[r]
                    node.append(names[a])
                    root.append(names[r])
                    links.append(int(got[a]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], names=["node", "root", "links"])

    return run


def leaves(nodes: DataFrame, threshold: float, sketch: int, limit: int, levels: int, runs: int) -> DataFrame:
    """(path, node, c): the members of every bucket of at least two sets that is not split again."""
    rows = nodes.select("node", "sketch").mapInArrow(_children(threshold, sketch, runs), "path bigint, node binary")
    out = None
    for level in range(1, levels + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        rows = written(rows.join(sizes, "path").select("path", "node", "c"), f"paths-{level}")
        done = rows if level == levels else rows.filter(F.col("c") <= limit)
        out = done if out is None else out.unionByName(done)
        big = rows.filter(F.col("c") > limit)
        if level == levels or big.isEmpty():
            return out
        rows = big.select("path", "node").join(nodes.select("node", "sketch"), "node").mapInArrow(_children(threshold, sketch), "path bigint, node binary")
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node connected to each node of ``edges`` (node, root), by passing on
    least labels and following them, a few narrow joins a round; each round is checkpointed."""
    e = checkpointed(edges.filter("node <> root").distinct())
    both = checkpointed(e.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(e.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        seen = both.join(labels, "a").groupBy("b").agg(F.min("l").alias("m"))
        new = labels.join(seen, labels["a"] == seen["b"], "left").select("a", F.least("l", "m").alias("n"), "l")
        jump = new.select(F.col("a").alias("x"), F.col("n").alias("y"))
        new = checkpointed(new.join(jump, new["n"] == jump["x"], "left").select("a", F.least("n", "y").alias("n"), "l"))
        changed = new.filter("n <> l").isEmpty()
        labels = new.select("a", F.col("n").alias("l"))
        if changed:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("root"))


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, sketch: int = SKETCH, limit: int = LIMIT,
         levels: int = LEVELS, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(doc_id, _text, class_id, n_links) of every row of ``docs``; _text is the text's hash."""
    ship_code(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("string").alias("text"))
    members = written(source.mapInArrow(_embed(width, sketch, False), "doc_id bigint, _text bigint, node binary, sketch binary"), "members")
    nodes = written(members.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_text")).alias("source")), "nodes")
    found = written(leaves(nodes, threshold, sketch, limit, levels, runs_for(recall, threshold, sketch, levels)), "leaves")
    of = found.groupBy("node").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    cuts = F.ceil(F.col("c") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts)
    rows = (found.select("path", "node", own.alias("tile"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("_o"))
            .select("path", "node", F.col("tile").cast("int").alias("tile"), F.least("tile", "_o").cast("int").alias("low"), F.greatest("tile", "_o").cast("int").alias("high")))
    rows = rows.join(nodes.select("node", "sketch", "n").join(of, "node"), "node")
    dealt = lambda df: df.repartition(*KEYS).sortWithinPartitions(*KEYS)
    rows = dealt(rows.select(*KEYS, "node", "tile", "sketch", "n", "paths"))
    wanted = written(rows.mapInArrow(_wanted(sketch), rows.schema), "open")
    asked = wanted.select("node").distinct().join(nodes.select("node", F.col("source.doc_id").alias("_i"), F.col("source._text").alias("_t")), "node")
    texts = source.join(asked.select("_i", "_t"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left_semi")
    sets = (texts.mapInArrow(_embed(width, sketch, True), "doc_id bigint, _text bigint, node binary, items binary")
            .select("node", "items").dropDuplicates(["node"]))
    verified = dealt(wanted.join(sets, "node").select(*KEYS, "node", "tile", "sketch", "n", "paths", "items"))
    linked = written(verified.mapInArrow(_linked(threshold, sketch), "node binary, root binary, links bigint"), "linked")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select("node", "root"))
    least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("class_id"))
    classes = (nodes.select("node", "n", "least").join(links, "node", "left").join(roots.join(least, "root").select("node", "class_id"), "node", "left")
               .filter("n > 1 OR links IS NOT NULL")
               .select("node", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return (members.select("doc_id", "_text", "node").join(classes, "node", "left")
            .select("doc_id", "_text", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links."""
    return join(docs).drop("_text")
