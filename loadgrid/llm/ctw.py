"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased (A-Z) words joined by one blank and closed by an end byte. Each byte is
eight binary decisions; each decision has a context tree over the ``DEPTH`` bytes before it. A
node's estimate is Krichevsky-Trofimov's, and its weighted probability is the even mixture of that
estimate and of its children's weighted probabilities, from the deepest contexts up. A decision
is predicted by the mixture over all depths of its path with the posterior weights; a context that
training never saw has no estimate of its own and passes its parent's on.

How it is spread: documents are dealt out to blocks of bounded size. A block asks only for what it
needs - its distinct byte n-grams and words, a row each - so no model is broadcast and no table
is collected; counts, trees and lookups are grouped and joined by n-gram, its recent bytes, or word.

Defined results: null text counts as empty and holds the end alone; with no training document the
base score is that of the formula (N = V = 0) and every decision has probability one half. Rows of null
doc_id are not held out and are learned from. Repeated rows are scored each. Texts are scored whole.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgrid.llm.common import release_memory, ship_code, written
from loadgrid.llm.langid import held_out

#: Bytes of context (at most 5: an n-gram and a document's number share 64 bits).
DEPTH = 5
#: Bytes of text of a block, on average.
BLOCK_BYTES = 24 << 20
#: Bytes of text handled at a time inside a block, and n-grams or words of its pieces from which on they are summed into one list.
PIECE_BYTES, MERGE_GRAMS = 1 << 19, 1 << 19
#: Rows of a batch that a task hands back.
BATCH_ROWS = 1 << 16
END = b"\n"
#: The trees of contexts that share the most recent two bytes are built together; the two levels
#: above (at most 257 contexts of 255 decisions) go to every task.
TOP = 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _codes(docs: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte of the documents (context, most recent byte first, then the byte) and its document's index."""
    pad = END * depth
    raw = [pad + b" ".join(w) + END for w in docs]
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    code = buf.copy()
    for k in range(1, depth + 1):
        code[k:] |= buf[:-k] << np.uint64(8 * (depth + 1 - k))
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(buf), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    return code[keep], np.repeat(np.arange(len(raw), dtype=np.uint64), sizes - depth)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n over each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _pieces(table: pa.Table, limit: int = PIECE_BYTES, most: int = 60_000):
    """A block's documents a piece at a time: (words of each, held out of each)."""
    sizes = pc.fill_null(pc.binary_length(table.column("text")), 0).to_pylist()
    start = size = 0
    for i, k in enumerate([*sizes, None]):
        if k is None or i - start >= most or size and size + k > limit:
            part = table.slice(start, i - start)
            if part.num_rows:
                yield [words_of(t) for t in part.column("text").to_pylist()], part.column("_held").to_pylist()
            start, size = i, 0
        size += (k or 0) + 1


FACTS = "block bigint, code bigint, word binary, n bigint"


def _batched(table: pa.Table) -> pa.Table:
    """The table in batches of bounded size: each of them is held once more on the way to Spark."""
    return pa.Table.from_batches([b for i in range(0, table.num_rows, BATCH_ROWS) for b in table.slice(i, BATCH_ROWS).to_batches()], table.schema)


def _summed_words(parts: list[pa.Table]) -> pa.Table:
    """Distinct words, and the sum of n over each."""
    got = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": got.column("word"), "n": got.column("n_sum")})


def _fold(parts: list, summed, size, least: int) -> list:
    """The parts as one if those behind the first outweigh ``least`` and half of the first."""
    if sum(map(size, parts[1:])) <= max(least, size(parts[0]) // 2):
        return parts
    parts = [summed(parts)]
    release_memory()
    return parts


def _word_counts(docs: list[list[bytes]], out: list[bool]) -> pa.Table:
    """Distinct words, and their numbers in the documents that are not ``out``."""
    counted, seen = Counter(), set()
    for w, h in zip(docs, out):
        (seen if h else counted).update(w)
    seen -= counted.keys()
    return pa.table({"word": pa.array([*counted, *seen], pa.binary()), "n": pa.array([*counted.values(), *repeat(0, len(seen))], pa.int64())})


def gather(depth: int):
    """Of a block: its distinct n-grams and words, with their numbers in the training documents."""

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def run(table):
        block = table.column("_block")[0].as_py()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[pa.Table] = []
        for docs, out in _pieces(table):
            code, doc = _codes(docs, depth)
            train = ~np.array(out, bool)[doc]
            key = np.sort((code << np.uint64(1)) | train.astype(np.uint64))
            del code, doc, train
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            key = key[first]
            grams = _fold([*grams, _summed(key >> np.uint64(1), np.where(key & np.uint64(1), n, 0))], summed, lambda p: len(p[0]), MERGE_GRAMS)
            words = _fold([*words, _word_counts(docs, out)], _summed_words, len, MERGE_GRAMS // 4)
            del key, first, n
        codes, n = summed(grams)
        grams.clear()
        count = _summed_words(words).sort_by("word").combine_chunks()
        words.clear()
        release_memory()
        k, m = len(codes), count.num_rows
        return _batched(pa.concat_tables([
            pa.table({"block": pa.array(np.full(k, block, np.int64)), "code": pa.array(codes.astype(np.int64)), "word": pa.nulls(k, pa.binary()), "n": pa.array(n.astype(np.int64))}),
            pa.table({"block": pa.array(np.full(m, block, np.int64)), "code": pa.nulls(m, pa.int64()), "word": count.column("word"), "n": count.column("n")})]))

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of x > 0: eight steps up, then Stirling's series."""
    low = np.ones_like(x)
    for i in range(8):
        low *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(low)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


def decisions(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> list[dict]:
    """For (context, byte) in order with counts: the nodes of each of the eight decisions in order of
    (context, prefix), with counts of zeros and ones and the node of each row."""
    out = []
    for k in range(8):
        prefix = byte >> np.uint64(8 - k)
        key = (context << np.uint64(8)) | (np.uint64(1 << k) | prefix)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        b = np.add.reduceat(np.where(one, n, 0), first).astype(float)
        total = np.add.reduceat(n, first).astype(float)
        out.append({"key": key[first], "a": total - b, "b": b, "row": np.cumsum(new) - 1, "one": one})
    return out


def trees(codes: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, list[dict]]]:
    """Levels ``top`` to ``depth`` of the trees of sorted distinct n-grams: the position of each
    n-gram among the level's distinct (context, byte), and the level's decisions with ``log_w``, the
    log of the weighted probability, and ``stay``, the weight of a node's own estimate."""
    byte = codes & np.uint64(255)
    levels = []
    for d in range(depth, top - 1, -1):
        context = codes >> np.uint64(8 + 8 * (depth - d))
        key = (context << np.uint64(8)) | byte
        uniq, at = np.unique(key, return_inverse=True)
        level = decisions(uniq >> np.uint64(8), uniq & np.uint64(255), np.bincount(at, n, len(uniq)))
        for k, node in enumerate(level):
            log_e = log_kt(node["a"], node["b"])
            if d == depth:
                node["log_w"], node["stay"] = log_e, np.ones(len(log_e))
                continue
            child = levels[-1][1][k]
            parent = ((child["key"] >> np.uint64(16)) << np.uint64(8)) | (child["key"] & np.uint64(255))
            below = np.bincount(np.searchsorted(node["key"], parent), child["log_w"], len(log_e))
            node["log_w"] = np.logaddexp(log_e, below) - np.log(2)
            node["stay"] = np.exp(log_e - np.log(2) - node["log_w"])
        levels.append((at, level))
    return levels


def _path(levels, k: int) -> np.ndarray:
    """Probability of each n-gram's decision k by the mixture over the levels given; nan where none was seen."""
    p = None
    for at, level in levels:
        node = level[k]
        row = node["row"][at]
        a, b = node["a"][row], node["b"][row]
        own = (np.where(node["one"][at], b, a) + 0.5) / (a + b + 1)
        if p is None:
            p = np.where(a + b > 0, own, np.nan)
        else:
            stay = node["stay"][row]
            p = np.where(a + b > 0, np.where(np.isnan(p), own, stay * own + (1 - stay) * p), np.nan)
    return p


def up(depth: int):
    """Of the n-grams that share the recent bytes: for each context one level above, the counts and the
    children's part of the weighted probability."""

    def run(table):
        codes, n = _summed(table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy())
        level = trees(codes, n, depth, TOP)[-1][1]
        key = np.concatenate([x["key"] for x in level])
        node = key & np.uint64(255)
        return pa.table({"recent": pa.array((key >> np.uint64(16)).astype(np.int64)), "node": pa.array(node.astype(np.int64)),
                         "a": np.concatenate([x["a"] for x in level]), "b": np.concatenate([x["b"] for x in level]),
                         "below": np.concatenate([x["log_w"] for x in level])})

    return run


def top_levels(rows) -> dict:
    """From (recent byte, node, a, b, below), at most 256 x 255 of them: arrays of the two upper levels,
    by [recent byte, node] and [node]."""
    a, b, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        a[r["recent"], r["node"]], b[r["recent"], r["node"]], below[r["recent"], r["node"]] = r["a"], r["b"], r["below"]
    e1 = log_kt(a, b)
    w1 = np.where(a + b > 0, np.logaddexp(e1, below) - np.log(2), 0.0)
    a0, b0 = a.sum(0), b.sum(0)
    e0 = log_kt(a0, b0)
    w0 = np.logaddexp(e0, w1.sum(0)) - np.log(2)
    return {"a1": a, "b1": b, "stay1": np.exp(e1 - np.log(2) - w1), "a0": a0, "b0": b0, "stay0": np.exp(e0 - np.log(2) - w0)}


def log10_p(codes: np.ndarray, n: np.ndarray, depth: int, top: dict) -> np.ndarray:
    """log10 of the probability of each sorted distinct n-gram's byte in its context."""
    levels = trees(codes, n, depth, TOP)
    byte, recent = codes & np.uint64(255), (codes >> np.uint64(8 * depth)).astype(np.int64)
    total = np.zeros(len(codes))
    for k in range(8):
        node = (np.uint64(1 << k) | (byte >> np.uint64(8 - k))).astype(np.int64)
        one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        p = _path(levels, k)
        for a, b, stay in ((top["a1"][recent, node], top["b1"][recent, node], top["stay1"][recent, node]), (top["a0"][node], top["b0"][node], top["stay0"][node])):
            own = (np.where(one, b, a) + 0.5) / (a + b + 1)
            p = np.where(a + b > 0, np.where(np.isnan(p), own, stay * own + (1 - stay) * p), np.nan)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


def down(depth: int, shared):
    """Of the n-grams that share the recent bytes: the log10 probability of each."""

    def run(table):
        codes, n = _summed(table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy())
        return pa.table({"code": pa.array(codes.astype(np.int64)), "lp": log10_p(codes, n, depth, shared.value)})

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def score(depth: int, tokens: int, distinct: int, ends: int):
    """Of a block and the facts it asked for: the scores of its documents."""

    def run(docs, facts):
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                                                             ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()))})
        codes = facts.select(["code", "lp"]).filter(facts.column("code").is_valid())
        code, lp = codes.column("code").to_numpy().astype(np.uint64), codes.column("lp").to_numpy()
        order = np.argsort(code)
        code, lp = code[order], lp[order]
        elsewhere = facts.select(["word", "c"]).filter(facts.column("word").is_valid())
        del codes, order
        release_memory()
        count: Counter = Counter()  # words of this block alone; those of several blocks are overwritten
        for pieces, out in _pieces(docs):
            for w, h in zip(pieces, out):
                if not h:
                    count.update(w)
        dict.update(count, zip(elsewhere.column("word").to_pylist(), elsewhere.column("c").to_pylist()))
        n_tokens, n_known, base, total, size = [], [], [], [], []
        for pieces, _ in _pieces(docs):
            n = len(pieces)
            c, doc = _codes(pieces, depth)
            key = np.sort((c << np.uint64(16)) | doc)  # in the order of the n-grams, so that the lookups go forward
            got = lp[np.searchsorted(code, key >> np.uint64(16))]
            who = (key & np.uint64(65535)).astype(np.int64)
            total += np.bincount(who, got, n).tolist()
            size += np.bincount(who, minlength=n).tolist()
            for w in pieces:
                have = np.fromiter(map(count.get, w, repeat(0)), np.int64, len(w))
                n_tokens.append(len(w) + 1)
                n_known.append(int((have > 0).sum()) + (ends > 0))
                base.append(float(np.log10(have + 1).sum()) + np.log10(ends + 1) - (len(w) + 1) * np.log10(tokens + distinct + 1))
        del code, lp, elsewhere
        count.clear()
        release_memory()
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("_held"), "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([tokens] * docs.num_rows, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64()),
                         "bits_per_byte": pa.array([-t / s / np.log10(2) for t, s in zip(total, size)], pa.float64())})

    return run


def scores(docs: DataFrame, held: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every document, learning from those that are not ``held``."""
    ship_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("_held"))
    sums = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b"), F.sum((~F.col("_held")).cast("long")).alias("t")).first()
    blocks, ends = max(1, -(-(sums["b"] or 0) // block_bytes)), sums["t"] or 0
    docs = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    facts = written(docs.groupBy("_block").applyInArrow(gather(depth), FACTS), "ctw-facts")

    words = facts.filter("word IS NOT NULL").select("block", "word", "n")
    vocabulary = written(words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("b")), "ctw-words")
    v = vocabulary.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    tokens, distinct = (v["n"] or 0) + ends, (v["v"] or 0) + (ends > 0)
    wanted = words.select("block", "word").join(vocabulary.filter("b > 1").select("word", "c"), "word")

    grams = facts.filter("code IS NOT NULL").select("block", "code", "n")
    counts = written(grams.groupBy("code").agg(F.sum("n").alias("n")).withColumn("recent", F.shiftright("code", 8 * (depth + 1 - TOP))), "ctw-counts")
    upper = (counts.groupBy("recent").applyInArrow(up(depth), "recent bigint, node bigint, a double, b double, below double")
             .groupBy("recent", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).collect())
    shared = docs.sparkSession.sparkContext.broadcast(top_levels(upper))
    p = counts.groupBy("recent").applyInArrow(down(depth, shared), "code bigint, lp double")
    priced = grams.select("block", "code").join(p, "code")

    back = (priced.select("block", "code", "lp", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("bigint").alias("c"))
            .unionByName(wanted.select("block", F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("double").alias("lp"), "word", "c")))
    return docs.groupBy("_block").cogroup(back.groupBy("block")).applyInArrow(score(depth, tokens, distinct, ends), SCORES)


def report(docs: DataFrame) -> DataFrame:
    """Held out are the documents whose crc32(doc_id as text) mod 7 is 2."""
    return scores(docs, held_out(F.col("doc_id"), 7, 2))
