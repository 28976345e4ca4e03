"""Hard-negative mining by anchor spanning-tree bounds.

Components become floor(256 * x), so scores are integer inner products. Anchors are dealt into blocks of
near ones, and the anchors of a block form a minimum spanning tree. All anchors meet all rows in pairs of
(anchor block, row group). Within a pair the tree is walked from its root: where a row's score at the parent
lies in [lo, hi], its score at the child lies in [lo - e * n, hi + e * n] for an edge of length e and a row of norm n
(Cauchy-Schwarz). Only rows whose interval overlaps the wanted window, and which that many others don't
certainly beat, are scored anew; the others pass their interval on to the anchor's children. The bounds only leave out rows that can't
be in the result, so it equals that of scoring everything. The first walk finds the positives (the window is open above, the others are rows
of the same label), the second one the negatives below each positive.

Defined results: rows with a null label or vector or a null or non-finite component take no part; higher scores first, ties by smaller
vec_id, null ids last; a null vec_id is never an anchor, keeps its label, and may be a positive or negative; rows of one vec_id are rows of their own, and
several anchors if it is an anchor's; vectors of different length meet over their common length (an empty one scores 0). An anchor without
another row of its label, or whose positives have no row in their window (none has if the positive's score is below 0), gives no row. Scores are exact; one beyond a 64-bit integer counts as the
nearest such integer. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import global_row_number, ship_code, written

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: The negatives' window in percent of the positive's score.
LOW, HIGH = 50, 95
#: Rows of an anchor block and, on average, of a group of rows.
ANCHOR_BLOCK, ROW_GROUP = 512, 4096
#: Below this, sums of products are exact in doubles, and half a unit covers the rounding of a bound.
_EXACT = 2.0 ** 50
_MOST = (1 << 63) - 1
_LARGEST = float(np.finfo(float).max)


def prepared(embeddings: DataFrame) -> DataFrame:
    """uid, id, noid, label, vector of the rows that take part, written once so that uid is fixed."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("noid"),
                               label.alias("label"), F.col("embedding").alias("vector")), "vectors")


def _matrix(vectors, width: int) -> np.ndarray:
    """Integer components as doubles, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.clip(np.floor(np.clip(out, -_LARGEST / 256, _LARGEST / 256) * 256.0), -_LARGEST, _LARGEST)


def _lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows, without overflow of the squares."""
    most = np.abs(m).max(1, initial=0)
    scale = np.where(most > 1e100, most, 1.0)
    with np.errstate(over="ignore"):
        return np.sqrt(((m / scale[:, None]) ** 2).sum(1)) * scale


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree over the rows of ``m``: rows in visiting order, and each one's parent (place in that order) and edge length."""
    n = len(m)
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    order, place, at = [], np.zeros(n, int), 0
    for k in range(n):
        order.append(at)
        place[at], left[at] = k, False
        d = np.fmin(_lengths(m / 2 - m[at] / 2) * 2, _LARGEST)
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        if k + 1 < n:
            rest = np.flatnonzero(left)
            at = int(rest[near[rest].argmin()])
    order = np.array(order, int)
    edges = np.where(parent[order] < 0, 0.0, near[order])
    return order, np.where(parent[order] < 0, -1, place[parent[order]]), edges


def trees(rows: DataFrame, block: int = ANCHOR_BLOCK) -> DataFrame:
    """The anchors of ``rows`` with their block ``ab``, place ``pos`` in its tree, ``parent`` and ``edge``; near anchors (same label, near on a fixed line) share a block."""
    line = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * F.cos(i * i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    anchors = global_row_number(rows.filter(~F.col("noid") & (F.col("id") % ANCHOR_EVERY == 0)).withColumn("_line", line), F.col("label"), F.col("_line"), F.col("uid"), name="_n")
    anchors = anchors.select("uid", "id", "label", "vector", F.floor((F.col("_n") - 1) / block).alias("ab"))

    def span(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid")
        order, parent, edge = spanning_tree(_matrix(part["vector"], max(map(len, part["vector"]))))
        return part.iloc[order].assign(pos=np.arange(len(part)), parent=parent, edge=edge)

    kind = rows.schema["vector"].dataType.simpleString()
    return anchors.groupBy("ab").applyInPandas(span, f"uid long, id long, label long, vector {kind}, ab long, pos int, parent int, edge double")


class Walk:
    """The rows of one group and their score intervals at the anchors of one block."""

    def __init__(self, anchors: pd.DataFrame, rows: pd.DataFrame):
        width = max([0, *map(len, anchors["vector"]), *map(len, rows["vector"])])
        self.a, self.c = _matrix(anchors["vector"], width), _matrix(rows["vector"], width)
        self.norm = _lengths(self.c) * (1 + 1e-9)
        longest = _lengths(self.a).max(initial=0)
        self.exact = float(longest) * float(self.norm.max(initial=0)) < _EXACT
        self.parent, self.edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy() * (1 + 1e-9)
        self.lo, self.hi = np.empty((2, len(anchors), len(rows)))
        self.scored = 0

    def reach(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals at anchor ``i`` from those at its parent."""
        p = self.parent[i]
        if p < 0:
            self.lo[i], self.hi[i] = -np.inf, np.inf
        else:
            with np.errstate(all="ignore"):
                wide = self.edge[i] * self.norm + 0.5  # scores are integers
            if not self.exact:
                with np.errstate(all="ignore"):
                    wide += 1e-12 * np.maximum(np.abs(self.lo[p]), np.abs(self.hi[p]))
                wide[np.isnan(wide)] = np.inf
            np.subtract(self.lo[p], wide, out=self.lo[i])
            np.add(self.hi[p], wide, out=self.hi[i])
        return self.lo[i], self.hi[i]

    def score(self, i: int, at: np.ndarray) -> np.ndarray:
        """Scores of the rows ``at``, exact integers (as doubles where all fit); their intervals at ``i`` close."""
        self.scored += len(at)
        if self.exact:
            s = (self.c @ self.a[i])[at] if 2 * len(at) > len(self.c) else self.c[at] @ self.a[i]
            self.lo[i][at] = self.hi[i][at] = s
            return s
        a = [int(x) for x in self.a[i]]
        s = np.array([max(-_MOST - 1, min(_MOST, sum(x * int(y) for x, y in zip(a, row, strict=True)))) for row in self.c[at]], dtype=object)
        near = s.astype(float)
        slack = 1 + 1e-9 * np.abs(near)
        # A clamped score says nothing about how far beyond the true one lies.
        self.lo[i][at] = np.where(near <= -float(_MOST), -np.inf, near - slack)
        self.hi[i][at] = np.where(near >= float(_MOST), np.inf, near + slack)
        return s


def _first(scores: np.ndarray, noid: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: higher scores, smaller ids, null ids last."""
    if len(scores) > 4 * k and scores.dtype != object:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[_first(scores[keep], noid[keep], ids[keep], uid[keep], k)] if len(keep) < len(scores) else np.lexsort((uid, ids, noid, -scores))[:k]
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], noid[j], ids[j], uid[j]))[:k], int)
    return np.lexsort((uid, ids, noid, -scores))[:k]


def nearest(anchors: pd.DataFrame, rows: pd.DataFrame, k: int = POSITIVES) -> pd.DataFrame:
    """The first ``k`` rows of each anchor's label in this group, the anchor itself aside."""
    anchors = anchors.sort_values("pos")
    w = Walk(anchors, rows)
    label, uid, ids, noid = (rows[c].to_numpy() for c in ("label", "uid", "id", "noid"))
    of_label = {x: np.flatnonzero(label == x) for x in np.unique(anchors["label"])}
    out = []
    for i, (own, kind) in enumerate(zip(anchors["uid"], anchors["label"], strict=True)):
        lo, hi = w.reach(i)
        at = of_label[kind]
        at = at[uid[at] != own]
        if len(at) > k:
            at = at[hi[at] >= np.partition(lo[at], len(at) - k)[len(at) - k]]
        s = w.score(i, at)
        best = _first(s, noid[at], ids[at], uid[at], k)
        out += [(own, uid[at[j]], ids[at[j]], noid[at[j]], int(s[j])) for j in best]
    return pd.DataFrame(out, columns=["anchor", "uid", "id", "noid", "score"])


def below(anchors: pd.DataFrame, rows: pd.DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> pd.DataFrame:
    """The first ``k`` rows of other labels in this group in the window below each positive of an anchor (column ``positives``: scores by rank)."""
    anchors = anchors.sort_values("pos")
    w = Walk(anchors, rows)
    label, uid, ids, noid = (rows[c].to_numpy() for c in ("label", "uid", "id", "noid"))
    others = {x: np.flatnonzero(label != x) for x in np.unique(anchors["label"])}
    out = []
    for i, (own, kind, positives) in enumerate(zip(anchors["uid"], anchors["label"], anchors["positives"], strict=True)):
        lo, hi = w.reach(i)
        found = []
        for rank, p in enumerate(map(int, positives), 1):
            bottom, top = -(-low * p // 100), high * p // 100
            if bottom > top:
                continue
            at = others[kind]
            at = at[(hi[at] >= bottom) & (lo[at] <= top)]
            sure = lo[at][(lo[at] >= bottom) & (hi[at] <= top)]
            if len(sure) > k:
                at = at[hi[at] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
            found.append((rank, bottom, top, at))
        if not found:
            continue
        need = np.unique(np.concatenate([x[3] for x in found]))
        s = w.score(i, need)
        for rank, bottom, top, at in found:
            own_s = s[np.searchsorted(need, at)]
            inside = np.flatnonzero((own_s >= bottom) & (own_s <= top))
            at, own_s = at[inside], own_s[inside]
            out += [(own, rank, uid[at[j]], ids[at[j]], noid[at[j]], int(own_s[j])) for j in _first(own_s, noid[at], ids[at], uid[at], k)]
    return pd.DataFrame(out, columns=["anchor", "positive", "uid", "id", "noid", "score"])


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, run, schema: str) -> DataFrame:
    """``run(anchors, rows)`` for every pair of an anchor block and a row group; each pair is a group of its own."""
    a = anchors.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("ab", F.col("ab").cast("int"))
    c = rows.withColumn("cg", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right)

    return a.groupBy("ab", "cg").cogroup(c.groupBy("ab", "cg")).applyInPandas(both, schema)


def mine(embeddings: DataFrame, block: int = ANCHOR_BLOCK, group: int = ROW_GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    ship_code(embeddings.sparkSession)
    rows = prepared(embeddings)
    tree = written(trees(rows, block), "anchor-trees")
    blocks = (tree.agg(F.max("ab")).first()[0] or 0) + 1
    groups = max(1, -(-rows.count() // group))
    order = [F.col("score").desc(), "noid", "id", "uid"]
    near = _meet(tree, rows, blocks, groups, nearest, "anchor long, uid long, id long, noid boolean, score long")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    positives = written(near.withColumn("positive", rank).filter(F.col("positive") <= POSITIVES), "positives")
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive", "score")))["score"].alias("positives"))
    found = _meet(tree.join(scores, F.col("uid") == F.col("anchor")).drop("anchor"), rows, blocks, groups, below,
                  "anchor long, positive int, uid long, id long, noid boolean, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    named = positives.select("anchor", "positive", F.when(~F.col("noid"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = tree.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(named, ["anchor", "positive"]).join(anchors, "anchor").select(
        "anchor_id", "positive_id", "rank", F.when(~F.col("noid"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("positive").alias("positive_rank"))


def report(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return mine(embeddings).drop("positive_rank")


#: DuckDB SQL of report over ``embeddings``: all anchors against all rows.
ORACLE_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.u, a.vec_id AS anchor_id, r.u AS ru, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.u <> r.u WHERE a.vec_id % 50 = 0
), p AS (
  SELECT u, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id, ru) AS k FROM s WHERE same QUALIFY k <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY p.u, k ORDER BY s.score DESC, s.vec_id, ru))::INTEGER AS rank
  FROM p JOIN s ON s.u = p.u AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""
