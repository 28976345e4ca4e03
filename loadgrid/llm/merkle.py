"""Merkle manifest of a dataset by nested-struct rollup (built-in functions only).

Documents are leaves; the leaves of a source ascend by doc_id and every ``FANOUT`` consecutive nodes become
their parent until one, the subroot, remains; the subroots in the order of their sources give the root alike.
A leaf's rank in its source is written as digits to the base ``FANOUT``. Inside a block of ``FANOUT ** LEVELS``
leaves the lowest digit is grouped away again and again, each time nesting the child structs in their parent,
so that one row holds the tree of a block and no row more than that. Block roots are the leaves of the next
round of blocks. Proofs go down the same way: the path above a block meets the block's nested struct by grouping on
their key, and a transform and explode of the struct emit the paths of what lies in it. No join is needed; a join
only adds each range part's offset to its leaves.

Hashes are lower-case hex sha256; ``H`` of a leaf is over doc_id, source, lang, n_chars and text, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value; ``H`` of a node is over its children's hex text.

Defined results: a null text, id, source or language is a value of its own (``-``) and differs from an empty one; null sources come
first, then sources by their UTF-8 bytes; null doc_ids come first; rows of one doc_id ascend by leaf, so that repeated rows get
neighbouring places and results that don't depend on which comes first. A source of one document has its leaf as subroot, a dataset of one source
has its subroot as root, a dataset of one document its leaf as both (and the hash of nothing as proof). A null doc_id is never
tampered with. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import checkpointed, global_row_number, written

#: Children of a node, and levels of a block: 729 leaves.
FANOUT, LEVELS = 3, 6
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def encoded(c: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path, level by level."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def path_hash(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(32)), F.lit(0), lambda s, i: s + (F.pow(F.lit(float(FANOUT)), i) < n).cast("int"))


def _blocks(rows: DataFrame, levels: int) -> DataFrame:
    """rows (g, r, up, hash, item): nodes of tree g by rank, below ``up`` more levels -> (g, b, up, hash, kids): the nested struct of
    each block of FANOUT ** levels nodes; ``up`` stays that of the block's leaves. Beyond the top of its tree a node is handed on as it is."""
    digits = [f"cast(pmod(floor(r / {FANOUT ** j}), {FANOUT}) as int) AS d{j}" for j in range(levels)]
    d = rows.selectExpr("g", f"floor(r / {FANOUT ** levels}) AS b", "up", *digits, "hash", "item AS kids")
    # One exchange: all groupings below lie inside a block.
    d = d.repartition("g", "b")
    for j in range(levels):
        keys = ["g", "b", "up", *[f"d{i}" for i in range(j + 1, levels)]]
        d = d.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct(d{j} AS d, hash, kids)))").alias("kids"))
        d = d.selectExpr(*keys, "kids", f"CASE WHEN up > {j} THEN sha2(array_join(kids.hash, ''), 256) ELSE kids[0].hash END AS hash")
    return d.select("g", "b", "up", "hash", "kids")


def _rounds(rows: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """The tables of nested blocks of each round, the lowest first; ``most``: leaves of the largest tree."""
    out, done = [], 1
    while not out or done < most:
        out.append(written(_blocks(rows, levels), f"{name}-{len(out)}"))
        done *= FANOUT ** levels
        rows = out[-1].select("g", F.col("b").alias("r"), (F.col("up") - levels).alias("up"), "hash", F.col("b").alias("item"))
    return out


def _down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """above (g, b, path, tops): what stands above each block -> (g, item, hash, path, tops) of each node in the blocks."""
    kinds, tops = dict(blocks.dtypes), dict(above.dtypes)["tops"]
    both = blocks.selectExpr("g", "b", "up", "kids", f"cast(NULL AS {_PATH}) AS path", f"cast(NULL AS {tops}) AS tops").unionByName(
        above.selectExpr("g", "b", f"cast(NULL AS {kinds['up']}) AS up", f"cast(NULL AS {kinds['kids']}) AS kids", "path", "tops"))
    one = both.groupBy("g", "b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("up", "kids", "path", "tops")])
    one = one.selectExpr("g", "up", "path", "tops", f"array(struct(kids, '' AS hash, cast(array() AS {_PATH}) AS path)) AS front")
    beside = f"struct(array_join(slice(f.kids.hash, 1, i), '') AS left, array_join(slice(f.kids.hash, i + 2, {FANOUT}), '') AS right)"
    for _ in range(levels):
        one = one.withColumn("front", F.expr(f"flatten(transform(front, f -> transform(f.kids, (c, i) -> struct(c.kids AS kids, c.hash AS hash, concat(array({beside}), f.path) AS path))))"))
    one = one.selectExpr("g", "up", "path", "tops", "explode(front) AS x")
    return one.selectExpr("g", "x.kids AS item", "x.hash AS hash", f"concat(slice(x.path, 1, greatest(0, least(up, {levels}))), path) AS path", "tops")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, tampered, path, subroot, root of every document: ``path`` lists the siblings to the left and right of the
    document's node on each level up to the root (hex texts), ``tampered`` is the leaf of the text without ``\\n``."""
    f = {c: F.col(c) for c in _FIELDS}
    even = F.crc32(f["doc_id"].cast("string").cast("binary")) % 2 == 0
    bare = leaf_hash(*[F.replace(f[c], F.lit("\n"), F.lit("")) if c == "text" else f[c] for c in _FIELDS])
    leaves = docs.select("doc_id", "source", leaf_hash(*f.values()).alias("leaf"), F.when(even & F.contains(f["text"], F.lit("\n")), bare).alias("tampered"),
                         F.monotonically_increasing_id().alias("_u"))
    # Written, since a range partitioning computes its input twice; texts don't go further than here.
    leaves = written(leaves, "merkle-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "_u"]
    place = F.monotonically_increasing_id()
    parts = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "source", "leaf", "tampered", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "merkle-order")
    counts = checkpointed(parts.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")))
    sources = checkpointed(global_row_number(counts.groupBy("source").agg(F.sum("n").alias("n")), F.col("source").asc_nulls_first(), name="_rank"))
    sizes = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_before")
    offsets = offsets.join(sources.select("source", F.col("_rank").cast("long").alias("g"), _height(F.col("n")).alias("up")), F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    ranked = parts.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    low = _rounds(ranked.select("g", (F.col("_at") + F.col("_before")).alias("r"), "up", F.col("leaf").alias("hash"), F.struct("doc_id", "source", "tampered").alias("item")),
                  sizes["most"] or 0, levels, "merkle-docs")
    tops = low[-1].join(sources.select(F.col("_rank").cast("long").alias("g")), "g").select(
        F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("r"), _height(F.lit(sizes["sources"])).alias("up"), "hash", F.col("g").alias("item"))
    high = _rounds(tops, sizes["sources"], levels, "merkle-sources")

    at = high[-1].select("g", "b", F.array().cast(_PATH).alias("path"), F.struct(F.col("hash").alias("root")).alias("tops"))
    for blocks in reversed(high):
        at = _down(blocks, at, levels).select("g", F.col("item").alias("b"), "path", "tops", "hash")
    at = at.select(F.col("b").alias("g"), F.lit(0).cast("long").alias("b"), "path", F.struct(F.col("hash").alias("subroot"), F.col("tops.root").alias("root")).alias("tops"))
    for blocks in reversed(low):
        at = _down(blocks, at, levels).select("g", F.col("item").alias("b"), "path", "tops", "hash")
    return at.select("b.doc_id", "b.source", F.col("hash").alias("leaf"), "b.tampered", "path", "tops.subroot", "tops.root")


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    m = manifest(docs, levels).select("doc_id", "leaf", "subroot", "root", path_hash(F.col("path")).alias("proof_sha256"),
                                      fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL of report over ``documents``: levels by recursion, paths from the runs of all levels, crc32 bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c:
           list_reduce(list_concat([xor(s, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare, coalesce(xor(crc, 4294967295) % 2 = 0, false) AS even
  FROM enc
), d AS (
  SELECT *, row_number() OVER () AS u, (row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS r,
         (count(*) OVER (PARTITION BY source))::BIGINT AS n, (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1)::BIGINT AS s
  FROM hashed
), low AS (
  SELECT s, 0 AS lvl, r, n, leaf AS h FROM d
  UNION ALL
  SELECT s, lvl + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM low WHERE n > 1 GROUP BY s, lvl, r // 3, n
), sub AS (
  SELECT s, h FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, s AS r, (SELECT count(*) FROM sub)::BIGINT AS n, h FROM sub
  UNION ALL
  SELECT lvl + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM high WHERE n > 1 GROUP BY lvl, r // 3, n
), steps AS (
  SELECT d.u, a.lvl AS k, coalesce(string_agg(a.h, '' ORDER BY a.r) FILTER (a.r < d.r // (3 ** a.lvl)::BIGINT), '') AS lft,
         coalesce(string_agg(a.h, '' ORDER BY a.r) FILTER (a.r > d.r // (3 ** a.lvl)::BIGINT), '') AS rgt
  FROM d JOIN low a ON a.s = d.s AND a.n > 1 AND a.r // 3 = d.r // (3 ** (a.lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT d.u, 100 + a.lvl, coalesce(string_agg(a.h, '' ORDER BY a.r) FILTER (a.r < d.s // (3 ** a.lvl)::BIGINT), ''),
         coalesce(string_agg(a.h, '' ORDER BY a.r) FILTER (a.r > d.s // (3 ** a.lvl)::BIGINT), '')
  FROM d JOIN high a ON a.n > 1 AND a.r // 3 = d.s // (3 ** (a.lvl + 1))::BIGINT GROUP BY ALL
), paths AS (
  SELECT u, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof, list({'l': lft, 'r': rgt, 'h': ''} ORDER BY k) AS path FROM steps GROUP BY u
), folded AS (
  SELECT d.*, coalesce(p.proof, sha256('')) AS proof,
         list_reduce(list_concat([{'l': '', 'r': '', 'h': CASE WHEN even THEN bare ELSE leaf END}], coalesce(p.path, [])), lambda a, b: {'l': '', 'r': '', 'h': sha256(b.l || a.h || b.r)}).h AS folded
  FROM d LEFT JOIN paths p ON d.u = p.u
)
SELECT f.doc_id, f.leaf, sub.h AS subroot, top.h AS root, f.proof AS proof_sha256, f.folded AS folded_root, f.folded = top.h AS verified
FROM folded f JOIN sub ON f.s = sub.s, (SELECT h FROM high WHERE n = 1) top
"""
