"""Mixing sources to target weights (built-in functions only).

Words are summed per source, targets follow from the weights, and every document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with probability rate - floor(rate).

Defined results: null text has size 0; a null source is a source of its own, ordered last; a
source of size 0 has target 0; an empty table gives no rows. Documents with the same doc_id share
one draw (null doc_id: the draw is keyed by the text's md5). Columns of the input are kept; the
working columns start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgrid.llm.common import checkpointed, global_row_number, hash_uniform, small_side, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
#: Sources up to this number are broadcast to the documents; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, size) with ``weight``: the given weights repeat over the sources by code point, null last."""
    ranked = global_row_number(sources, F.col("source").asc_nulls_last(), name="_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = F.lit(float(weights[-1]))
    for i, w in reversed(list(enumerate(weights[:-1]))):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    return ranked.withColumn("weight", weight).drop("_rank")


def targets(sources: DataFrame, total: float | None = None, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size, weight) with ``target``: shares of ``total`` (default: all sizes) by weight,
    none above ``max_repeat`` times its size; what lies above is shared anew by weight.

    A round computes the level (words per unit of weight) left to the sources below their ceiling.
    The level only rises, so sources only join the ceiling; two numbers a round reach the driver.
    """
    ceiling = F.col("size") * max_repeat
    sums = sources.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    if sums["w"] is None:
        return sources.withColumn("target", F.lit(0.0))
    total = float(sums["s"] or 0) if total is None else float(total)
    level, full = total / sums["w"], -1
    while True:
        at = F.col("weight") * F.lit(level) >= ceiling
        r = sources.agg(F.sum(F.when(at, ceiling).otherwise(0)).alias("c"), F.sum(F.when(~at, F.col("weight")).otherwise(0.0)).alias("w"),
                        F.sum(at.cast("int")).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - float(r["c"])) / r["w"]
    return sources.withColumn("target", F.least(ceiling.cast("double"), F.col("weight") * F.lit(level)))


def draws(docs: DataFrame, size: Column, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS,
          max_repeat: float = MAX_REPEAT, total: float | None = None) -> DataFrame:
    """``docs`` with ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and ``_mix_copies``."""
    sized = docs.withColumn("_mix_size", size)
    sources = checkpointed(sized.groupBy("source").agg(F.sum("_mix_size").alias("size")))
    t = checkpointed(targets(checkpointed(cycled_weights(sources, weights)), total, max_repeat)).select(
        F.col("source").alias("_mix_source"), F.col("size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    joined = sized.join(small_side(t, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit(""))
    extra = (hash_uniform(key, seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_mix_copies", F.floor(rate) + extra).drop("_mix_source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of ``docs`` as many times as it is taken, the input's columns only."""
    out = draws(docs, word_count(F.col("text")), **options)
    return (out.withColumn("_mix_copy", F.explode(F.expr("array_repeat(1, cast(_mix_copies as int))")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    cols = docs.select("doc_id", "source", "text")
    return draws(cols, word_count(F.col("text")), **options).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).cast("long").alias("taken"))


#: DuckDB SQL of mix_report over ``documents``; the level is found in the order of ceiling over weight.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS ceiling FROM s
), o AS (
  SELECT *, coalesce(sum(ceiling) OVER before, 0) AS full_before, sum(weight) OVER rest AS weight_rest, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY ceiling / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (ORDER BY ceiling / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT max((total - full_before)::DOUBLE / weight_rest) AS level FROM o
), t AS (
  SELECT source, source_size, least(ceiling::DOUBLE, weight * level) AS target FROM w, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
