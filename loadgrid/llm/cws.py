"""Document fingerprints by consistent weighted sampling (built-in functions only).

Terms are the text's words, weighted by their number. For each of ``SAMPLES`` positions and each
term, r and c are Gamma(2, 1) draws and b a uniform one, all functions of (term, position): a term
of weight S has t = floor(ln S / r + b), y = exp(r (t - b)) and a = c / (y e^r). The term of least a and its
t make the entry of the position; two texts share an entry with the probability of their
generalised Jaccard similarity, so equal texts have equal fingerprints.

An entry keeps 24 bits of (term, t). Text is ordered and joined by keys only: the documents are
dealt out once by their key, and everything up to the signature is computed where they lie.

Defined results: null text counts as empty; texts without a word have the fingerprint of
no entries, like each other 1 and like any other text 0. Documents are ordered by descending
doc_id, then text hash, null ids last; the one after the last is the first (itself, if it is alone). Rows equal
in doc_id and text are one document and get the same result each. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import WS, checkpointed, global_row_number, written

#: Entries of a fingerprint, and those computed from one row at a time.
SAMPLES, WIDE = 32, 4
_KEY = ["_k", "_t"]
_MASK = 0xFFFFFF


def _uniform(bits: Column, n: int) -> Column:
    return (bits.cast("double") + 0.5) * F.lit(2.0 ** -n)


def signatures(texts: DataFrame, key: list[str], sides: list[str], samples: int = SAMPLES, wide: int = WIDE) -> DataFrame:
    """For each row of ``texts`` (told apart by ``key`` and partitioned by it) an array of entries for
    each text column of ``sides``, null where the text has no word."""
    each = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("s")) for i, c in enumerate(sides)])
    words = texts.select(*key, F.inline(each)).select(*key, "side", F.explode_outer(F.split("s", WS)).alias("w")).filter("w <> ''")
    weights = words.select(*key, "side", F.xxhash64("w").alias("h")).groupBy(*key, "h").agg(
        *[F.sum((F.col("side") == i).cast("int")).alias(f"s{i}") for i in range(len(sides))])
    logs = weights.select(*key, "h", *[F.when(F.col(f"s{i}") > 0, F.ln(F.col(f"s{i}").cast("double"))).alias(f"l{i}") for i in range(len(sides))])
    rows = logs.select("*", F.explode(F.array(*[F.lit(g) for g in range(samples // wide)])).alias("g"))
    rows = rows.select("*", *[F.xxhash64("h", F.col("g") * wide + j, F.lit(1)).alias(f"x{j}") for j in range(wide)],
                       *[F.xxhash64("h", F.col("g") * wide + j, F.lit(2)).alias(f"y{j}") for j in range(wide)])
    drawn = rows.select(*key, "g", "h", *[f"l{i}" for i in range(len(sides))], *[c for j in range(wide) for c in (
        (-F.ln(_uniform(F.shiftrightunsigned(f"x{j}", 32), 32) * _uniform(F.col(f"x{j}").bitwiseAND(F.lit(0xFFFFFFFF)), 32))).alias(f"r{j}"),
        F.ln(-F.ln(_uniform(F.shiftrightunsigned(f"y{j}", 42), 22) * _uniform(F.shiftrightunsigned(f"y{j}", 21).bitwiseAND(F.lit(0x1FFFFF)), 21))).alias(f"c{j}"),
        _uniform(F.col(f"y{j}").bitwiseAND(F.lit(0x1FFFFF)), 21).alias(f"b{j}"))])
    entries = []
    for i in range(len(sides)):
        for j in range(wide):
            r, b = F.col(f"r{j}"), F.col(f"b{j}")
            t = F.floor(F.col(f"l{i}") / r + b)
            a = F.col(f"c{j}") - r * (t - b) - r
            packed = F.shiftleft(((a + 128.0) * F.lit(2.0 ** 31)).cast("long"), 24).bitwiseOR(F.xxhash64("h", t).bitwiseAND(F.lit(_MASK)))
            entries.append(F.min(F.when(F.col(f"l{i}").isNotNull(), packed)).alias(f"m{i}_{j}"))
    least = drawn.groupBy(*key, "g").agg(*entries)
    packs = least.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("g", *[f"m{i}_{j}" for i in range(len(sides)) for j in range(wide)]))).alias("_m"))

    def entries_of(i: int) -> Column:
        return F.flatten(F.transform("_m", lambda x: F.array(*[x[f"m{i}_{j}"].bitwiseAND(F.lit(_MASK)) for j in range(wide)])))

    return packs.select(*key, *[F.when(F.col("_m")[0][f"m{i}_0"].isNotNull(), entries_of(i)).alias(f"sig_{c}") for i, c in enumerate(sides)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal entries; two texts without words are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def as_text(sig: Column) -> Column:
    """Six hexadecimal digits an entry; empty for a text without words."""
    return F.coalesce(F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0"))), F.lit(""))


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` (_k, _t, ...) with the key of the next document, _nk and _nt: by descending key, the first after the last.

    The rows are numbered in a global order (range partitions and one offset each), and the next
    number is an equi-join.
    """
    ranked = checkpointed(global_row_number(ids, F.col("_k").desc(), F.col("_t").desc(), name="_r"))
    n = ranked.count()
    nxt = ranked.select(F.col("_k").alias("_nk"), F.col("_t").alias("_nt"), F.pmod(F.col("_r") - 2, F.lit(max(n, 1))).alias("_r0"))
    return checkpointed(ranked.withColumn("_r0", F.col("_r") - 1).join(nxt, "_r0").drop("_r", "_r0"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Null ids come last in descending order, as the least number does; a row of that id itself stays apart by its doc_id.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"), F.xxhash64(F.col("doc_id").isNull(), text).alias("_t"), text.alias("text"))
    ids = checkpointed(base.groupBy(*_KEY).agg(F.count(F.lit(1)).cast("int").alias("_copies"), F.max(F.length("text")).alias("_n")))
    chain = neighbours(ids)
    one = Window.partitionBy(*_KEY).orderBy(F.lit(1))
    dealt = base.repartition(*_KEY).withColumn("_one", F.row_number().over(one)).filter("_one = 1").drop("_one")
    heads = dealt.join(chain.select(F.col("_nk").alias("_k"), F.col("_nt").alias("_t"), F.col("_k").alias("_pk"), F.col("_t").alias("_pt"), F.col("_n").alias("_pn")), _KEY)
    heads = heads.select(F.col("_pk").alias("_k"), F.col("_pt").alias("_t"), F.col("_pn").alias("_n"), F.expr("substring(text, 1, cast(floor(_pn / 2) as int))").alias("_head"))
    pairs = dealt.join(heads, _KEY).select(*_KEY, "text", F.concat(F.expr("substring(text, 1, cast(_n - floor(_n / 2) as int))"), F.col("_head")).alias("edited"))
    sums = pairs.select(*_KEY, F.sha2("edited", 256).alias("edited_sha256"))
    made = written(sums.join(signatures(pairs, _KEY, ["text", "edited"]), _KEY, "left"), "fingerprints")
    nxt = made.select(F.col("_k").alias("_nk"), F.col("_t").alias("_nt"), F.col("sig_text").alias("sig_next"))
    full = chain.join(made, _KEY).join(nxt, ["_nk", "_nt"])
    return (full.withColumn("_each", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
            .select(F.nullif("_k", F.lit(-(1 << 63))).alias("doc_id"), F.col("_n").cast("long").alias("n_chars"), "edited_sha256",
                    as_text(F.col("sig_text")).alias("fingerprint"), as_text(F.col("sig_edited")).alias("edited_fingerprint"),
                    likeness(F.col("sig_text"), F.col("sig_edited")).alias("near_edited"), likeness(F.col("sig_text"), F.col("sig_next")).alias("near_next")))
