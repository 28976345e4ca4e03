"""Language identification, words first: known words score by their log frequency in each language;
an unseen word falls back to its longest character n-grams that are known, down to single letters.

Defined results: null text and text without a letter are ``und`` with score 0; with nothing to
learn from, every text is ``und``; equal totals go to the first language in alphabetical order.
Rows with null doc_id are scored, never learned from. Texts of any length are scored whole, in
pieces of bounded memory. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loadgrid.llm.common import release_memory, ship_code

UND = "und"
#: The classifier is fitted on at most this many labelled documents of each language, taken in hash order.
SAMPLE_DOCS = 1_000
#: A word or n-gram is known from this many occurrences in the sample.
MIN_COUNT = 2
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: The score is the posterior with the evidence of at most this many average words.
EVIDENCE_WORDS = 20
#: Characters scored at a time.
PIECE_CHARS = 1_000_000

#: Rows whose texts are held as Python strings at a time.
SLICE_ROWS = 256

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode categories L*), as ``\\p{L}+`` gives: numbers like a half or a Roman eight are no letters."""
    words = _WORD.findall(text)
    if words and not "".join(words).isalpha():
        words = [run for w in words for run in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return words


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, learnable: Column, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of at most ``per_language`` learnable documents of each language, in the order
    of the id's hash. Ids are first cut at the hash below which about twice as many lie as are wanted, so that few are
    ranked whatever the size of a language; the chosen ids, a bounded number, are joined to the texts."""
    ids = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)  # 63 bits
    cuts = ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count(F.lit(1)) * F.lit(2.0 ** 63)).alias("_cut"))
    near = ids.join(cuts, "lang").filter(place <= F.col("_cut"))
    first = Window.partitionBy("lang").orderBy(place, F.col("doc_id"))
    chosen = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language).select("doc_id", "lang")
    return docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")


def fit(texts: DataFrame, min_count: int = MIN_COUNT, orders: tuple[int, ...] = ORDERS) -> dict:
    """The model from (lang, text): per known word and n-gram a row of log frequencies, one for each
    language. Counted by Spark; what reaches the driver is bounded by the sample."""
    words = (texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))).cache()
    grams = None
    padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    for k in orders:
        at = F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1)))
        part = words.select("lang", "n", padded.alias("_p"), F.explode(at).alias("_i")).select("lang", "n", F.expr(f"substring(_p, _i, {k})").alias("item"))
        part = part.filter(F.length("item") == k).groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("k", F.lit(k))
        grams = part if grams is None else grams.unionByName(part)
    rows = words.select("lang", F.col("word").alias("item"), "n", F.lit(0).alias("k")).unionByName(grams)
    total = Window.partitionBy("k", "item")
    table = rows.withColumn("_all", F.sum("n").over(total)).filter(F.col("_all") >= min_count).drop("_all").toPandas()
    words.unpersist()
    langs = sorted(table["lang"].unique())
    column = {x: i for i, x in enumerate(langs)}
    model: dict = {"langs": langs, "items": {}, "logs": {}}
    for k, part in table.groupby("k"):
        names = sorted(part["item"].unique())
        row = {x: i + 1 for i, x in enumerate(names)}  # row 0: unseen
        counts = np.zeros((len(names) + 1, len(langs)))
        counts[part["item"].map(row).to_numpy(), part["lang"].map(column).to_numpy()] = part["n"].to_numpy()
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(names))
        logs[0] = 0
        model["items"][int(k)], model["logs"][int(k)] = row, logs.astype(np.float32)
    return model


def _unseen(words: list[str], model: dict, out: np.ndarray) -> None:
    """Rows of ``out`` for words that are not known: mean over the known n-grams of the longest order that has any."""
    left = list(range(len(words)))
    for k in sorted((k for k in model["items"] if k), reverse=True):
        get, logs = model["items"][k].get, model["logs"][k]
        flat, starts, hit, miss = [], [], [], []
        for i in left:
            w = f"_{words[i]}_"
            got = [g for j in range(len(w) - k + 1) if (g := get(w[j:j + k]))]
            if got:
                starts.append(len(flat))
                flat += got
                hit.append(i)
            else:
                miss.append(i)
        if hit:
            n = np.diff([*starts, len(flat)])
            out[hit] = np.add.reduceat(logs[flat], starts, axis=0) / n[:, None]
        left = miss


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Predicted language and score of each text."""
    langs = model["langs"]
    known, logs = (model["items"].get(0, {}), model["logs"].get(0)) if langs else ({}, None)
    preds, scores = [], []
    for text in texts:
        total, n = np.zeros(len(langs)), 0
        for at in _pieces(text or ""):
            words = words_of(at.lower())
            if not words or not langs:
                continue
            n += len(words)
            ids = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
            total += logs[ids].sum(0, dtype=float)
            new: dict[str, int] = {}
            for i in np.flatnonzero(ids == 0):
                new[words[i]] = new.get(words[i], 0) + 1
            if new:
                rows = np.zeros((len(new), len(langs)))
                _unseen(list(new), model, rows)
                total += np.fromiter(new.values(), float, len(new)) @ rows
        if not n:
            preds.append(UND)
            scores.append(0.0)
            continue
        best = int(total.argmax())
        e = np.exp((total - total[best]) * min(1.0, EVIDENCE_WORDS / n))
        preds.append(langs[best])
        scores.append(float(e[best] / e.sum()))
    return preds, scores


def _pieces(text: str):
    """The text in pieces that end where no letter continues."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        end = start + PIECE_CHARS
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_lang_score`` from ``text``; the model is broadcast, its size is bounded by the sample."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            preds, scores = [], []
            for i in range(0, b.num_rows, SLICE_ROWS):
                p, s = score_texts(b.column(at).slice(i, SLICE_ROWS).to_pylist(), shared.value)
                preds += p
                scores += s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "_lang_pred", "_lang_score"])
        release_memory()

    schema = StructType([*docs.schema.fields, StructField("_lang_pred", StringType()), StructField("_lang_score", DoubleType())])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that are not held out (crc32 mod 4 is not 2)."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(sample(docs, ~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
