"""The training-corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing, token output.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadgrid.llm import chosen_path, decontam, langid, mixing, token_store
from loadgrid.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if it has no language, or if its language is this uncertain.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of its input and keeps the documents that have a language."""
    docs = docs.select(COLUMNS)
    model = langid.fit(langid.sample(docs, ~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(docs, model).filter((F.col("_lang_pred") != langid.UND) & (F.col("_lang_score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (least doc_id) of each class of linked documents."""
    classes = chosen_path.join(docs)
    # Documents without links stand alone; of a class the least id stays, of repeated rows one.
    first = Window.partitionBy(F.coalesce("class_id", "_text")).orderBy(F.col("doc_id").asc_nulls_last(), "_text")
    kept = (classes.filter("n_links = 0").select("doc_id", "_text")
            .unionByName(classes.filter("n_links > 0").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "_text")))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    kept = written(kept.select(key.alias("_key"), "_text").distinct(), "kept")
    # One shuffle of the texts: rows equal in id and text count once.
    rows = docs.select(*COLUMNS, key.alias("_key"), F.xxhash64("text").alias("_text")).repartition("_key", "_text")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_text").orderBy(F.lit(1)))).filter("_n = 1")
    return rows.join(kept, ["_key", "_text"], "left_semi").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, also with other numbers or names."""
    return decontam.decontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for."""
    return mixing.mixed(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store of the mix and returns its digest, read back."""
    return token_store.report(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("tokens", tokens)]

#: No SQL expresses the learned language model, the chosen paths or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
