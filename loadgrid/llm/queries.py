"""The operators' queries over the driver's tables, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadgrid.llm import chosen_path, ctw, cws, decontam, hard_negatives, langid, licenses, merkle, mixing, pii, revisits, token_store, wrapper


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_warc_revisits(spark, sf_dir):
    return revisits.report(_t(spark, sf_dir, "pages"))


def op2_wrapper_induction(spark, sf_dir):
    return wrapper.report(_t(spark, sf_dir, "pages"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.report(_t(spark, sf_dir, "documents"))


def op5_context_tree_weighting(spark, sf_dir):
    return ctw.report(_t(spark, sf_dir, "documents"))


def op6_weighted_sampling(spark, sf_dir):
    return cws.report(_t(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")).drop("_text")


def op8_mixing(spark, sf_dir):
    return mixing.mix_report(_t(spark, sf_dir, "documents"))


def op9_chosen_path_join(spark, sf_dir):
    return chosen_path.report(_t(spark, sf_dir, "documents"))


def op10_token_store(spark, sf_dir):
    return token_store.report(_t(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.report(_t(spark, sf_dir, "documents"))


def op12_personal_data(spark, sf_dir):
    return pii.report(_t(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.report(_t(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_warc_revisits, op2_wrapper_induction, op3_license_scan, op4_language_id, op5_context_tree_weighting, op6_weighted_sampling, op7_decontamination,
    op8_mixing, op9_chosen_path_join, op10_token_store, op11_merkle_manifest, op12_personal_data, op13_hard_negatives)}

ORACLE = {"op1_warc_revisits": revisits.ORACLE_SQL, "op3_license_scan": licenses.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL,
          "op11_merkle_manifest": merkle.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
