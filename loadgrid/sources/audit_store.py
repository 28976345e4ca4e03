"""Audit rows: typed read of one run and append with a fixed 10-column schema.

:func:`append_audit` adds rows as they are; :func:`publish_audit` adds them under an id of the append, so that a retry
replaces the rows of the attempt before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgrid.operators.audit import AUDIT_COLUMNS
from loadgrid.session import checkpoint_dir

AUDIT_SCHEMA = T.StructType([
    T.StructField("audit_id", T.StringType()),
    T.StructField("etl_process_detail_id", T.StringType()),
    T.StructField("etl_process_run_date", T.DateType()),
    T.StructField("etl_process_start_dt", T.TimestampNTZType()),
    T.StructField("etl_process_end_dt", T.TimestampNTZType()),
    T.StructField("etl_process_status", T.StringType()),
    T.StructField("etl_process_rows", T.LongType()),
    T.StructField("etl_process_id", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("step", T.StringType()),
])
assert tuple(f.name for f in AUDIT_SCHEMA.fields) == AUDIT_COLUMNS


def read_audit(audit: DataFrame, audit_id: str, detail_id: str) -> DataFrame:
    """Audit rows of one run, filtered with typed predicates (pushed to the scan)."""
    return audit.where((F.col("audit_id") == audit_id) & (F.col("etl_process_detail_id") == detail_id)).select(
        "etl_process_status", "target_name", "step", "etl_process_rows", "etl_process_id",
        "etl_process_run_date", "audit_id", "etl_process_detail_id")


def append_audit(spark: SparkSession, rows: list[tuple] | DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Append audit rows (10 columns, by position) to the audit table at ``path``."""
    df = _typed(spark, rows)
    df.write.mode("append").format(fmt).save(path)
    return df


def _typed(spark: SparkSession, rows: list[tuple] | DataFrame) -> DataFrame:
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, AUDIT_SCHEMA)
    return df.select([F.col(c).cast(f.dataType) for c, f in zip(df.columns, AUDIT_SCHEMA.fields, strict=True)]).toDF(*AUDIT_COLUMNS)


#: Partition column of a published audit table: one folder for each append.
APPEND_ID = "append_id"


def publish_audit(spark: SparkSession, rows: list[tuple] | DataFrame, path: str, append_id: str) -> DataFrame:
    """Append audit rows (10 columns, by position) to the Parquet table at ``path`` once, however often it is tried.

    ``append_id`` names the append (say run id and step). Each attempt first writes its rows to a folder of its own in the
    session's checkpoint folder, so that what is published was computed once and in full; then the partition of ``append_id`` is
    replaced by dynamic partition overwrite. An attempt that dies leaves the table as it was; a retry, or the same append by two
    runners, leaves one copy. Other appends are not touched. Returns the published rows.
    """
    if not append_id:
        raise ValueError("publish_audit: append_id must name the append")
    staged = f"{checkpoint_dir(spark).rstrip('/')}/audit/{uuid.uuid4().hex}"
    _typed(spark, rows).write.parquet(staged)
    df = spark.read.schema(AUDIT_SCHEMA).parquet(staged)
    out = df.withColumn(APPEND_ID, F.lit(append_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(APPEND_ID).parquet(path)
    return df


def published_audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published audit table, without the append's id."""
    return spark.read.schema(T.StructType([*AUDIT_SCHEMA.fields, T.StructField(APPEND_ID, T.StringType())])).parquet(path).drop(APPEND_ID)
