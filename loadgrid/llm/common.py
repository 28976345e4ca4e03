"""Helpers shared by the operators: scratch tables in the shared folder, size-checked broadcasts,
a global order without a single-task sort, and text normalisation expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadgrid.session import checkpoint_dir

#: ASCII white space, the only separator of words in this subpackage.
WS = r"[\x20\x09-\x0D]+"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context, so that tasks import it
    wherever the driver found it. Spark distributes the archive itself."""
    sc = spark.sparkContext
    if getattr(sc, "_loadgrid_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="loadgrid-code-"), "loadgrid.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("loadgrid", os.path.relpath(path, top)))
    sc.addPyFile(archive)
    sc._loadgrid_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation and several consumers read the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: Python workers are reused by later tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` to the shared folder; for small tables that iterations reuse."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (the join
    then shuffles). Counts at most ``max_rows + 1`` rows; meant for written or checkpointed tables."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ordered_parts(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned by ``order`` with its partition number ``_part``; parts ascend in
    that order. Checkpointed, since range bounds are sampled anew by every execution."""
    out = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return checkpointed(out)


def global_row_number(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order without sorting all rows in one task: numbers inside
    range partitions plus one offset per partition (as many rows as there are partitions)."""
    parts = ordered_parts(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (parts.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + inside).drop("_part", "_before"))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; 0 for null and for blank text."""
    pieces = F.size(F.split(text, WS))
    edges = text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - edges).cast("long")


def hash_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) drawn from ``md5(seed|key)``: the first 52 bits over 2**52."""
    digest = F.md5(F.concat(F.lit(seed + "|"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
