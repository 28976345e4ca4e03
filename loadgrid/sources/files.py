"""Control files (one integer per file, a date in the file name) and file listing.

Spark's file sources skip names that start with ``_`` or ``.`` (for example ``_SUCCESS``). With ``hidden=True`` both
functions use the data source of :mod:`loadgrid.sources.named_files` instead, which reads these too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadgrid.sources.named_files import read_named


def list_files(spark: SparkSession, path: str, name_regex: str | None = None, glob: str | None = None,
               recursive: bool = False, hidden: bool = False) -> DataFrame:
    """Files under ``path`` whose name relative to ``path`` matches ``name_regex`` (search, not
    full match). Uses the ``binaryFile`` source with only path/length/modificationTime selected,
    so file contents are not read; ``glob`` prunes during listing. ``hidden``: names starting with ``_`` or ``.`` too,
    listed in parallel on the executors (``glob`` does not apply)."""
    if hidden:
        return read_named(spark, path, name_regex or "", recursive, bodies=False).select("path", "length", F.col("modified").alias("modificationTime"), "name")
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path).select("path", "length", "modificationTime")
    base = path.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(base.split("://")[-1]), "")
    df = df.withColumn("name", rel)
    return df.where(F.col("name").rlike(name_regex)) if name_regex else df


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def read_control_files(spark: SparkSession, path: str, date_regex: str, name_regex: str | None = None,
                       glob: str | None = None, hidden: bool = False) -> DataFrame:
    """One row per control file: ``file_date`` = group 1 of ``date_regex`` applied to the file
    path, ``number_rows`` = the file body as an integer. Files are read whole, in parallel; ``hidden`` as in :func:`list_files`."""
    if hidden:
        df = read_named(spark, path, name_regex or "").select("path", F.col("body").alias("value"))
        return _totals(df, date_regex)
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    if name_regex:
        df = df.where(F.regexp_extract(F.col("path"), r"[^/]*$", 0).rlike(name_regex))
    return _totals(df, date_regex)


def _totals(df: DataFrame, date_regex: str) -> DataFrame:
    number = F.regexp_replace("value", r"\s+", "").cast("long")
    return df.select(F.regexp_extract("path", date_regex, 1).alias("file_date"), number.alias("number_rows"), "path")
