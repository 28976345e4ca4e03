"""Logical table name -> DataFrame.

The reference runs each statement at its source (PostgreSQL, a warehouse, or a bulk unload to
files). Here every source is a DataFrame reader; the statements run in Spark, so Catalyst pushes
filters and column pruning into each scan (parquet ``PushedFilters``/``ReadSchema``, JDBC
``WHERE``/select list).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Catalog(Mapping):
    """An immutable name -> DataFrame mapping with helpers for each source kind."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        self._t = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        return self._t[name]

    def __iter__(self):
        return iter(self._t)

    def __len__(self):
        return len(self._t)

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return Catalog({**self._t, **tables})

    def register_views(self) -> "Catalog":
        """Expose every table to SQL (``createOrReplaceTempView``)."""
        for name, df in self._t.items():
            df.createOrReplaceTempView(name)
        return self


def parquet_tables(spark: SparkSession, root: str, names: Iterable[str], schemas: Mapping[str, StructType] | None = None) -> Catalog:
    """``{root}/{name}.parquet`` (file or folder) for each name; fixed schemas where given."""
    out = {}
    for n in names:
        r = spark.read
        if schemas and n in schemas:
            r = r.schema(schemas[n])
        out[n] = r.parquet(os.path.join(root, f"{n}.parquet"))
    return Catalog(out)


def jdbc_table(spark: SparkSession, url: str, table_or_query: str, properties: Mapping[str, str] | None = None,
               partition_column: str | None = None, lower: int | str | None = None, upper: int | str | None = None,
               num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A database table (or a ``(select ...) q`` text) through the JDBC source.

    With ``partition_column`` the read is split into ``num_partitions`` parallel range queries —
    the way to read a large reading table without funnelling it through one connection.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
              .option("upperBound", str(upper)).option("numPartitions", int(num_partitions or 1)))
    return r.load()


def unloaded_files(spark: SparkSession, path: str, schema: StructType, column_names: list[str] | None = None,
                   fmt: str = "parquet", **options: str) -> DataFrame:
    """Files written by a bulk unload, read with an explicit schema; columns are named by
    *position* from ``column_names`` because the files carry none."""
    df = spark.read.format(fmt).schema(schema).options(**options).load(path)
    return df.toDF(*column_names) if column_names else df
