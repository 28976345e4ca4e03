"""Run modes: the ordered list of datasets per mode and a runner.

Each dataset is registered as a temp view under its reference name. With ``materialize=True`` a
dataset is written as parquet under the session's checkpoint folder (``spark.checkpoint.dir``) and
read back, which cuts lineage: a lost executor later in the run recomputes from those files, not from
the sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from loadgrid.params import RunParams
from loadgrid.plans import datasets
from loadgrid.session import checkpoint_dir

# Fixed values that must equal the reference's: process order per run mode.
RUN_ORDER = {
    "daily": ["ami_day", "study", "study_premise", "variable", "pb_accounts", "meters", "uevmada", "uevcust",
              "mada", "meters_pb", "power_billing", "mass_market_nm", "mass_market_not_nm"],
    "backdate": ["study", "study_premise", "variable", "meters", "pb_accounts", "uevmada", "uevcust", "mada",
                 "meters_pb", "mass_market_nm", "mass_market_not_nm", "power_billing"],
    "reprocess": ["study", "study_premise", "variable", "meters", "pb_accounts", "uevmada", "uevcust", "mada",
                  "meters_pb", "mass_market_nm", "mass_market_not_nm", "power_billing"],
}


def plan(tables: Mapping[str, DataFrame], p: RunParams) -> dict[str, DataFrame]:
    """All datasets of ``p.mode`` as lazy DataFrames, in process order."""
    return {name: datasets.DATASETS[name](tables, p) for name in RUN_ORDER[p.mode]}


def run(spark: SparkSession, tables: Mapping[str, DataFrame], p: RunParams, materialize: bool = False,
        run_id: str | None = None) -> dict[str, DataFrame]:
    """Build every dataset of the mode in order and register each as a temp view."""
    out: dict[str, DataFrame] = {}
    base = None
    if materialize:
        base = f"{checkpoint_dir(spark).rstrip('/')}/runs/{p.mode}/{run_id or uuid.uuid4().hex}"
    for name, df in plan(tables, p).items():
        if base:
            path = f"{base}/{name}"
            df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
