"""Audit gate and control totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: step and status names, and the error codes.
TARGET_WRITE_STEP = "target-write"
ERROR_STATUS = "error"
CODE_NO_ROWS = "ED125"          # no audit rows for the run
CODE_STEP_MISMATCH = "ED124"    # number of target-write rows differs from the expected steps
CODE_STEP_ERROR = "ED126"       # a step reported an error
CODE_PASS = "PASS"              # our label for a clean run

AUDIT_COLUMNS = ("audit_id", "etl_process_detail_id", "etl_process_run_date", "etl_process_start_dt",
                 "etl_process_end_dt", "etl_process_status", "etl_process_rows", "etl_process_id",
                 "target_name", "step")


def audit_gate(runs: DataFrame, audit: DataFrame, keys: Sequence[str] = ("audit_id", "etl_process_detail_id"),
               expected_steps: int | str = 1, step: str = "step", status: str = "etl_process_status") -> DataFrame:
    """One verdict per expected run: ED125 without rows; else ED124 when the number of
    ``target-write`` rows differs from the expected steps (a column name or a constant); else ED126
    when any row has status ``error``; else PASS. ED124 is tested before ED126.
    Audit rows are aggregated per run before the join (partial aggregation)."""
    keys = list(keys)
    a = audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_if(F.col(step) == TARGET_WRITE_STEP).alias("target_writes"),
                                 F.count_if(F.col(status) == ERROR_STATUS).alias("errors"))
    exp = F.col(expected_steps) if isinstance(expected_steps, str) else F.lit(int(expected_steps))
    out = runs.join(a, on=keys, how="left")
    code = (F.when(F.col("n_rows").isNull(), CODE_NO_ROWS)
             .when(F.col("target_writes") != exp, CODE_STEP_MISMATCH)
             .when(F.col("errors") > 0, CODE_STEP_ERROR)
             .otherwise(CODE_PASS))
    return out.select(*runs.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      F.coalesce("target_writes", F.lit(0)).alias("target_writes"),
                      F.coalesce("errors", F.lit(0)).alias("errors"), code.alias("status_code"))


def control_totals(declared: DataFrame, loaded: DataFrame, date_col: str, declared_date: str = "file_date",
                   declared_rows: str = "number_rows") -> DataFrame:
    """Declared row counts (from control files) against loaded rows per date: full outer join of
    the declared totals with ``count(*)`` per date; ``matches`` is true only when both exist and agree."""
    got = loaded.groupBy(F.col(date_col).alias("__d")).agg(F.count(F.lit(1)).alias("loaded_rows"))
    dec = declared.groupBy(F.col(declared_date).alias("__d")).agg(F.sum(declared_rows).alias("declared_rows"))
    j = dec.join(got, on="__d", how="full")
    return j.select(F.col("__d").alias("file_date"), "declared_rows", "loaded_rows",
                    F.coalesce(F.col("declared_rows") == F.col("loaded_rows"), F.lit(False)).alias("matches"))
