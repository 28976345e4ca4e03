"""Run specifications: a JSON text that says which datasets a run builds, in which order, with which parameters and under which names.

    {"mode": "daily", "parameters": {"run_date": "2025-11-02", ...},
     "datasets": [{"dataset": "study", "process_order": 2, "target": "study", "parameters": {...}}, ...]}

Names and types are checked against the builders and :class:`loadgrid.params.RunParams`; nothing in a specification is evaluated as code or
SQL. Key sets (scopes) are DataFrames and come from the caller.

A run writes each dataset and then an entry of its manifest below ``{checkpoint folder}/runs/{mode}/{run_id}``. A run that is started again with its ``run_id`` reads
the datasets that have an entry for the same parameters and builds the others.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from loadgrid.params import MODES, RunParams, Scopes
from loadgrid.plans import datasets, runs
from loadgrid.session import checkpoint_dir

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Parameters that a specification can't hold: mode has a field of its own, scopes are DataFrames.
_ELSEWHERE = {"mode", "scopes"}
_KINDS = {f.name: str(f.type) for f in fields(RunParams) if f.name not in _ELSEWHERE}
MANIFEST = "target string, dataset string, process_order int, fingerprint string, rows long, path string"


@dataclass(frozen=True)
class Step:
    dataset: str
    process_order: int
    target: str
    parameters: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class RunSpec:
    mode: str
    steps: tuple[Step, ...]
    parameters: tuple[tuple[str, object], ...] = field(default=())

    def params(self, step: Step, scopes: Scopes | None = None) -> RunParams:
        more = {"scopes": scopes} if scopes is not None else {}
        return RunParams(mode=self.mode, **{**dict(self.parameters), **dict(step.parameters)}, **more)

    def fingerprint(self, step: Step) -> str:
        """Equal for equal mode, dataset, target and parameters."""
        p = self.params(step)
        held = {n: repr(getattr(p, n)) for n in _KINDS}
        return hashlib.sha256(json.dumps([self.mode, step.dataset, step.target, held], sort_keys=True).encode()).hexdigest()


def _value(name: str, v: object, where: str) -> object:
    """The typed value of a parameter."""
    if name not in _KINDS:
        raise ValueError(f"{where}: unknown parameter {name!r}")
    kind = _KINDS[name]

    def fail():
        return ValueError(f"{where}: parameter {name!r} must be {kind}, not {v!r}")

    if v is None:
        if "None" not in kind:
            raise fail()
        return None
    if kind.startswith("tuple"):
        if not isinstance(v, list) or not all(isinstance(x, (int, str)) and not isinstance(x, bool) for x in v):
            raise fail()
        return tuple(v)
    if kind.startswith("bool"):
        if not isinstance(v, bool):
            raise fail()
        return v
    if kind.startswith("int"):
        if not isinstance(v, int) or isinstance(v, bool):
            raise fail()
        return v
    if not isinstance(v, str):
        raise fail()
    try:
        if kind.startswith("dt.datetime"):
            return dt.datetime.fromisoformat(v)
        if kind.startswith("dt.date"):
            return dt.datetime.strptime(v, "%Y%m%d").date() if re.fullmatch(r"\d{8}", v) else dt.date.fromisoformat(v)
    except ValueError:
        raise fail() from None
    return v


def _values(given: object, where: str) -> tuple[tuple[str, object], ...]:
    if not isinstance(given, dict):
        raise ValueError(f"{where}: parameters must be an object")
    return tuple(sorted((n, _value(n, v, where)) for n, v in given.items()))


def parse_spec(text: str) -> RunSpec:
    """The checked specification of a JSON text; a ValueError names what is wrong and where."""
    try:
        d = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"specification: not JSON ({e})") from None
    if not isinstance(d, dict) or (more := set(d) - {"mode", "parameters", "datasets"}):
        raise ValueError("specification: must be an object of mode, parameters, datasets" + (f", not {sorted(more)}" if isinstance(d, dict) else ""))
    if d.get("mode") not in MODES:
        raise ValueError(f"specification: unknown mode {d.get('mode')!r}")
    if not isinstance(d.get("datasets"), list) or not d["datasets"]:
        raise ValueError("specification: datasets must be a list with entries")
    steps = []
    for i, x in enumerate(d["datasets"]):
        where = f"datasets[{i}]"
        if not isinstance(x, dict) or (more := set(x) - {"dataset", "process_order", "target", "parameters"}):
            raise ValueError(f"{where}: must be an object of dataset, process_order, target, parameters" + (f", not {sorted(more)}" if isinstance(x, dict) else ""))
        if x.get("dataset") not in datasets.DATASETS:
            raise ValueError(f"{where}: unknown dataset {x.get('dataset')!r}")
        order = x.get("process_order")
        if not isinstance(order, int) or isinstance(order, bool):
            raise ValueError(f"{where}: process_order must be an integer")
        target = x.get("target", x["dataset"])
        if not isinstance(target, str) or not _NAME.fullmatch(target):
            raise ValueError(f"{where}: target must be a plain name, not {target!r}")
        steps.append(Step(x["dataset"], order, target, _values(x.get("parameters", {}), where)))
    for what, seen in (("target", [s.target.lower() for s in steps]), ("process_order", [s.process_order for s in steps])):
        if twice := sorted({x for x in seen if seen.count(x) > 1}):
            raise ValueError(f"specification: {what} used more than once: {twice}")
    return RunSpec(d["mode"], tuple(sorted(steps, key=lambda s: s.process_order)), _values(d.get("parameters", {}), "specification"))


def load_spec(spark: SparkSession, path: str) -> RunSpec:
    """The specification in the file at ``path`` (any path that Spark reads)."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"load_spec: {path} must be one file, found {len(found)}")
    return parse_spec(found[0]["value"])


def spec_text(mode: str, parameters: Mapping[str, object], only: list[str] | None = None) -> str:
    """The specification of a mode in its usual order (all datasets, or ``only`` some), to be edited or run."""
    steps = [{"dataset": n, "process_order": i, "target": n, "parameters": {}} for i, n in enumerate(runs.RUN_ORDER[mode], 1) if only is None or n in only]
    plain = {n: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else list(v) if isinstance(v, tuple) else v for n, v in parameters.items()}
    return json.dumps({"mode": mode, "parameters": plain, "datasets": steps}, indent=1)


def _manifest(spark: SparkSession, base: str) -> dict[str, dict]:
    """Entries by target: as many as the specification has datasets."""
    try:
        return {r["target"]: r.asDict() for r in spark.read.schema(MANIFEST).json(f"{base}/manifest/*").collect()}
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise


def run_spec(spark: SparkSession, tables: Mapping[str, DataFrame], spec: RunSpec, run_id: str, scopes: Scopes | None = None) -> dict[str, DataFrame]:
    """Build, write and register the datasets of ``spec`` in their order; those that this run has finished before are only read.

    An entry is written after its data, so a dataset without one is built anew and replaces what a broken attempt left. If the parameters
    of a dataset have changed since, it is built anew too. Runs that differ in scopes or tables need different run ids.
    """
    if not _NAME.fullmatch(re.sub(r"[-.]", "_", f"_{run_id}")):
        raise ValueError(f"run_spec: run_id must be a plain name, not {run_id!r}")
    base = f"{checkpoint_dir(spark).rstrip('/')}/runs/{spec.mode}/{run_id}"
    done, out = _manifest(spark, base), {}
    for s in spec.steps:
        path, mark = f"{base}/data/{s.target}", spec.fingerprint(s)
        if done.get(s.target, {}).get("fingerprint") != mark:
            datasets.DATASETS[s.dataset](tables, spec.params(s, scopes)).write.mode("overwrite").parquet(path)
            n = spark.read.parquet(path).count()
            entry = spark.createDataFrame([(s.target, s.dataset, s.process_order, mark, n, path)], MANIFEST)
            entry.coalesce(1).write.mode("overwrite").json(f"{base}/manifest/{s.target}")
        out[s.target] = spark.read.parquet(path)
        out[s.target].createOrReplaceTempView(s.target)
    return out


def run_manifest(spark: SparkSession, mode: str, run_id: str) -> DataFrame:
    """target, dataset, process_order, fingerprint, rows, path of the datasets that a run has finished."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/runs/{mode}/{run_id}"
    return spark.createDataFrame([tuple(r.values()) for r in _manifest(spark, base).values()], MANIFEST)
