"""Hidden control files, publishing audit rows once, runs from specifications."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import tables
from loadgrid.operators import audit
from loadgrid.params import RunParams
from loadgrid.plans import datasets, runs, spec
from loadgrid.sources import audit_store
from loadgrid.sources.files import list_files, read_control_files
from loadgrid.sources.named_files import read_named, write_named

D, T = dt.date, dt.datetime


# ---------------------------------------------------------------- files

@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="loadgrid-files-", dir="/tmp")


def test_hidden_control_files(spark, folder):
    for name, body in {"_SUCCESS_20240101": "3\n", "_SUCCESS_20240102": " 1 ", ".SUCCESS_20240103": "7", "_SUCCESS_bad": "x", "other_20240104": "9"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)
    os.makedirs(f"{folder}/deep/_er")
    with open(f"{folder}/deep/_er/_SUCCESS_20240105", "w") as f:
        f.write("5")
    got = read_control_files(spark, folder, r"SUCCESS_(\d{8})$", name_regex=r"SUCCESS_\d{8}$", hidden=True)
    assert rows(got, "file_date", "number_rows") == [("20240101", 3), ("20240102", 1), ("20240103", 7)]
    assert rows(got, "file_date") == rows(read_control_files(spark, f"file://{folder}", r"SUCCESS_(\d{8})$", name_regex=r"SUCCESS_\d{8}$", hidden=True), "file_date")
    assert rows(list_files(spark, folder, r"^_SUCCESS_\d", hidden=True), "name", "length") == [("_SUCCESS_20240101", 2), ("_SUCCESS_20240102", 3)]
    assert [r[0] for r in rows(list_files(spark, folder, r"_SUCCESS_\d", recursive=True, hidden=True), "name")][-1] == "deep/_er/_SUCCESS_20240105"
    loaded = spark.createDataFrame([("20240101",)] * 3 + [("20240102",)] * 2, "d string")
    assert rows(audit.control_totals(got, loaded, "d"), "file_date", "matches") == [("20240101", True), ("20240102", False), ("20240103", False)]
    assert read_named(spark, folder, "nothing like this").count() == 0


def test_a_hundred_thousand_names(spark, folder):
    n = 100_000
    for i in range(n):
        os.close(os.open(f"{folder}/_{i}", os.O_CREAT | os.O_WRONLY))
    got = read_named(spark, folder, r"^_\d+$", bodies=False, shards=16)
    assert got.rdd.getNumPartitions() == 16
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n == got.select("name").distinct().count() and max(sizes) < 1.2 * n / 16


def test_files_are_written_once(spark, folder):
    files = spark.createDataFrame([("_SUCCESS_20240101", "3"), (".x", None), ("naïve", "é")], "name string, body string")
    write_named(files.repartition(3), folder)
    write_named(files, folder)
    assert sorted(os.listdir(folder)) == sorted([".x", "_SUCCESS_20240101", "naïve"])
    assert rows(read_named(spark, folder), "name", "body") == [(".x", ""), ("_SUCCESS_20240101", "3"), ("naïve", "é")]
    with pytest.raises(Exception, match="not a file name"):
        write_named(spark.createDataFrame([("../x", "1")], "name string, body string"), folder)


# ---------------------------------------------------------------- audit rows

def _audit_rows(step, n, status="success"):
    return [("A1", "D1", D(2025, 11, 2), T(2025, 11, 2, 1), T(2025, 11, 2, 2), status, 10 + i, f"p{i}", "target", step) for i in range(n)]


def test_a_retried_append_leaves_one_copy(spark, folder):
    path = f"{folder}/audit"
    audit_store.publish_audit(spark, _audit_rows("read", 2), path, "run/1:read")
    audit_store.publish_audit(spark, _audit_rows("target-write", 5), path, "run/1:write")       # an attempt that wrote other rows
    for _ in range(2):
        audit_store.publish_audit(spark, _audit_rows("target-write", 1), path, "run/1:write")
    got = audit_store.published_audit(spark, path)
    assert got.columns == list(audit.AUDIT_COLUMNS) and rows(got.groupBy("step").count()) == [("read", 2), ("target-write", 1)]
    assert audit_store.read_audit(got, "A1", "D1").count() == 3
    run = spark.createDataFrame([("A1", "D1"), ("A2", "D1")], "audit_id string, etl_process_detail_id string")
    assert rows(audit.audit_gate(run, got), "audit_id", "status_code") == [("A1", "PASS"), ("A2", "ED125")]
    audit_store.publish_audit(spark, _audit_rows("check", 1, "error"), path, "run/1:check")
    assert rows(audit.audit_gate(run, audit_store.published_audit(spark, path)), "audit_id", "status_code")[0] == ("A1", "ED126")
    with pytest.raises(ValueError, match="append_id"):
        audit_store.publish_audit(spark, _audit_rows("x", 1), path, "")


def test_a_failed_attempt_changes_nothing(spark, folder):
    path = f"{folder}/audit"
    audit_store.publish_audit(spark, _audit_rows("read", 2), path, "r")
    bad = spark.createDataFrame(_audit_rows("read", 3), audit_store.AUDIT_SCHEMA).withColumn("etl_process_rows", F.raise_error(F.lit("source is gone")).cast("long"))
    with pytest.raises(Exception, match="source is gone"):
        audit_store.publish_audit(spark, bad, path, "r")
    assert audit_store.published_audit(spark, path).count() == 2


# ---------------------------------------------------------------- specifications

PARAMS = {
    "daily": dict(run_date=D(2025, 11, 2), start_date=D(2025, 11, 9), month_from=202509, month_to=202511, as_of=D(2025, 11, 10), company="FPL",
                  exclude_premises=(373190907,), fetch_from=T(2022, 9, 30), fetch_to=T(2025, 11, 4)),
    "backdate": dict(month=202510, as_of=D(2025, 11, 20), company="FPL", fetch_from=T(2022, 9, 30), fetch_to=T(2025, 11, 4), bill_start=D(2025, 10, 1), bill_end=D(2025, 11, 30),
                     bill_from_date=D(2025, 8, 1), bill_to_date=D(2025, 12, 1), min_bill_date=D(2024, 1, 1)),
}
PARAMS["reprocess"] = PARAMS["backdate"]


@pytest.mark.parametrize("mode", ["daily", "backdate", "reprocess"])
def test_modes_run_from_specifications(spark, folder, mode):
    path = f"{folder}/{mode}.json"
    with open(path, "w") as f:
        f.write(spec.spec_text(mode, PARAMS[mode]))
    s = spec.load_spec(spark, path)
    assert [x.dataset for x in s.steps] == runs.RUN_ORDER[mode]
    assert s.params(s.steps[0]) == RunParams(mode=mode, **PARAMS[mode])
    t = tables(spark)
    want = runs.plan(t, RunParams(mode=mode, **PARAMS[mode]))
    out = spec.run_spec(spark, t, s, f"all-{mode}-{os.path.basename(folder)}")
    assert list(out) == runs.RUN_ORDER[mode]
    for name, df in out.items():
        assert rows(df) == rows(want[name]), name
    assert spark.table("meters").count() == out["meters"].count()


def test_a_broken_run_goes_on_where_it_stopped(spark, folder, monkeypatch):
    t, run_id = tables(spark), f"broken-{os.path.basename(folder)}"
    s = spec.parse_spec(spec.spec_text("daily", PARAMS["daily"]))
    built = []

    def counted(name, fn):
        def build(tables, p):
            if name == s.steps[5].dataset and len(built) == 5:
                built.append("broke")
                raise RuntimeError("executor gone")
            built.append(name)
            return fn(tables, p)
        return build

    monkeypatch.setattr(datasets, "DATASETS", {n: counted(n, f) for n, f in datasets.DATASETS.items()})
    with pytest.raises(RuntimeError):
        spec.run_spec(spark, t, s, run_id)
    assert built == [x.dataset for x in s.steps[:5]] + ["broke"]
    # What a broken attempt left without an entry doesn't count.
    base = f"{spec.checkpoint_dir(spark).rstrip('/')}/runs/daily/{run_id}"
    spark.range(3).write.parquet(f"{base}/data/{s.steps[5].target}")
    built.clear()
    out = spec.run_spec(spark, t, s, run_id)
    assert built == [x.dataset for x in s.steps[5:]]
    for name, df in runs.plan(t, RunParams(mode="daily", **PARAMS["daily"])).items():
        assert rows(out[name]) == rows(df), name
    built.clear()
    spec.run_spec(spark, t, s, run_id)
    assert built == []
    m = rows(spec.run_manifest(spark, "daily", run_id), "process_order", "target", "rows")
    assert [x[1] for x in m] == [x.target for x in s.steps] and all(n == out[x].count() for _, x, n in m)
    # Another parameter of one dataset: that one is built anew.
    d = json.loads(spec.spec_text("daily", PARAMS["daily"]))
    next(x for x in d["datasets"] if x["dataset"] == "meters")["parameters"] = {"exclude_premises": []}
    built.clear()
    spec.run_spec(spark, t, spec.parse_spec(json.dumps(d)), run_id)
    assert built == ["meters"]


@pytest.mark.parametrize("change, says", [
    (lambda d: d.update(mode="weekly"), "unknown mode"), (lambda d: d.update(sql="select 1"), "not \\['sql'\\]"), (lambda d: d.update(datasets=[]), "entries"),
    (lambda d: d["datasets"][0].update(dataset="nothing"), "datasets\\[0\\]: unknown dataset"), (lambda d: d["datasets"][0].update(target="x; drop"), "plain name"),
    (lambda d: d["datasets"][0].update(process_order="1"), "integer"), (lambda d: d["datasets"][1].update(process_order=1), "process_order used more than once"),
    (lambda d: d["datasets"][1].update(target=d["datasets"][0]["target"].upper()), "target used more than once"), (lambda d: d["parameters"].update(run_date="str(now())"), "'run_date'"),
    (lambda d: d["parameters"].update(month=True), "'month'"), (lambda d: d["parameters"].update(color=1), "unknown parameter 'color'"), (lambda d: d["parameters"].update(scopes={}), "unknown parameter"),
    (lambda d: d["parameters"].update(exclude_premises="1"), "'exclude_premises'"), (lambda d: d["parameters"].update(zone=None), "'zone'"), (lambda d: d["datasets"][0].update(parameters=[]), "object"),
    (lambda d: d["parameters"].update(legacy_wall_time="no"), "'legacy_wall_time'"), (lambda d: d["datasets"][0].update(code="x"), "not \\['code'\\]")])
def test_specifications_are_checked(change, says):
    d = json.loads(spec.spec_text("daily", PARAMS["daily"]))
    change(d)
    with pytest.raises(ValueError, match=says):
        spec.parse_spec(json.dumps(d))


def test_specification_texts():
    with pytest.raises(ValueError, match="not JSON"):
        spec.parse_spec("{")
    with pytest.raises(ValueError, match="object"):
        spec.parse_spec("[]")
    s = spec.parse_spec('{"mode": "daily", "parameters": {"run_date": "20251102"}, "datasets": [{"dataset": "variable", "process_order": 2}, {"dataset": "study", "process_order": 1, "target": "mine"}]}')
    assert [(x.dataset, x.target) for x in s.steps] == [("study", "mine"), ("variable", "variable")] and s.params(s.steps[0]).run_date == D(2025, 11, 2)
