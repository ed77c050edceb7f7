"""Ids from content, buffered run logs and medians of samples of any size."""

from __future__ import annotations

from pathlib import Path
from statistics import median

import numpy as np
import pytest

from wavetable.operators import stats
from wavetable.operators.splits import assign_splits
from wavetable.sources import runs, tables


def ids_of(df):
    return sorted((tuple(r) for r in tables.content_id(df).collect()), key=lambda r: r[-1])


def test_ids_do_not_follow_the_layout(spark, monkeypatch):
    rows = [(i % 7, None if i % 5 else f"v{i % 3}") for i in range(400)] + [(100 + i, "one") for i in range(20)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "`a.b` int, c string")
    once = ids_of(df.repartition(2))
    assert once == ids_of(df.repartition(9)) and len({r[-1] for r in once}) == len(rows)
    monkeypatch.setattr(tables, "SLICE_ROWS", 4)
    assert once == ids_of(df.repartition(5))
    monkeypatch.setattr(tables, "REPEATED", 1)
    assert once == ids_of(df.repartition(3))
    assert ids_of(df.limit(0)) == []


def test_null_and_its_neighbours_are_different_contents(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), ("x", "")], "a string, b string")
    assert len({r["row_id"] for r in tables.content_id(df).collect()}) == 4


def test_splits_stay_when_files_are_cut_otherwise(spark, tmp_path):
    path = str(tmp_path / "scans.parquet")
    spark.range(600).selectExpr("id % 250 as a", "cast(id % 125 as double) as b").repartition(6).write.parquet(path)
    found, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = assign_splits(tables.read_table(spark, path, ids="content"))
            found.append(sorted(tuple(r) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 600
    with pytest.raises(ValueError, match="unknown ids"):
        tables.read_table(spark, path, ids="random")


def parts(folder) -> int:
    return len(list(Path(folder).rglob("part-*.parquet")))


def test_a_thousand_runs_make_few_files(spark, tmp_path):
    folder = str(tmp_path / "log")
    with runs.RunLog(spark, folder, buffer=2500) as log:
        for i in range(1000):
            log.add("study", f"r{i}", {"k": i, "n": [1, i]}, {"rmse": i / 10}, {"ok": True}, step=i)
    assert parts(folder) < 20
    metrics = {r["run_id"]: (r["value"], r["step"]) for r in runs.read_log(spark, folder, "run_metrics").collect()}
    assert len(metrics) == 1000 and metrics["r7"] == (0.7, 7)
    assert runs.read_log(spark, folder, "run_params").count() == 2000 and runs.read_log(spark, folder, "run_tags").count() == 1000


def test_a_failed_append_keeps_its_entries(spark, tmp_path, monkeypatch):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    log.add("e", "r1", metrics={"a": 1.0})
    plain = runs.append_log
    monkeypatch.setattr(runs, "append_log", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        log.flush()
    monkeypatch.setattr(runs, "append_log", plain)
    log.flush()
    log.flush()
    assert runs.read_log(spark, str(tmp_path / "log"), "run_metrics").count() == 1


def test_compaction_keeps_every_entry(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    for i in range(6):
        runs.log_run(spark, many, "hot" if i % 3 else "cold", f"r{i}", {"a": i, "b": i, "same": 0})
    runs.compact_log(spark, many, few, "run_params")
    rows = [sorted(map(tuple, runs.read_log(spark, f, "run_params").collect())) for f in (many, few)]
    assert rows[0] == rows[1] and len(rows[0]) == 18 and parts(few) == 2 < parts(many)
    cut = str(tmp_path / "cut")
    runs.compact_log(spark, many, cut, "run_params", rows_per_file=4)
    assert sorted(map(tuple, runs.read_log(spark, cut, "run_params").collect())) == rows[0] and parts(cut) > 2


@pytest.mark.parametrize("limit", [1 << 26, 3 * 8 * 20, 0])
def test_medians_do_not_depend_on_the_block_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "SAMPLE_BYTES", limit)
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 9, 3).astype(float).tolist()) for k in ["hot"] * 41 + ["b"] * 20 + ["c"] + [None] * 4]
    df = spark.createDataFrame([*rows, ("b", [1.0, None, 2.0]), ("b", None), ("none", None)], "s string, spectrum array<double>").repartition(4)
    found = {r["s"]: r["spectrum"] for r in stats.replicate_spectra(df, "s", "median").collect()}
    expected = {k: [median(x[i] for s, x in rows if s == k) for i in range(3)] for k in ("hot", "b", "c", None)}
    assert found == expected
    plan = stats.replicate_spectra(df, "s", "median")._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate" in plan) == (limit < 1 << 26)


def test_run_files_are_scanned_as_written(spark, tmp_path):
    rows = [("a b", "r+1", "rmse", 0.5, 2, 1), ("a b", "r+1", "rmse", 0.25, 1, 0), ("a b", "r+1", "mae", None, 1, 0), ("c%20", "r", "rmse", -1e-7, 3, 2)]
    entries = spark.createDataFrame(rows, runs.RUN_METRICS)
    for _ in range(2):  # writing again replaces
        runs.write_run_files(entries, str(tmp_path))
    assert (tmp_path / "a b/r+1/metrics/rmse").read_text() == "1 0.25 0\n2 0.5 1\n"
    assert not [p for p in tmp_path.rglob("*") if p.name.startswith(".") and not p.name.endswith(".crc")]
    found = sorted(map(tuple, runs.scan_metrics(spark, str(tmp_path)).collect()), key=str)
    assert [r for r in found if r[3] == r[3]] == sorted([r for r in rows if r[3] is not None], key=str)
    assert [r[:3] for r in found if r[3] != r[3]] == [("a b", "r+1", "mae")]
    params = spark.createDataFrame([("e", "r", "model", "two words"), ("e", "r", "empty", None)], runs.RUN_PARAMS)
    runs.write_run_files(params, str(tmp_path / "p"), "params")
    assert sorted(map(tuple, runs.scan_params(spark, str(tmp_path / "p")).collect())) == [("e", "r", "empty", ""), ("e", "r", "model", "two words")]
    with pytest.raises(Exception, match="no file name in key"):
        runs.write_run_files(spark.createDataFrame([("e", "r", "a/b", "x")], runs.RUN_PARAMS), str(tmp_path), "params")
