from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wavetable.operators.latent import PLSRegressor
from wavetable.operators.outliers import OutlierDetector
from wavetable.operators.transform import SNV, SavGol
from wavetable.plans import jobs
from wavetable.queries.registry import spectra, wide
from wavetable.session import durable
from wavetable.sources import runs, tables
from wavetable.streaming.score import read_scans, score_stream, write_scores


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """A CSV of scans with a duplicate row, an empty and a constant column, text and a planted outlier."""
    rng = np.random.default_rng(11)
    x = rng.random((40, 20)) + 1
    y = 10 * x[:, :4].mean(axis=1)
    x[5, :10] *= 50
    folder = tmp_path_factory.mktemp("raw") / "scans.csv"
    names = ",".join(str(900 + 10 * i) for i in range(20))
    lines = [f"ID,{names},Brix,Lab,Temperature,blank,same"]
    for i in range(40):
        lines.append(f"{i},{','.join(f'{v:.6f}' for v in x[i])},{y[i]:.6f},lab{i % 2},{20 + i % 5},,7")
    lines.append(lines[-1])
    folder.write_text("\n".join(lines))
    return str(folder), x, y


def test_prepare_spectra(spark, raw):
    path, x, y = raw
    df = tables.read_table(spark, path)
    done = jobs.prepare_spectra(df, "Brix", [SNV(), SavGol(window=5, polyorder=2, deriv=0)], exclude=["ID"], outlier_method="pca", threshold=3.0)
    rows = done.table.orderBy("row_id").collect()
    assert done.channels == [str(900 + 10 * i) for i in range(20)] and done.extras == ["Temperature"]
    assert len(rows) == 39 and 5 not in {r["row_id"] for r in rows}
    assert {r["row_id"]: r["label"] for r in rows}[7] == pytest.approx(y[7], abs=1e-6)
    assert all(len(r["spectrum"]) == 21 for r in rows) and rows[0]["spectrum"][20] == 20.0
    snv = (x[0] - x[0].mean()) / x[0].std()
    assert np.polyval(np.polyfit(range(5), snv[:5], 2), 0) == pytest.approx(rows[0]["spectrum"][0], abs=1e-5)


def test_empty_stage_list_means_no_correction(spark, raw):
    df = tables.read_table(spark, raw[0])
    done = jobs.prepare_spectra(df, "Brix", [], exclude=["ID"], remove_outliers=False)
    first = done.table.orderBy("row_id").first()["spectrum"][:20]
    assert np.allclose(first, np.round(raw[1][0], 6))


def test_dataset_job(spark, raw, tmp_path):
    folder = str(tmp_path / "out")
    done = jobs.prepare_dataset(spark, raw[0], folder, "snv", outlier_method="zscore")
    features = spark.read.parquet(f"{folder}/features")
    assert "is_outlier" in features.columns and "Sample_ID" in features.columns
    assert spark.read.parquet(f"{folder}/splits").groupBy("split").count().count() == 3
    report = tables.read_json(spark, f"{folder}/report")
    assert report["preprocessing_method"] == "snv" and report["target_stats"]["median"] > 0
    assert done.table.count() == 40


def test_unknown_format_and_missing_target(spark, raw):
    with pytest.raises(ValueError):
        tables.read_table(spark, "scans.xlsx")
    with pytest.raises(ValueError):
        jobs.load_and_prepare(spark, raw[0], target="Acid")


def test_single_experiment_saves_everything(spark, raw, tmp_path):
    folder = str(tmp_path / "exp")
    df = tables.read_table(spark, raw[0])
    _, metrics, _ = jobs.run_experiment(
        df, "Brix", "pls", "none", selection="vip", n_features=6, params={"n_components": 3}, exclude=["ID"],
        outlier_method="pca", fit_on="all", folder=folder,
    )
    row = metrics.first()
    assert row["r2"] > 0.5
    long = {r["metric"]: r["value"] for r in spark.read.parquet(f"{folder}/metrics").collect()}
    assert long["rmse"] == pytest.approx(row["rmse"])
    assert spark.read.parquet(f"{folder}/predictions").count() == 8
    assert spark.read.parquet(f"{folder}/channels").filter("selected").count() == 6


def test_processing_job_selects_channels(spark, raw):
    df = tables.read_table(spark, raw[0])
    done = jobs.process_spectra(df, "Brix", "none", selection="vip", n_features=4)
    assert len(done.channels) == 4 and len(done.table.first()["spectrum"]) == 4
    with pytest.raises(ValueError):
        jobs.process_spectra(df, "Brix", selection="other")


def test_study_records_failures(spark, tmp_path):
    plan = [jobs.Experiment("pls", "snv"), jobs.Experiment("pls", "snv", selection="vip", n_features=10), jobs.Experiment("nope", "snv")]
    study = jobs.Study(spectra(spark, SMALL))
    rows = {r["experiment"]: r for r in study.run(plan, str(tmp_path / "s")).collect()}
    assert rows["pls_snv_savgol"]["status"] == "ok" and rows["nope_snv_savgol"]["status"] == "failed"
    assert rows["pls_snv_savgol_vip10"]["rmse"] > 0
    found = runs.scan_models(spark, str(tmp_path / "s" / "models")).collect()
    assert {r["model_name"] for r in found} == {"pls_snv_savgol", "pls_snv_savgol_vip10"} and all(r["rmse"] > 0 for r in found)
    log = runs.read_log(spark, str(tmp_path / "s" / "log"), "run_metrics")
    assert log.count() == 8


def test_standard_study_has_27_rows():
    names = [e.name for e in jobs.standard_study()]
    assert len(names) == len(set(names)) == 27 and "rf_snv_savgol_tuned" in names and "xgb_snv_savgol_ga50" in names
    assert len(jobs.standard_study(False)) == 9


def test_run_log_files(spark, tmp_path):
    run = tmp_path / "exp1" / "run1"
    (run / "metrics").mkdir(parents=True)
    (run / "params").mkdir()
    (run / "metrics" / "rmse").write_text("1700 0.5 0\n1800 0.25 1\n")
    (run / "metrics" / "bad").write_text("oops\n")
    (run / "params" / "model").write_text("rf")
    rows = {(r["key"], r["step"]): r for r in runs.scan_metrics(spark, str(tmp_path)).collect()}
    assert rows[("rmse", 1)]["value"] == 0.25 and rows[("rmse", 1)]["run_id"] == "run1" and rows[("bad", 0)]["value"] is None
    assert [tuple(r) for r in runs.scan_params(spark, str(tmp_path)).collect()] == [("exp1", "run1", "model", "rf")]


def test_run_log_append(spark, tmp_path):
    folder = str(tmp_path / "log")
    runs.log_run(spark, folder, "e", "r1", {"a": [1, 2], "b": {"x": 1}, "c": (1,)}, {"rmse": np.float64(0.5)}, {"t": "v"}, step=3)
    runs.log_run(spark, folder, "e", "r2", {"a": 7})
    params = {(r["run_id"], r["key"]): r["value"] for r in runs.read_log(spark, folder, "run_params").collect()}
    assert params[("r1", "a")] == "[1, 2]" and params[("r1", "b")] == "{'x': 1}" and params[("r2", "a")] == "7"
    assert runs.read_log(spark, folder, "run_metrics").first()["step"] == 3


def test_catalogue_reports_unreadable_documents(spark, tmp_path):
    for name, text in {"rf_Brix_1": json.dumps({"rmse": 0.5}), "svr_Brix_2": "{broken"}.items():
        (tmp_path / name / "info").mkdir(parents=True)
        (tmp_path / name / "info" / "part-0.txt").write_text(text)
    rows = {r["model_type"]: r for r in runs.scan_models(spark, str(tmp_path)).collect()}
    assert rows["rf"]["rmse"] == 0.5 and rows["rf"]["error"] is None and rows["svr"]["error"]


def test_stream_equals_table(spark, tmp_path):
    scans = spectra(spark, SMALL)
    from pyspark.ml import Pipeline

    detector = OutlierDetector(threshold=2.5, removeOutliers=True)
    model = Pipeline(stages=[detector, SNV(), SavGol(), PLSRegressor(nComponents=3)]).fit(scans)
    scans.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_scans(spark, str(tmp_path / "in"), scans.schema, files_per_batch=1)
    write_scores(score_stream(stream, model), str(tmp_path / "out"), str(tmp_path / "state"), keep=["row_id", "prediction"]).awaitTermination()
    got = {r["row_id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["row_id"]: r["prediction"] for r in model.transform(scans).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_outlier_removal_on_many_imputed_channels_plans_quickly(spark, tmp_path):
    """Whole-spectrum conditions over many derived columns must not blow up the optimizer."""
    from wavetable.operators import clean, columns

    df = clean.impute(columns.nan_to_null(wide(spark, SMALL)), exclude=["row_id"])
    packed = columns.pack(columns.with_target(df, "Brix"))
    kept = OutlierDetector(removeOutliers=True, threshold=2.0).fit(packed).transform(packed)
    assert 0 < clean.require_label(kept).count() <= packed.count()


def test_checkpoint_folder_comes_from_the_session(spark):
    df = durable(spark.range(3).withColumn("v", F.col("id") * 2))
    assert df.count() == 3 and "Scan" in df._jdf.queryExecution().executedPlan().toString()
