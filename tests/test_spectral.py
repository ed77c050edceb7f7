from __future__ import annotations

import numpy as np
import pytest
from conftest import matrix, table
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from wavetable.functions import spectral
from wavetable.operators import columns
from wavetable.operators.transform import MSC, SNV, ChannelPCA, ChannelScaler, ColumnFunction, SavGol
from wavetable.plans.chains import build_chain, chains, correction_stages


def test_snv_rows_have_mean_zero_and_deviation_one(scans):
    out = matrix(SNV().transform(scans[2]))
    assert np.abs(out.mean(axis=1)).max() < 1e-10
    assert np.abs(out.std(axis=1) - 1).max() < 1e-10


def test_undefined_and_incomplete_spectra_become_null(spark):
    rows = [(0, [1.0, 1.0, 1.0]), (1, [1.0, None, 2.0]), (2, None), (3, [1.0, 2.0, 4.0]), (4, [float("nan"), 1.0, 2.0])]
    df = spark.createDataFrame(rows, "row_id long, spectrum array<double>")
    done = df.select("row_id", spectral.snv("spectrum").alias("s")).collect()
    assert {r["row_id"] for r in done if r["s"] is not None} == {3}


def test_integer_spectra_are_not_truncated(spark):
    df = spark.createDataFrame([(0, [1, 2, 4])], "row_id long, spectrum array<int>")
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(matrix(SNV().transform(df))[0], (x - x.mean()) / x.std())


def test_spectra_of_different_length_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "row_id long, spectrum array<double>").coalesce(1)
    with pytest.raises(Exception, match="same number of channels"):
        df.select(spectral.snv("spectrum")).collect()


@pytest.mark.parametrize("window,order,deriv", [(15, 2, 1), (15, 2, 2), (5, 2, 0), (7, 3, 1), (151, 3, 0)])
def test_savgol_equals_a_polynomial_fit_at_every_point(scans, window, order, deriv):
    x, _, df = scans
    out = matrix(SavGol(window=window, polyorder=order, deriv=deriv).transform(df))
    p = x.shape[1]
    for i in (0, 1, 40, p // 2, p - 2, p - 1):
        start = min(max(i - window // 2, 0), p - window)
        fit = np.polynomial.Polynomial.fit(np.arange(window), x[3, start : start + window], order, domain=[0, 1], window=[0, 1])
        assert out[3, i] == pytest.approx((fit.deriv(deriv) if deriv else fit)(i - start), abs=1e-7)


def test_savgol_settings_are_checked(scans):
    for bad in ({"window": 4}, {"window": 5, "polyorder": 5}, {"deriv": -1}):
        with pytest.raises(ValueError):
            SavGol(**bad)
    with pytest.raises(Exception, match="longer than the spectrum"):
        SavGol(window=153).transform(scans[2]).collect()


def test_derivative_beyond_the_order_is_zero():
    assert not spectral.savgol_weights(5, 2, 3).any()


def test_msc_equals_regression_on_the_mean_spectrum(scans):
    x, _, df = scans
    out = matrix(MSC().fit(df).transform(df))
    mean = x.mean(axis=0)
    for i in (0, 17):
        slope, intercept = np.polyfit(mean, x[i], 1)
        assert np.allclose(out[i], (x[i] - intercept) / slope)


def test_msc_leaves_the_mean_spectrum_alone(spark, scans):
    x, _, df = scans
    model = MSC().fit(df)
    mean = x.mean(axis=0)
    assert np.allclose(matrix(model.transform(table(spark, mean[None], [0.0])))[0], mean)


def test_corrections_leave_other_columns_alone(scans):
    out = SavGol(deriv=1).transform(scans[2])
    assert out.columns == ["row_id", "spectrum", "label"]
    assert sorted(r["label"] for r in out.collect()) == sorted(scans[1].tolist())


def test_dispatch_smooths_by_default_and_rejects_unknown(scans):
    x, _, df = scans
    smooth = df.select("row_id", spectral.spectral_transform("spectrum", "savgol").alias("spectrum"))
    assert np.allclose(matrix(smooth), matrix(SavGol(deriv=0).transform(df)))
    assert np.allclose(matrix(df.select("row_id", spectral.spectral_transform("spectrum", "none").alias("spectrum"))), x)
    with pytest.raises(ValueError):
        spectral.spectral_transform("spectrum", "other")


def test_scaler_uses_population_deviation_and_keeps_flat_channels(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0], [8.0, 5.0]])
    df = table(spark, x, np.zeros(3))
    out = matrix(ChannelScaler().fit(df).transform(df))
    assert np.allclose(out[:, 0], (x[:, 0] - 4) / x[:, 0].std()) and np.allclose(out[:, 1], 0)


@pytest.mark.parametrize("standardize", [True, False])
def test_pca_equals_svd(scans, standardize):
    x, _, df = scans
    model = ChannelPCA(nComponents=5, standardize=standardize).fit(df)
    z = x - x.mean(axis=0)
    z = z / x.std(axis=0) if standardize else z
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(model.array("eigenvalues"), s[:5] ** 2 / (len(x) - 1))
    assert np.allclose(np.abs(matrix(model.transform(df))), np.abs(z @ vt[:5].T), atol=1e-8)
    assert (model.components[np.abs(model.components).argmax(axis=0), range(5)] > 0).all()


def test_pca_columns_come_before_the_others(scans):
    out = ChannelPCA(nComponents=3, asColumns=True).fit(scans[2]).transform(scans[2])
    assert out.columns == ["PC1", "PC2", "PC3", "row_id", "label"]


def test_a_chain_is_one_python_stage_and_survives_saving(spark, scans, tmp_path):
    df = scans[2]
    model = Pipeline(stages=[SNV(), SavGol(), MSC()]).fit(df)
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.allclose(matrix(again.transform(df)), matrix(model.transform(df)))


def test_named_chains(scans):
    assert set(chains()) == {"raw", "snv", "sg1", "sg2", "msc", "snv_pca", "sg1_pca"}
    with pytest.raises(ValueError):
        build_chain("other")
    stages = build_chain("msc", custom=[SNV()]).getStages()
    assert [type(s).__name__ for s in stages] == ["OutlierDetector", "MSC", "SNV"]
    assert [type(s).__name__ for s in correction_stages("msc", True)] == ["MSC", "SavGol"]
    with pytest.raises(ValueError):
        correction_stages("savgol")


def test_user_function(scans):
    step = ColumnFunction(function="wavetable.queries.spectra:absorbance")
    assert np.allclose(matrix(step.transform(scans[2])), -np.log10(np.abs(scans[0]) + 1))


def test_column_names():
    names = ["sample_id", "900", "900.5", "1000,25", "1e3", "wl_900", ".5", "12a", ""]
    assert columns.split_columns(names) == (["900", "900.5", "1000,25"], ["sample_id", "1e3", "wl_900", ".5", "12a", ""])
    assert columns.wavelength("1000,25") == 1000.25
    assert columns.wl_numbers(["wl_900", "x", "wl_901_b", "wl_9.5"]) == [900, 901]


def test_pack_and_unpack_dotted_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, "a")], "id int, `900.5` double, `901` double, note string")
    df.write.option("header", True).csv(str(tmp_path / "w.csv"))
    back = spark.read.csv(str(tmp_path / "w.csv"), header=True, inferSchema=True)
    packed = columns.pack(back)
    assert columns.channel_names(packed) == ["900.5", "901"]
    assert columns.unpack(packed).first().asDict() == {"id": 1, "note": "a", "900.5": 2.0, "901": 3.0}
    long = columns.to_long(packed, "id")
    assert [tuple(r) for r in long.orderBy("channel").collect()] == [(1, 0, 900.5, 2.0), (1, 1, 901.0, 3.0)]


def test_numeric_filter_rules(spark):
    df = spark.createDataFrame([(1, 2.0, True, "x")], "a int, b double, c boolean, d string")
    assert columns.filter_numeric(df).columns == ["a", "b"]
    assert columns.filter_numeric(df, ["a", "zz"]).columns == ["b"]
    assert columns.filter_numeric(df, keep=["d", "zz"]).columns == ["d"]
    assert columns.filter_numeric(df, keep=["zz"]).columns == ["a", "b"]


def test_target(spark):
    df = spark.createDataFrame([(1, 2)], "a int, t int")
    assert columns.with_target(df, "t").first().asDict() == {"a": 1, "label": 2.0}
    assert columns.with_target(df, "no", required=False).first()["label"] is None
    with pytest.raises(ValueError):
        columns.with_target(df, "no")


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "a double, b string")
    assert columns.nan_to_null(df).filter(F.col("a").isNull()).count() == 1
