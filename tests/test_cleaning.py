from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from wavetable.operators import clean, position, splits, stats
from wavetable.operators.outliers import OutlierDetector


def test_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1.0), (4, "a", None)], "row_id long, k string, v double")
    kept = clean.drop_duplicates(df, "row_id")
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2]
    assert clean.duplicate_census(df, "row_id").first().asDict() == {"duplicate_rows": 3, "removed_rows": 2}


def test_uninformative_columns(spark):
    df = spark.createDataFrame(
        [(1, None, 5, 1, float("nan")), (2, None, 5, None, float("nan"))], "a int, empty string, same int, one_or_null int, nan double"
    )
    assert clean.drop_uninformative(df).columns == ["a", "one_or_null"]
    assert clean.drop_uninformative(df, constant=False).columns == ["a", "same", "one_or_null"]
    assert "empty" in clean.drop_uninformative(df, empty=False, constant=False).columns


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1.0, "b", True), (None, "a", None), (3.0, None, True), (None, "a", False), (5.0, "b", None)], "x double, t string, f boolean"
    )
    done = clean.impute(df)
    assert done.filter("x is null or t is null or f is null").isEmpty()
    assert done.filter("x = 3.0").count() == 3 and done.filter("t = 'a'").count() == 3


def test_label_guard(spark):
    df = spark.createDataFrame([(1, None)], "a int, label double")
    with pytest.raises(ValueError):
        clean.require_label(df)


def test_sample_ids(spark):
    df = spark.createDataFrame([(1, 7, None, "w")], "row_id long, `SAMPLE NO` int, plant string, `wetlab ID` string")
    assert clean.add_sample_id(df).first()["Sample_ID"] == "7_nan_w"
    ids = spark.createDataFrame([(30,), (10,), (20,)], "row_id long")
    assert {r["row_id"]: r["Sample_ID"] for r in clean.add_sample_id(ids).collect()} == {10: "sample_0", 20: "sample_1", 30: "sample_2"}


def test_positions_with_clumped_ids(spark):
    ids = [*range(500), *range(10**12, 10**12 + 300), 2**60]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "row_id long")
    rows = position.with_position(df, "row_id", rows_per_task=37).collect()
    assert {r["row_id"]: r["position"] for r in rows} == {v: i for i, v in enumerate(ids)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1003])
def test_split_and_fold_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    test, val = splits.part_sizes(n, 0.2, 0.2)
    counts = {r["split"]: r["count"] for r in splits.assign_splits(df).groupBy("split").count().collect()}
    assert counts.get("test", 0) == test and counts.get("val", 0) == val
    sizes = {r["fold"]: r["count"] for r in splits.shuffled_folds(df, 5).groupBy("fold").count().collect()}
    assert [sizes.get(i, 0) for i in range(5)] == [len(p) for p in np.array_split(np.arange(n), 5)]


def test_split_sizes_of_one_hundred_rows():
    assert splits.part_sizes(100, 0.2, None) == (20, 0)
    assert splits.part_sizes(100, 0.2, 0.2) == (20, 20)


def test_cut_points_refine_crowded_bins(spark, monkeypatch):
    monkeypatch.setattr(position, "SMALL", 3)
    monkeypatch.setattr(position, "BINS", 4)
    ids = [*range(40), *range(10**9, 10**9 + 40)]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    assert position.id_cut_points(df, "row_id", lambda n: [1, 40, 41, 63, n]) == (80, {1: 0, 40: 39, 41: 10**9, 63: ids[62], 80: ids[79]})


def test_hash_cut_points_refine_crowded_prefixes(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(position, "SMALL", 2)
    monkeypatch.setattr(position, "HEX_DIGITS", 1)
    ids = [*range(60), *[7] * 30]  # one id repeated, so its key can never be told apart
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    keys = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in ids)
    wanted = [1, 5, 17, 44, 60, 89, 90]
    assert position.hash_cut_points(df, "row_id", lambda n: wanted) == (90, {r: keys[r - 1] for r in wanted})


def test_contiguous_folds_follow_the_id(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id")
    rows = splits.contiguous_folds(df, 4).orderBy("row_id").collect()
    assert [r["fold"] for r in rows] == [i for i, p in enumerate(np.array_split(np.arange(103), 4)) for _ in p]


def test_two_way_split_limits(spark):
    with pytest.raises(ValueError):
        splits.two_way_split(spark.range(5), "id", 0.6)


def test_one_stratum_with_most_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1900, "big").when(F.col("id") < 1997, "small").alias("s"))
    rows = splits.stratified_splits(df, "s").groupBy("s", "split").count().collect()
    sizes = {(r["s"], r["split"]): r["count"] for r in rows}
    assert sizes[("big", "test")] == 380 and sizes[("big", "val")] == 380 and sizes[("small", "test")] == 20
    assert sizes[(None, "test")] == 1 and sum(sizes.values()) == 2000


def test_exact_median_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(3)
    values = {"hot": np.round(rng.normal(size=30001), 2), "even": rng.normal(size=1000), "one": np.array([4.0]), "same": np.full(7, 2.5)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["median"] for r in position.exact_median(df, "k", "v").collect()}
    assert found == {k: float(np.median(v)) for k, v in values.items()}


def test_exact_median_of_a_table(spark):
    """Heavy values at the middle, NaN last, missing values and no values at all."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(30_000, 1.5), rng.normal(size=29_000), np.full(1001, 1.25)])
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double")
    expected = float(np.median(np.append(values, np.inf)))
    assert position.exact_median(df, [], "v", accuracy=100).collect() == [(expected,)]
    assert position.exact_median(df.filter("v is null"), [], "v").collect() == [(None,)]


def test_replicate_medians_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, 4.0), (None, 7.0, 8.0)], "s string, x double, y double")
    rows = {r["s"]: (r["x"], r["y"]) for r in stats.replicate_columns(df, "s", ["x", "y"], "median").collect()}
    assert rows == {"a": (2.0, None), "b": (None, 4.0), None: (7.0, 8.0)}


def test_exact_median_beyond_the_sketch_accuracy(spark):
    df = spark.range(50_001).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 50_001).cast("double").alias("v"))
    assert position.exact_median(df, "k", "v", accuracy=100).first()["median"] == 25_000.0
    assert position.exact_median(df, [], "v", accuracy=100).first()["median"] == 25_000.0


@pytest.mark.parametrize("method", ["mean", "median", "max", "min"])
def test_replicates(spark, method):
    rng = np.random.default_rng(0)
    x, group = rng.normal(size=(50, 4)), rng.integers(0, 5, 50)
    df = spark.createDataFrame([(int(g), r.tolist()) for g, r in zip(group, x)], "s int, spectrum array<double>")
    found = {r["s"]: r["spectrum"] for r in stats.replicate_spectra(df, "s", method).collect()}
    for g in range(5):
        assert np.allclose(found[g], getattr(np, method)(x[group == g], axis=0))


def zscore_mask(x, threshold, share):
    z = np.abs((x - x.mean(axis=0)) / x.std(axis=0))
    return (z > threshold).sum(axis=1) >= max(1, int(x.shape[1] * share))


def test_planted_outlier_is_found_by_zscore(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 40))
    x[0] *= 20
    df = table(spark, x, np.zeros(60))
    out = OutlierDetector(threshold=3.0).fit(df).transform(df)
    flags = {r["row_id"] for r in out.filter("is_outlier").collect()}
    assert flags == set(np.flatnonzero(zscore_mask(x, 3.0, 0.05))) and 0 in flags


def test_share_below_one_channel(spark):
    rng = np.random.default_rng(1)
    df = table(spark, rng.random((20, 5)), np.zeros(20))
    assert OutlierDetector(channelShare=0.1, zeroMeansAll=True).fit(df).transform(df).filter("is_outlier").count() == 20
    assert OutlierDetector(channelShare=0.1).fit(df).transform(df).filter("is_outlier").count() == 0


def test_t2_equals_svd_and_its_sum_is_known(spark, scans):
    x, _, df = scans
    out = OutlierDetector(method="pca", nComponents=6, keepScores=True).fit(df).transform(df)
    t2 = np.array([r["t2"] for r in out.orderBy("row_id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, _, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(t2, (u[:, :6] ** 2).sum(axis=1) * (len(x) - 1))
    assert t2.sum() == pytest.approx(6 * (len(x) - 1))


def test_detector_scores_rows_it_has_not_seen(spark):
    rng = np.random.default_rng(5)
    model = OutlierDetector(method="both", nComponents=3).fit(table(spark, rng.normal(size=(100, 10)), np.zeros(100)))
    far = table(spark, np.vstack([np.full((1, 10), 40.0), np.zeros((1, 10))]), [0, 0])
    assert {r["row_id"]: r["is_outlier"] for r in model.transform(far).collect()} == {0: True, 1: False}
    with pytest.raises(ValueError):
        OutlierDetector(method="other")


def test_duplicates_by_fingerprint_equal_duplicates_by_content(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, None, "a", 0.0), (2, "a", None, 0.0), (3, None, "a", -0.0), (4, "a", None, nan), (5, "a", None, nan), (6, "x", "y", None), (7, "x", "y", None), (8, "q", "q", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, s string, t string, v double").repartition(3)
    ids = lambda: sorted(r["row_id"] for r in clean.drop_duplicates(df, "row_id").collect())
    plain = lambda: clean.drop_duplicates(df.drop("row_id")).count()
    census = lambda: tuple(clean.duplicate_census(df, "row_id").first())
    assert (ids(), plain(), census()) == ([1, 2, 4, 6, 8], 5, (6, 3))
    monkeypatch.setattr(clean, "REPEATED", 0)
    assert (ids(), plain(), census()) == ([1, 2, 4, 6, 8], 5, (6, 3))
    # rows that share a fingerprint without being equal all stay
    monkeypatch.setattr(clean, "REPEATED", 10)
    monkeypatch.setattr(clean, "fingerprinted", lambda d, c: d.withColumns({p: F.lit(1).cast("long") for p in clean.PRINTS}))
    assert (ids(), plain(), census()) == ([1, 2, 4, 6, 8], 5, (6, 3))


def test_only_fingerprints_and_shared_rows_are_shuffled(spark):
    df = spark.range(200).selectExpr("id", "repeat('x', 500) || (id % 190) as wide")
    plan = clean.drop_duplicates(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Aggregate") == 1
