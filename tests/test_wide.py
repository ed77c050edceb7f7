"""Wide tables: passes over the rows give what the dense moments give."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import matrix, table

from wavetable.operators import moments, search, select, wide
from wavetable.operators.latent import fit_latent
from wavetable.operators.outliers import OutlierDetector
from wavetable.operators.transform import ChannelPCA


@pytest.fixture()
def narrow_limit(monkeypatch):
    """No table of more than eight channels is dense."""
    monkeypatch.setattr(moments, "MAX_DENSE_BYTES", 10 * 10 * 8 * 5)


def folded(df, folds=4):
    return select.with_folds(df, folds, "row_id", 42)


def test_products_and_sums_equal_the_dense_scatter(spark, informative):
    df = folded(informative[2])
    dense, table_ = moments.fold_moments(df, fold=select.FOLDS), wide.wide_table(df, fold=select.FOLDS)
    vectors = np.random.default_rng(0).normal(size=(30, 6))
    left = [wide.NO_FOLD, 0, 1, 2, 3, 0]
    found = table_.times(vectors, left)
    for j, k in enumerate(left):
        part = dense.total if k == wide.NO_FOLD else dense.total.minus(dense.folds[k])
        assert np.allclose(found[:, j], part.scatter[:-1, :-1] @ vectors[:, j], rtol=1e-10, atol=1e-9)
        n, mean, cross, squares = table_.stats(k)
        assert n == part.n and np.allclose(mean, part.means) and np.allclose(cross, part.scatter[:-1, -1])
        assert np.allclose(squares, np.diag(part.scatter))
    assert np.allclose(table_.label_correlation(), dense.label_correlation())


def test_vectors_in_small_blocks_and_incomplete_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = 1e4 + rng.normal(size=(40, 5)), rng.normal(size=40)
    rows = [(i, i % 2, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(40, 0, [1.0, None, 2.0, 3.0, 4.0], 1.0), (41, 0, None, 1.0), (42, 1, [1.0] * 5, None), (43, None, [1.0] * 5, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, fold int, spectrum array<double>, label double")
    monkeypatch.setattr(wide, "BLOCK_BYTES", 5 * 8 * 2)
    table_ = wide.wide_table(df, fold="fold")
    assert table_.counts == {0: 20.0, 1: 20.0}
    centred = x - x.mean(axis=0)
    vectors = rng.normal(size=(5, 5))
    assert np.allclose(table_.times(vectors, [wide.NO_FOLD] * 5), centred.T @ centred @ vectors, atol=1e-8)


@pytest.mark.parametrize("scale", [True, False])
def test_many_fits_advance_together(informative, scale):
    df = folded(informative[2])
    dense, table_ = moments.fold_moments(df, fold=select.FOLDS), wide.wide_table(df, fold=select.FOLDS)
    fits = [(np.arange(30), wide.NO_FOLD), (np.array([0, 3, 4, 20]), 1), (np.array([7]), 2)]
    for (channels, k), found in zip(fits, table_.fit_many(fits, 4, scale)):
        part = dense.total if k == wide.NO_FOLD else dense.total.minus(dense.folds[k])
        expected = fit_latent(part.take(channels), 4, scale)
        b = expected.coefficients()
        assert np.allclose(found.coefficients(), b, rtol=1e-9, atol=1e-11)
        assert found.intercept(found.coefficients()) == pytest.approx(expected.intercept(b), rel=1e-9)
        assert np.allclose(found.importance(), expected.importance(), rtol=1e-9)
    errors = table_.cv_errors([c for c, _ in fits], 4, scale, 4)
    for (channels, _), mine in zip(fits, errors):
        assert np.mean(mine) == pytest.approx(select.cv_rmse(dense.take(channels), 4, scale), rel=1e-9)


def test_components_and_t2_do_not_depend_on_the_limit(scans, narrow_limit, monkeypatch):
    x, _, df = scans
    for options in ({"standardize": True}, {"standardize": False}):
        found = ChannelPCA(nComponents=5, **options).fit(df)
        with monkeypatch.context() as plain:
            plain.setattr(moments, "MAX_DENSE_BYTES", 1 << 29)
            expected = ChannelPCA(nComponents=5, **options).fit(df)
        assert np.allclose(found.array("eigenvalues"), expected.array("eigenvalues"), rtol=1e-9)
        assert found.array("totalVariance") == pytest.approx(expected.array("totalVariance"))
        assert np.allclose(np.abs((found.components * expected.components).sum(axis=0)), 1.0, atol=1e-9)
        assert np.allclose(matrix(found.transform(df)), matrix(expected.transform(df)), atol=1e-6)
    flags = OutlierDetector(method="both", threshold=1.0).fit(df)
    with monkeypatch.context() as plain:
        plain.setattr(moments, "MAX_DENSE_BYTES", 1 << 29)
        same = OutlierDetector(method="both", threshold=1.0).fit(df)
    assert flags.value("t2Limit") == pytest.approx(same.value("t2Limit"), rel=1e-8)
    ours, theirs = (m.transform(df).select("row_id", "is_outlier").collect() for m in (flags, same))
    assert sorted(ours) == sorted(theirs) and 0 < sum(r["is_outlier"] for r in ours) < len(x)


def test_lanczos_restarts_and_ends_on_low_rank():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.concatenate([[9.0, 5.0, 4.9, 4.8], np.linspace(4.7, 0.0, 296)])
    matrix_ = (q * values) @ q.T
    found, vectors = wide.leading_axes(lambda b: matrix_ @ b, 300, 4)
    assert np.allclose(found, values[:4], rtol=1e-10)
    assert np.allclose(matrix_ @ vectors, vectors * found, atol=1e-9)
    low = (q[:, :2] * [3.0, 1.0]) @ q[:, :2].T
    found, _ = wide.leading_axes(lambda b: low @ b, 300, 4)
    assert np.allclose(found, [3.0, 1.0, 0.0, 0.0], atol=1e-12)
    found, _ = wide.leading_axes(lambda b: 0.0 * b, 6, 4)
    assert np.allclose(found, 0.0)


def test_searches_do_not_depend_on_the_limit(informative, narrow_limit, monkeypatch):
    df = informative[2]
    cars = select.CARSSelector(nComponents=3, runs=6, folds=3, decay=0.7)
    genetic = select.GeneticSelector(nFeatures=4, population=4, generations=1, folds=2, nComponents=3)
    found, bred = cars.fit(df), genetic.fit(df)
    grid = {"n_components": [1, 2, 3], "scale": [True, False]}
    tuned = search.grid_search(df, "pls", grid, 3, False, row_id="row_id", seed=42)
    with monkeypatch.context() as plain:
        plain.setattr(moments, "MAX_DENSE_BYTES", 1 << 29)
        expected, bred_, tuned_ = cars.fit(df), genetic.fit(df), search.grid_search(df, "pls", grid, 3, False, row_id="row_id", seed=42)
    for ours, theirs in zip(found.history_rows, expected.history_rows):
        assert ours[1] == theirs[1] and ours[3] == theirs[3] and ours[2] == pytest.approx(theirs[2], rel=1e-8)
    assert found.value("channels") == expected.value("channels")
    assert bred.value("channels") == bred_.value("channels")
    assert np.allclose([h[2] for h in bred.history_rows], [h[2] for h in bred_.history_rows], rtol=1e-8)
    assert tuned.best_params == tuned_.best_params
    assert np.allclose([t[0] for t in tuned.trials], [t[0] for t in tuned_.trials], rtol=1e-9)


def test_twenty_thousand_channels(spark):
    rng = np.random.default_rng(11)
    bands = rng.normal(size=(3, 20_000))
    scores = rng.normal(size=(24, 3)) * [5.0, 3.0, 2.0]
    x = scores @ bands + 0.01 * rng.normal(size=(24, 20_000))
    df = table(spark, x, scores[:, 0] + 0.01 * rng.normal(size=24))
    model = ChannelPCA(nComponents=3, standardize=False).fit(df)
    sizes = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3] ** 2 / 23
    assert np.allclose(model.array("eigenvalues"), sizes, rtol=1e-9)
    cars = select.CARSSelector(nComponents=2, runs=3, folds=2, decay=0.3).fit(df)
    assert [h[1] for h in cars.history_rows] == [20_000, 6_000, 1_800]
    assert all(h[2] is not None for h in cars.history_rows)


def test_lots_hold_about_the_root_of_the_tasks(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    df = table(spark, x, x[:, 0]).repartition(30)
    found = moments.fold_moments(df).total
    assert found.n == 60 and np.allclose(found.scatter[:-1, :-1], (x - x.mean(0)).T @ (x - x.mean(0)))
