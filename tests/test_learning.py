from __future__ import annotations

import numpy as np
import pytest
from conftest import matrix, table
from pyspark.ml.regression import LinearRegression
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wavetable.operators import latent, moments, rank, regress, search, select, stats
from wavetable.operators.transform import AsVector
from wavetable.sources import tables


def nipals(x, y, components, scale):
    """Textbook deflation, used as the yardstick."""
    xm, ym = x.mean(axis=0), y.mean()
    sd = x.std(axis=0, ddof=1) if scale else np.ones(x.shape[1])
    e, f = (x - xm) / sd, y - ym
    ws, ps, qs, ts = [], [], [], []
    for _ in range(components):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p = e.T @ t / (t @ t)
        q = f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q), ts.append(t)
    w, p, q, t = (np.array(v).T for v in (ws, ps, qs, ts))
    b = (w @ np.linalg.inv(p.T @ w) @ q) / sd
    spread = t.var(axis=0)
    vip = np.sqrt(x.shape[1] * ((w**2) @ spread) / spread.sum())
    return b, ym - xm @ b, vip


@pytest.mark.parametrize("scale", [True, False])
def test_pls_and_vip_equal_deflation(informative, scale):
    x, y, df = informative
    b, intercept, vip = nipals(x, y, 4, scale)
    fit = latent.fit_latent(moments.moments(df), 4, scale)
    assert np.allclose(fit.coefficients(), b) and fit.intercept(fit.coefficients()) == pytest.approx(intercept)
    assert np.allclose(fit.importance(), vip)
    assert (fit.importance() ** 2).sum() == pytest.approx(x.shape[1])


def test_matrix_free_fit_equals_the_dense_one(informative, monkeypatch):
    x, y, df = informative
    dense = latent.fit_table(df, 4, True, "spectrum", "label")
    monkeypatch.setattr(moments, "MAX_DENSE_BYTES", 100)
    wide = latent.fit_table(df, 4, True, "spectrum", "label")
    assert np.allclose(dense.coefficients(), wide.coefficients()) and np.allclose(dense.importance(), wide.importance())


def test_full_rank_pls_is_least_squares(informative):
    x, y, df = informative
    model = regress.create_model("pls", n_components=30).fit(df)
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)
    out = model.transform(df).orderBy("row_id").collect()
    assert np.allclose([r["prediction"] for r in out], np.c_[np.ones(len(x)), x] @ beta)


def test_constant_label_gives_its_mean(spark):
    x = np.random.default_rng(0).normal(size=(20, 4))
    df = table(spark, x, np.full(20, 3.0))
    out = regress.create_model("pls").fit(df).transform(df).agg(F.min("prediction"), F.max("prediction")).first()
    assert out[0] == pytest.approx(3.0) and out[1] == pytest.approx(3.0)


def test_moments_skip_incomplete_rows_and_subtract_by_fold(spark):
    rng = np.random.default_rng(2)
    x, y = 1e6 + rng.normal(size=(50, 3)), rng.normal(size=50)
    rows = [(i, i % 3, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(50, 0, [1.0, None, 2.0], 1.0), (51, 0, None, 1.0), (52, 0, [1.0, 2.0, 3.0], None), (53, None, [1.0, 2.0, 3.0], 1.0)]
    df = spark.createDataFrame(rows, "row_id long, fold int, spectrum array<double>, label double")
    found = moments.fold_moments(df, fold="fold")
    fold = np.arange(50) % 3
    assert found.total.n == 50 and np.allclose(found.total.scatter[:-1, :-1], (x - x.mean(0)).T @ (x - x.mean(0)))
    for k, (train, held) in enumerate(found.pairs()):
        keep = fold != k
        assert np.allclose(train.mean, x[keep].mean(axis=0)) and held.n == (~keep).sum()
        b = latent.fit_latent(train, 3, False)
        c = b.coefficients()
        direct = ((y[~keep] - x[~keep] @ c - b.intercept(c)) ** 2).sum()
        assert held.squared_error(c, b.intercept(c)) == pytest.approx(direct, rel=1e-6)


def test_vip_finds_the_informative_channels(informative):
    found = select.VIPSelector(nComponents=3, nFeatures=5).fit(informative[2])
    assert found.value("channels") == [0, 1, 2, 3, 4]
    loose = select.VIPSelector(nComponents=3, nFeatures=5, useCount=False).fit(informative[2])
    scores = loose.array("scores")
    assert loose.value("channels") == np.flatnonzero(scores >= 1.0).tolist()


def brute_cars(x, y, fold, runs, components, decay):
    """Row-level elimination with refitting, the yardstick of the moment route."""
    p = x.shape[1]

    def coefficients(rows, chosen):
        return nipals(x[rows][:, chosen], y[rows], min(components, len(chosen)), True)

    everything = np.ones(len(y), dtype=bool)
    weights = select.rescaled(np.abs(coefficients(everything, np.arange(p))[0]))
    history = []
    for run in range(runs):
        chosen = np.sort(np.argsort(weights, kind="stable")[-max(int(p * decay**run), 1) :])
        errors = []
        for k in np.unique(fold):
            b, c, _ = coefficients(fold != k, chosen)
            errors.append(np.sqrt(np.mean((y[fold == k] - x[fold == k][:, chosen] @ b - c) ** 2)))
        history.append((len(chosen), np.mean(errors), chosen.tolist()))
        weights[chosen] = np.abs(coefficients(everything, chosen)[0])
        weights = select.rescaled(weights)
    return history


def test_cars_equals_refitting_on_rows(spark, informative):
    x, y, df = informative
    folded = select.with_folds(df, 5, "row_id", 42)
    fold = np.array([r["spectral_fold"] for r in folded.orderBy("row_id").collect()])
    found = select.CARSSelector(nComponents=3, runs=12).fit(df)
    expected = brute_cars(x, y, fold, 12, 3, 0.95)
    for (_, size, error, chosen), (size_, error_, chosen_) in zip(found.history_rows, expected):
        assert size == size_ and chosen == chosen_ and error == pytest.approx(error_)
    best = min(range(12), key=lambda i: expected[i][1])
    assert found.value("channels") == expected[best][2]


def test_cars_scans_the_data_once(spark, informative):
    folded = select.with_folds(informative[2], 5, "row_id", 42)
    table_ = moments.fold_moments(folded, fold="spectral_fold")
    spark.sparkContext.setJobGroup("cars", "cars")
    select.CARSSelector(nComponents=3, runs=30).from_moments(table_)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("cars")
    spark.sparkContext.setJobGroup("other", "other")


def test_cars_takes_the_nearest_size(informative):
    found = select.CARSSelector(nComponents=3, runs=20, nFeatures=17).fit(informative[2])
    sizes = [h[1] for h in found.history_rows]
    assert len(found.value("channels")) == min(sizes, key=lambda s: abs(s - 17))


def test_genetic_search(spark, informative):
    chooser = select.GeneticSelector(nFeatures=5, population=20, generations=6, nComponents=3)
    found = chooser.fit(informative[2])
    again = chooser.fit(informative[2])
    assert len(found.value("channels")) <= 5 and found.value("channels") == again.value("channels")
    assert len(set(found.value("channels")) & set(range(5))) >= 4
    best = stats.generation_stats(found.history(spark)).orderBy("generation").collect()
    assert len(best) == 7 and best[-1]["max"] >= best[0]["max"]


def test_genetic_score_equals_cross_validation_on_rows(spark, informative):
    x, y, df = informative
    folded = select.with_folds(df, 4, "row_id", 0, contiguous=True)
    table_ = moments.fold_moments(folded, fold="spectral_fold")
    chosen = np.array([0, 3, 8, 20])
    errors = []
    for part in np.array_split(np.arange(len(y)), 4):
        keep = np.setdiff1d(np.arange(len(y)), part)
        b, c, _ = nipals(x[np.ix_(keep, chosen)], y[keep], 2, False)
        errors.append(np.sqrt(np.mean((y[part] - x[np.ix_(part, chosen)] @ b - c) ** 2)))
    assert select.subset_score(table_, chosen, 2, "pls") == pytest.approx(-np.mean(errors))
    assert select.subset_score(table_, np.array([], dtype=int), 2, "pls") == float("-inf")


def test_genetic_search_with_a_user_learner(informative):
    learner = Pipeline(stages=[AsVector(), LinearRegression()])
    x, y, df = informative
    found = select.GeneticSelector(estimator=learner, nFeatures=4, population=4, generations=1, folds=2).fit(df)
    assert 0 < len(found.value("channels")) <= 4


def test_selected_channels_keep_order_and_names(spark, informative):
    from wavetable.operators.columns import channel_names, pack, unpack

    x, _, df = informative
    wide = unpack(df, [str(900 + i) for i in range(30)])
    model = select.ChannelSelection(channels=[2, 7], scores=np.arange(30.0))
    out = model.transform(pack(wide))
    assert channel_names(out) == ["902", "907"] and np.allclose(matrix(out), x[:, [2, 7]])


def test_elastic_net_routes_agree(informative):
    x, y, df = informative
    m = moments.moments(df)
    w, b = regress.elastic_net(m, 0.05, 0.5)
    gradient = x.T @ (x @ w + b - y) / len(y) + 0.025 * w
    on = w != 0
    assert np.allclose(gradient[on], -0.025 * np.sign(w[on]), atol=1e-6) and (np.abs(gradient[~on]) <= 0.025 + 1e-6).all()
    w2, b2 = regress.fit_elastic_net_wide(df, 0.05, 0.5)
    assert np.allclose(w, w2, atol=1e-4) and b == pytest.approx(b2, abs=1e-4)


def test_epsilon_regression_reaches_a_near_optimal_objective(informative):
    x, y, df = informative
    model = regress.create_model("svr", kernel="linear", C=1.0, epsilon=0.1).fit(df).stages[0]
    w, b = model.array("coefficients"), model.value("intercept")

    def objective(w_, b_):
        return np.maximum(np.abs(y - x @ w_ - b_) - 0.1, 0).sum() + 0.5 * w_ @ w_

    best = objective(w, b)
    rng = np.random.default_rng(0)
    for size in (0.3, 0.1, 0.03, 0.01):
        for _ in range(200):
            assert objective(w + size * rng.normal(size=30) / 5, b + size * rng.normal() / 5) > best * 0.995
    assert best < objective(np.zeros(30), np.median(y))
    with pytest.raises(Exception, match="kernel"):
        regress.create_model("svr", kernel="poly").fit(df)


def test_rbf_features_help_on_a_curved_target(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, size=(300, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    df = table(spark, x, y)
    scores = {}
    for kernel in ("linear", "rbf"):
        model = regress.create_model("svr", kernel=kernel, C=10.0).fit(df)
        scores[kernel] = stats.evaluate(model.transform(df)).first()["r2"]
    assert scores["rbf"] > 0.9 > scores["linear"]


@pytest.mark.parametrize("kind,params", [
    ("pls", {}), ("elasticnet", {"alpha": 0.01}), ("svr", {}), ("rf", {"n_estimators": 5, "max_depth": 4}),
    ("xgb", {"n_estimators": 5}), ("lgbm", {"n_estimators": 3, "num_leaves": 7}),
])
def test_every_model_trains_saves_and_loads(spark, informative, tmp_path, kind, params):
    _, _, df = informative
    model = regress.train_model(df, kind, params)
    path = tables.save_model(model, str(tmp_path / kind), {"kind": kind}, spark)
    again, info = tables.load_model(path, spark)
    first = [r["prediction"] for r in model.transform(df).orderBy("row_id").collect()]
    second = [r["prediction"] for r in again.transform(df).orderBy("row_id").collect()]
    assert np.allclose(first, second) and info == {"kind": kind} and np.isfinite(first).all()


def test_model_factory_defaults():
    assert regress.model_params("rf", n_estimators=7)["n_estimators"] == 7
    with pytest.raises(ValueError):
        regress.create_model("other")
    forest = regress.create_model("rf").getStages()[-1].params_given()
    assert forest["n_estimators"] == 100 and forest["max_depth"] is None and forest["min_samples_split"] == 2


def test_importances_cover_every_channel(spark, informative):
    model = regress.train_model(informative[2], "rf", {"n_estimators": 10, "max_depth": 5})
    rows = regress.feature_importances(model, spark).orderBy(F.col("importance").desc()).collect()
    assert len(rows) == 30 and sum(r["importance"] for r in rows) == pytest.approx(1.0) and rows[0]["channel"] < 5


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 2.0)], "label double, prediction double")
    assert stats.evaluate(df).first().asDict() == {"rmse": 0.0, "mae": 0.0, "r2": 1.0, "explained_variance": 1.0, "n": 2, "n_skipped": 1}
    worse = df.withColumn("prediction", F.col("prediction") + 1)
    row = stats.evaluate(worse).first()
    assert row["r2"] == 0.0 and row["explained_variance"] == 1.0


def test_grid_search_scores_equal_single_scores_and_best_is_best(informative):
    _, _, df = informative
    found = search.grid_search(df, "pls", {"n_components": [1, 3], "scale": [True, False]})
    for value, state, params in found.trials:
        assert state == "complete" and value == pytest.approx(search.cv_score(df, "pls", params))
        assert found.best_score >= value
    assert found.model is not None and found.n_trials == 4


def test_random_search_draws_without_repetition(informative):
    found = search.random_search(informative[2], "elasticnet", n_iter=15, refit=False)
    drawn = [tuple(sorted(t[2].items())) for t in found.trials]
    assert len(set(drawn)) == 15 and found.best_score == max(t[0] for t in found.trials)


def test_adaptive_search_on_trees_records_failures(spark, informative):
    space = {"n_estimators": search.Range(2, 4, whole=True), "max_depth": search.Choice((3, -5))}
    found = search.adaptive_search(informative[2], "rf", space, n_trials=5, folds=2, startup=3, batch=2)
    states = {t[1] for t in found.trials}
    assert found.best_params["max_depth"] == 3 and states <= {"complete", "failed", "pruned"}
    best = rank.best_trial(found.table(spark)).first()
    assert best["n_trials"] == 5 and best["best_score"] == pytest.approx(found.best_score)


def test_spaces_are_well_formed():
    rng = np.random.default_rng(0)
    for kind, space in search.SPACES.items():
        for _ in range(20):
            drawn = search.propose(space, rng)
            again = search.propose(space, rng, drawn)
            params = {k: v for k, v in again.items() if not k.startswith("_")}
            regress.create_model(kind, **params)
            for name, part in space.items():
                if isinstance(part, search.Range) and name in again:
                    assert part.low <= again[name] <= part.high


@pytest.mark.parametrize("name", [
    "random_forest", "gradient_boosting", "leafwise_boosting", "model_factory", "tree_importances", "grid_search_forest",
    "adaptive_search", "genetic_history", "single_experiment", "tuned_experiment", "experiment_study",
])
def test_registered_learners_run_their_whole_job(spark, monkeypatch, name):
    """The operators are called without smaller forests, fewer rounds or smaller grids than their defaults."""
    import contextlib
    from unittest.mock import MagicMock

    from wavetable.queries import learning

    calls = []

    def called(*args, **options):
        calls.append((args, options))
        if name != "model_factory":
            raise InterruptedError
        return MagicMock()

    for module, operator in (
        (learning.regress, "train_model"), (learning.search, "grid_search"), (learning.search, "adaptive_search"),
        (learning.select, "GeneticSelector"), (learning.jobs, "run_experiment"), (learning.jobs.Study, "run"),
    ):
        monkeypatch.setattr(module, operator, called)
    made = []
    monkeypatch.setattr(learning.jobs.Study, "__init__", lambda self, *args, **options: made.append(options))
    for helper in ("spectra", "wide", "assign_splits", "stats"):
        monkeypatch.setattr(learning, helper, MagicMock())
    with contextlib.suppress(InterruptedError):
        learning_query(name)(MagicMock(), "")
    assert calls and not any(made)
    for args, options in calls:
        assert not {"n_trials", "selector_options", "population", "generations", "folds", "grid"} & set(options)
        assert not any(isinstance(a, dict) and a for a in args)
    if name == "experiment_study":
        assert [e.params for e in args[-1]] == [e.params for e in learning.jobs.standard_study()]


def learning_query(name):
    from wavetable.queries import QUERIES

    return QUERIES[name]


def test_epsilon_fit_without_the_whole_scatter(spark, informative, monkeypatch):
    x, y, _ = informative
    y = y + np.random.default_rng(1).normal(size=len(y))
    df = table(spark, x, y)

    def objective(model):
        w, b = model.array("coefficients"), model.value("intercept")
        return np.maximum(np.abs(y - x @ w - b) - 0.1, 0).sum() + 0.5 * w @ w

    whole = objective(regress.EpsilonRegressor(kernel="linear").fit(df))
    monkeypatch.setattr(moments, "MAX_DENSE_BYTES", 1)
    diagonal = objective(regress.EpsilonRegressor(kernel="linear").fit(df))
    assert diagonal == pytest.approx(whole, rel=1e-3)
