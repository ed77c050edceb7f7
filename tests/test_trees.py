"""Forests and boosters: cuts and prefixes against forests grown alone, shared passes against whole trees, splits against all splits."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from wavetable.operators import boosting, ensembles, regress, search, trees
from wavetable.operators.trees import Cut, Forest, Growth, Rule


@pytest.fixture(scope="module")
def whole(spark):
    """128 rows of few values a channel and whole labels, so that sums have no rounding; 40 folds of them."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, size=(128, 5)).astype(float)
    y = np.round(x[:, 0] * 2 - x[:, 1] + rng.integers(0, 3, 128))
    y[0] += 128 * 8 - y.sum() % (128 * 8)  # the mean is whole as well
    df = table(spark, x, y).withColumn("fold", (F.col("row_id") % 4).cast("int"))
    return x, y, df


@pytest.fixture(scope="module")
def data(whole):
    return trees.binned(whole[2], fold="fold")


def same(a: Forest, b: Forest) -> bool:
    """Equal trees, whatever the order of their nodes."""

    def shape(f, k):
        n = f.nodes
        head = (int(n["rows"][k]), round(float(n["value"][k]), 9), int(n["depth"][k]))
        if n["left"][k] < 0:
            return head
        return (*head, int(n["feature"][k]), int(n["bin"][k]), shape(f, n["left"][k]), shape(f, n["left"][k] + 1))

    return [shape(a, k) for k in a.roots[:-1]] == [shape(b, k) for k in b.roots[:-1]]


def test_edges_lie_between_values():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    edges = trees.edges_of(x)
    assert [e.tolist() for e in edges] == [[1.5, 3.0], []]
    assert trees.to_bins(x, edges).tolist() == [[0, 0], [1, 0], [2, 0]]
    many = trees.edges_of(np.random.default_rng(0).normal(size=(5000, 1)))[0]
    assert len(many) <= 255 and (np.diff(many) > 0).all()


@pytest.mark.parametrize("leaf,weight,smoothing", [(1, 0.0, 0.0), (5, 0.0, 0.0), (1, 20.0, 1.0)])
def test_split_is_the_best_of_all(leaf, weight, smoothing):
    rng = np.random.default_rng(leaf)
    x = rng.integers(0, 12, size=(4, 60)).astype(np.uint8)
    t, w = rng.normal(size=60), rng.integers(1, 3, 60).astype(float)
    rule = Rule(min_leaf=leaf, min_weight=weight, smoothing=smoothing)
    best = None
    for f in range(4):
        for b in range(12):
            left = x[f] <= b
            if min(left.sum(), (~left).sum()) < leaf or min(w[left].sum(), w[~left].sum()) < max(weight, 1e-9):
                continue
            score = lambda part: (w * t)[part].sum() ** 2 / (w[part].sum() + smoothing)
            gain = score(left) + score(~left) - score(np.ones(60, bool))
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, b)
    found = next(trees.best_of_sorted(x, trees.sorted_by_bin(x), np.zeros(60, np.uint8), np.array([0]), t, w, rule, None))
    cells = np.zeros((3, 4, 256))
    for f in range(4):
        for k, values in enumerate((np.ones(60), w, w * t)):
            cells[k, f] = np.bincount(x[f], values, 256)
    histogram = trees.best_of_histogram(cells, rule, None)
    assert found[2] == histogram[1] == best[1]
    assert found[1] == pytest.approx(best[0]) and histogram[0] == pytest.approx(best[0])
    assert (x[best[1]] <= found[3]).sum() == (x[best[1]] <= best[2]).sum() == (x[best[1]] <= histogram[2]).sum()


def test_draws_follow_rows_and_trees():
    keys = np.arange(50_000)
    w = trees.row_weights(keys, trees.tree_key(42, 0), None)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
    assert (trees.row_weights(keys[::-1], trees.tree_key(42, 0), None)[::-1] == w).all()
    assert (trees.row_weights(keys, trees.tree_key(42, 1), None) != w).any()
    assert trees.row_weights(keys, trees.tree_key(1, 1), 0.3).mean() == pytest.approx(0.3, abs=0.01)
    assert (trees.drawn_channels(np.arange(20, dtype=np.uint64), 10, 3).sum(axis=1) == 3).all()


def test_one_full_tree_learns_every_row(whole, data):
    x, y, _ = whole
    forest = trees.grow_forests(data, [Growth(None, 1, Rule(), bootstrap=False)])[0]
    found = forest.predict(trees.to_bins(x, data.edges))[:, 0] + data.mean
    groups = {}
    for row, value in zip(map(tuple, x), y):
        groups.setdefault(row, []).append(value)
    assert np.allclose(found, [np.mean(groups[tuple(row)]) for row in x])


@pytest.mark.parametrize("rule", [Rule(), Rule(min_leaf=3), Rule(max_depth=3), Rule(node_channels=2), Rule(min_split=9)])
def test_growth_by_levels_equals_whole_trees(data, monkeypatch, rule):
    growths = [Growth(None, 3, rule), Growth(1, 3, rule)]
    alone = trees.grow_forests(data, growths)
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    monkeypatch.setattr(trees, "SMALL", 20)
    assert all(same(a, b) for a, b in zip(alone, trees.grow_forests(data, growths)))


def test_prefixes_and_cuts_equal_forests_grown_alone(whole, data):
    x, _, _ = whole
    rows = trees.to_bins(x, data.edges)
    widest = trees.grow_forests(data, [Growth(0, 12, Rule(min_leaf=2))], block=5)[0]
    for count, depth, split in ((4, None, 2), (12, 2, 2), (7, 4, 10), (12, None, 25)):
        alone = trees.grow_forests(data, [Growth(0, count, Rule(depth, split, 2))])[0]
        first = Forest(widest.roots[: count + 1], widest.nodes)
        assert np.allclose(first.predict(rows, depth, split), alone.predict(rows), atol=1e-12)
        assert alone.nodes["depth"].max() <= (depth or 99)


def test_grid_scores_equal_scores_of_single_forests(whole, data, monkeypatch):
    candidates = search.expand({"n_estimators": [3, 12, 14], "max_depth": [None, 3], "min_samples_split": [2, 11], "min_samples_leaf": [1, 4]})
    params = [regress.model_params("rf", **c) for c in candidates]
    errors = ensembles.ensemble_errors(data, "rf", params, 4)
    assert len({tuple(np.round(e, 12)) for e in errors}) == len(candidates)  # no two points are the same forests
    x, y, _ = whole
    fold = np.arange(128) % 4
    for k in (0, 7, 23):
        p = params[k]
        for held in range(4):
            rule = Rule(p["max_depth"], p["min_samples_split"], p["min_samples_leaf"])
            forest = trees.grow_forests(data, [Growth(held, p["n_estimators"], rule)])[0]
            found = forest.predict(trees.to_bins(x[fold == held], data.edges)).mean(axis=1) + data.mean
            assert errors[k][held] == pytest.approx(np.sqrt(np.mean((found - y[fold == held]) ** 2)))
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    monkeypatch.setattr(trees, "SMALL", 25)
    few = [0, 9, 14]
    assert np.allclose(ensembles.ensemble_errors(data, "rf", [params[k] for k in few], 4), [errors[k] for k in few])


@pytest.mark.parametrize("kind,given", [
    ("xgb", {"n_estimators": 4, "gamma": 0.5}), ("xgb", {"n_estimators": 12, "max_depth": 2, "subsample": 1.0, "colsample_bytree": 1.0}),
    ("lgbm", {"n_estimators": 3, "num_leaves": 6, "min_child_samples": 5}),
])
def test_boosting_by_shared_passes_equals_single_tasks(whole, data, monkeypatch, kind, given):
    params = [regress.model_params(kind, **given), regress.model_params(kind, **{**given, "learning_rate": 0.3})]
    boosts = [ensembles.boost_of(kind, p, 5) for p in params]
    x = trees.to_bins(whole[0], data.edges)
    errors = ensembles.ensemble_errors(data, kind, params, 2)
    predict = lambda grown: [base + forest.predict(x).sum(axis=1) for base, forest in grown]
    alone = predict(boosting.grow_boosters(data, boosts))
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    assert np.allclose(alone, predict(boosting.grow_boosters(data, boosts)), atol=1e-6)
    assert np.allclose(errors, ensembles.ensemble_errors(data, kind, params, 2), atol=1e-6)


def test_one_boosting_round_by_hand(whole, data):
    x, y, _ = whole
    rule = Rule(max_depth=1, min_weight=1.0, smoothing=1.0)
    base, forest = boosting.grow_boosters(data, [boosting.Boost(None, 1, rule, rate=0.5)])[0]
    residual, best = y - y.mean(), None
    for f in range(5):
        for value in range(8):
            left = x[:, f] <= value
            gain = sum(residual[part].sum() ** 2 / (part.sum() + 1) for part in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, left)
    expected = y.mean() + 0.5 * np.where(best[1], *[residual[part].sum() / (part.sum() + 1) for part in (best[1], ~best[1])])
    assert np.allclose(base + data.mean + forest.predict(trees.to_bins(x, data.edges))[:, 0], expected)


def test_leafwise_trees_have_at_most_their_leaves(data):
    rule = Rule(max_leaves=5)
    _, forest = boosting.grow_boosters(data, [boosting.Boost(None, 3, rule)])[0]
    leaves = [int((forest.nodes["left"][a:b] < 0).sum()) for a, b in zip(forest.roots, forest.roots[1:])]
    assert leaves == [5, 5, 5]


def test_small_forests_reject_wrong_settings():
    for wrong in ({"max_depth": 0}, {"min_samples_split": 1}, {"n_estimators": 0}, {"max_features": 1.5}):
        with pytest.raises(ValueError):
            regress.create_model("rf", **wrong)
    assert [ensembles.channel_count(s, 100) for s in (None, "sqrt", "log2", 0.25, 7, "7", 1.0)] == [None, 10, 6, 25, 7, 7, None]


def test_rows_without_spectrum_or_label_are_left_out(spark):
    rows = [(1, [1.0, 2.0], 1.0), (2, None, 3.0), (3, [2.0, 1.0], None), (4, [3.0, 0.0], 5.0), (None, [4.0, 0.0], 5.0)]
    df = spark.createDataFrame(rows, "row_id long, spectrum array<double>, label double")
    model = regress.train_model(df, "rf", {"n_estimators": 3, "bootstrap": False})
    found = {r["row_id"]: r["prediction"] for r in model.transform(df).collect()}
    assert found[2] is None and found[1] == pytest.approx(1.0) and found[4] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        regress.train_model(df.filter("label is null"), "rf")


def test_adaptive_search_runs_rounds_together_and_goes_on(spark, whole, tmp_path, monkeypatch):
    rounds = []
    plain = search.Scorer.trials

    def counted(self, candidates, stop=None):
        rounds.append(len(candidates))
        return plain(self, candidates, stop)

    monkeypatch.setattr(search.Scorer, "trials", counted)
    space = {"n_estimators": search.Range(1, 9, whole=True), "max_depth": search.Choice((2, 0)), "min_samples_leaf": search.Range(1, 6, whole=True)}
    options = {"folds": 2, "startup": 4, "batch": 3, "refit": False}
    whole_run = search.adaptive_search(whole[2], "rf", space, n_trials=9, **options)
    assert rounds == [4, 3, 2]
    failed = [m for (_, state, p), m in zip(whole_run.trials, whole_run.messages) if state == "failed"]
    assert failed and all("max_depth 0" in m for m in failed)
    path = str(tmp_path / "ledger")
    search.adaptive_search(whole[2], "rf", space, n_trials=4, ledger=path, **options)
    again = search.adaptive_search(whole[2], "rf", space, n_trials=9, ledger=path, **options)
    assert rounds[3:] == [4, 3, 2] and again.trials == whole_run.trials
    rows = spark.read.parquet(path).collect()
    assert sorted(r["trial"] for r in rows) == list(range(9)) and {r["state"] for r in rows} == {"complete", "failed"}


def test_search_measures_the_best_on_validation_rows(whole):
    held = F.col("row_id") % 3 == 0
    found = search.grid_search(whole[2].filter(~held), "rf", {"n_estimators": [5]}, validation=whole[2].filter(held))
    assert found.model is not None and set(found.validation) == {"rmse", "mae", "r2", "explained_variance"}
    assert found.validation["rmse"] != -found.best_score


def test_lost_session_is_no_bad_candidate(whole, monkeypatch):
    monkeypatch.setattr(search.Scorer, "_fold_score", lambda self, c, k: (_ for _ in ()).throw(ConnectionError("gone")))
    with pytest.raises(ConnectionError):
        search.cv_score(whole[2], "svr", {"kernel": "linear"})


def test_genetic_search_by_a_given_estimator(whole):
    from wavetable.operators.latent import PLSRegressor
    from wavetable.operators.select import GeneticSelector

    calls = []

    class Counted(PLSRegressor):
        def _fit(self, df):
            calls.append(1)
            return super()._fit(df)

    chooser = GeneticSelector(Counted(nComponents=1), nFeatures=2, population=4, generations=2, folds=2)
    masks = np.array([[1, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0]], bool)
    scores = chooser.score_masks(whole[2], masks)
    assert len(calls) == 4 and scores[0] == scores[1] > scores[2] > scores[3] == -np.inf
    assert 0 in chooser.fit(whole[2]).value("channels")


def test_study_shares_work_and_uses_the_given_estimator(spark, whole, monkeypatch):
    from wavetable.operators.latent import PLSRegressor
    from wavetable.plans import jobs

    made, fitted = [], []
    plain = jobs.moment_source
    monkeypatch.setattr(jobs, "moment_source", lambda *a, **k: (made.append(1), plain(*a, **k))[1])

    class Mine(PLSRegressor):
        def _fit(self, df):
            fitted.append(1)
            return super()._fit(df)

    experiments = [jobs.Experiment("pls", "none", False, selection="vip", n_features=k, params={"n_components": 1}) for k in (1, 2, 3)]
    experiments += [jobs.Experiment("rf", "none", False, params={"n_estimators": 3}), jobs.Experiment("rf", "none", False, params={"n_estimators": 0})]
    experiments += [jobs.Experiment("pls", "none", False, selection="ga", n_features=2, params={"n_components": 1})]
    study = jobs.Study(whole[2].drop("fold"), selectors={"ga": {"estimator": Mine(nComponents=1), "population": 3, "generations": 1, "folds": 2}})
    rows = {(r["experiment"], r["n_features"], r["status"]): r for r in study.run(experiments).collect()}
    assert len(rows) == 6 and len(made) == 1 and fitted
    failed = [r for r in rows.values() if r["status"] == "failed"]
    assert len(failed) == 1 and "needs trees" in failed[0]["message"]
