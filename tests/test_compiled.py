"""Trees grown in the JVM against those of NumPy, node for node."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from wavetable.operators import ensembles, regress, trees
from wavetable.operators.trees import Cut, Forest, Growth, Rule


def binned_rows(spark, n: int, channels: int, labels):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(n, channels)), 2)
    df = table(spark, x, labels(rng, x)).withColumn("fold", (F.col("row_id") % 4).cast("int"))
    return trees.binned(df, fold="fold")


@pytest.fixture(scope="module")
def data(spark):
    return binned_rows(spark, 3000, 6, lambda rng, x: rng.integers(0, 10, len(x)).astype(float))


def shape(tree, k=0):
    """A tree whatever the order of its nodes."""
    head = (int(tree["rows"][k]), float(tree["weight"][k]), int(tree["depth"][k]))
    if tree["left"][k] < 0:
        return head
    left = int(tree["left"][k])
    return (*head, int(tree["feature"][k]), int(tree["bin"][k]), shape(tree, left), shape(tree, left + 1))


def alone(forest: Forest):
    for a, b in zip(forest.roots[:-1], forest.roots[1:]):
        part = {name: c[a:b] for name, c in forest.nodes.items()}
        yield {**part, "left": np.where(part["left"] >= 0, part["left"] - a, -1)}


def expected(data, growth: Growth):
    part = trees.train_part(data.shared.value, growth.fold)
    return [trees.sibling_trees([growth], part, tree, trees.NOISE * data.variance)[0] for tree in range(growth.trees)]


def equal(found, wanted) -> None:
    assert [shape(a) for a in found] == [shape(b) for b in wanted]
    for a, b in zip(found, wanted):
        assert np.allclose(np.sort(a["value"]), np.sort(b["value"])) and np.allclose(np.sort(a["gain"]), np.sort(b["gain"]))


@pytest.mark.parametrize("rule", [Rule(), Rule(min_leaf=4), Rule(max_depth=5), Rule(min_split=40), Rule(node_channels=2), Rule(node_channels=2, min_leaf=30)])
@pytest.mark.parametrize("bootstrap", [True, False])
def test_trees_are_those_of_numpy(data, rule, bootstrap):
    for fold in (None, 2):
        growth = Growth(fold, 2, rule, bootstrap)
        equal(list(alone(trees.grow_forests(data, [growth])[0])), expected(data, growth))


@pytest.mark.parametrize("labels", [
    lambda rng, x: np.where(np.arange(len(x)) == 7, 1e9, np.round(10 * x[:, 0] + x[:, 1])),  # what is subtracted dwarfs the rest
    lambda rng, x: rng.normal(size=len(x)) * 1e-3 + x[:, 2] * x[:, 3],
    lambda rng, x: (x[:, 0] > 0) * 1.0,
])
def test_labels_of_any_size(spark, labels):
    data = binned_rows(spark, 2000, 5, labels)
    growth = Growth(1, 2, Rule())
    equal(list(alone(trees.grow_forests(data, [growth])[0])), expected(data, growth))


def test_narrow_and_wide_tables(spark):
    for n, channels in ((700, 1), (40, 300), (2, 3)):
        data = binned_rows(spark, n, channels, lambda rng, x: np.arange(len(x)) % 7 * 1.0)
        growth = Growth(None, 2, Rule())
        equal(list(alone(trees.grow_forests(data, [growth])[0])), expected(data, growth))


def test_grids_are_searched_and_walked_in_the_jvm(data, monkeypatch):
    """Siblings, depths, least rows and prefixes of one growth; NumPy searches no split and walks no tree."""
    growths = [Growth(fold, 12, Rule(min_leaf=leaf)) for fold in (0, 3) for leaf in (1, 2, 40)]
    cuts = [Cut(n, depth, split) for n in (3, 12) for depth in (None, 2, 6) for split in (2, 5, 200)]
    wanted = []
    keys, folds, t, x = data.shared.value
    for growth in growths:
        forest, held = Forest.of(expected(data, growth)), folds == growth.fold
        for c in cuts:
            first = Forest(forest.roots[: c.trees + 1], forest.nodes)
            wanted.append(np.sqrt(np.mean((first.predict(x[held], c.max_depth, c.min_split).mean(axis=1) - t[held]) ** 2)))

    def forbidden(*args):
        raise AssertionError("a split is searched or a tree is walked in Python")

    for name in ("best_splits", "best_of_histogram", "row_weights"):
        monkeypatch.setattr(trees, name, forbidden)
    monkeypatch.setattr(Forest, "predict_depths", forbidden)
    assert np.allclose(np.concatenate(trees.score_forests(data, growths, [cuts] * len(growths), block=5)), wanted, rtol=1e-12)
    params = [regress.model_params("rf", n_estimators=n, max_features=m) for n in (1, 2) for m in (None, 2)]
    assert len(ensembles.ensemble_errors(data, "rf", params, 4)) == 4


def test_rules_of_boosters_are_refused(data):
    with pytest.raises(ValueError, match="not a rule of a forest"):
        trees.grow_forests(data, [Growth(None, 1, Rule(smoothing=1.0))])


def test_a_study_grows_its_forests_in_the_jvm(spark, monkeypatch):
    from wavetable.plans import jobs

    def forbidden(*args):
        raise AssertionError("a split is searched in Python")

    monkeypatch.setattr(trees, "best_splits", forbidden)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    grids = {"rf": {"n_estimators": [2, 4], "min_samples_leaf": [1, 3]}}
    study = jobs.Study(table(spark, x, x[:, 0] + 0.1 * rng.normal(size=200)), grids=grids, folds=2)
    experiments = [jobs.Experiment("rf", "none", False, tuned=tuned, params={"n_estimators": 3}) for tuned in (True, False)]
    found = study.run(experiments).collect()
    assert [r["status"] for r in found] == ["ok", "ok"] and all(r["r2"] > 0.4 for r in found)
