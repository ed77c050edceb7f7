"""Growth of whole trees in bounded memory, many nodes at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from wavetable.operators import trees
from wavetable.operators.trees import Forest, Rule


def rows_of(n: int, channels: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 200, size=(n, channels)).astype(np.uint8)
    t = rng.integers(0, 10, n) - 4.0
    return x, t, trees.row_weights(np.arange(n), trees.tree_key(42, 0), None)


@pytest.mark.parametrize("rule", [Rule(), Rule(min_leaf=4), Rule(max_depth=4, min_weight=2.0, smoothing=1.0, tree_channels=3), Rule(node_channels=2), Rule(max_leaves=40, min_leaf=3)])
def test_trees_do_not_depend_on_how_nodes_are_searched(monkeypatch, rule):
    x, t, w = rows_of(900, 5)
    found = []
    for few, rows, channels in ((256, 2048, 64), (0, 100, 2), (1000, 1000, 1)):
        for name, value in (("FEW", few), ("ROWS_AT_ONCE", rows), ("CHANNELS_AT_ONCE", channels)):
            monkeypatch.setattr(trees, name, value)
        found.append(trees.grow_tree(x, t, w, rule, trees.tree_key(42, 0), 1e-9))
    for other in found[1:]:
        assert all(np.allclose(other[c], found[0][c], atol=1e-9) for c in found[0])


def test_a_level_is_searched_at_once(monkeypatch):
    x, t, w = rows_of(3000, 4)
    calls, plain = [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda *a: (calls.append(1), plain(*a))[1])
    tree = trees.grow_tree(x, t, w, Rule(), trees.tree_key(42, 0), 1e-9)
    assert len(tree["left"]) > 1000 and len(calls) <= tree["depth"].max() + 1


@pytest.mark.parametrize("given", [{}, {"max_depth": 5}, {"node_channels": 2}, {"min_split": 9, "min_weight": 3.0}, {"max_leaves": 20}])
def test_siblings_are_the_trees_grown_alone(given):
    x, t, w = rows_of(900, 5)
    rules = [Rule(min_leaf=leaf, **given) for leaf in (1, 2, 4, 30)]
    together = trees.grow_siblings(x, t, w, rules, trees.tree_key(42, 0), 1e-9)
    for rule, found in zip(rules, together):
        alone = trees.grow_tree(x, t, w, rule, trees.tree_key(42, 0), 1e-9)
        assert all(np.allclose(alone[c], found[c], atol=1e-9) for c in alone)
        inner = np.flatnonzero(found["left"] >= 0)
        assert len(inner) and all((found["rows"][found["left"][inner] + side] >= rule.min_leaf).all() for side in (0, 1))


def test_siblings_share_their_searches(monkeypatch):
    x, t, w = rows_of(3000, 4)
    searched, plain = [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda *a: (searched.append(len(a[1])), plain(*a))[1])
    rules = [Rule(min_leaf=leaf) for leaf in (1, 2, 4)]
    for rule in rules:
        trees.grow_tree(x, t, w, rule, trees.tree_key(42, 0), 1e-9)
    alone = sum(searched)
    searched.clear()
    trees.grow_siblings(x, t, w, rules, trees.tree_key(42, 0), 1e-9)
    assert sum(searched) < 0.6 * alone


def test_forests_of_a_grid_are_siblings_by_their_leaves():
    growths = [trees.Growth(fold, 3, Rule(min_leaf=leaf)) for leaf in (4, 1, 2) for fold in (0, 1)]
    assert trees.siblings([*growths, trees.Growth(0, 4, Rule())]) == [[2, 4, 0], [3, 5, 1], [6]]


def test_one_walk_gives_all_depths():
    x, t, w = rows_of(500, 4)
    forest = Forest.of([trees.grow_tree(x, t, w, Rule(), trees.tree_key(42, k), 1e-9) for k in range(3)])
    for split in (2, 9):
        found = forest.predict_depths(x, [None, 2, 5, 99], split)
        assert all((found[depth] == forest.predict(x, depth, split)).all() for depth in (None, 2, 5, 99))


@pytest.mark.parametrize("rule", [Rule(), Rule(max_leaves=31, min_leaf=20)])
def test_growth_needs_few_bytes_beside_the_table(rule):
    peaks = []
    for n in (10_000, 20_000):
        x, t, w = rows_of(n, 64)
        tracemalloc.start()
        trees.grow_tree(x, t, w, rule, trees.tree_key(42, 0), 1e-9)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 32 << 20 and peaks[1] - peaks[0] < 500 * 10_000


def test_packed_forests_say_what_whole_ones_say(monkeypatch):
    x, t, w = rows_of(2000, 6)
    grown = [trees.grow_tree(x, t, w, rule, trees.tree_key(42, k), 1e-9) for k, rule in enumerate((Rule(), Rule(max_leaves=30), Rule(min_leaf=3000)))]
    forest = Forest.of(grown)
    packed = trees.PackedForest.decoded(forest.packed(6).encoded())
    assert packed.trees == [trees.packed_tree(t, 6) for t in grown]
    expected = forest.predict(x).sum(axis=1)
    assert np.allclose(packed.total(x), expected, atol=1e-12) and "kept" in vars(packed)
    assert np.allclose(packed.total(x), expected, atol=1e-12)
    monkeypatch.setattr(trees, "UNPACKED_BYTES", 10)
    large = forest.packed(6)
    assert np.allclose(large.total(x), expected, atol=1e-12) and "kept" not in vars(large)
    shares = [np.bincount(t["feature"][t["left"] >= 0], t["gain"][t["left"] >= 0], 6) for t in grown[:2]]
    assert np.allclose(packed.importances(6), np.mean([s / s.sum() for s in shares], axis=0))


def test_a_fitted_forest_is_small_on_the_driver(spark):
    from conftest import table

    from wavetable.operators import regress

    rng = np.random.default_rng(3)
    model = regress.train_model(table(spark, rng.normal(size=(1500, 4)), rng.integers(0, 10, 1500).astype(float)), "rf", {"n_estimators": 20})
    text = model.stages[-1].value("forest")
    nodes = sum(len(splits) for splits, *_ in trees.PackedForest.decoded(text).unpacked())
    assert nodes > 20_000 and len(text) < 8 * nodes


def test_a_leafwise_tree_searches_no_node_in_vain(monkeypatch):
    x, t, w = rows_of(3000, 4)
    searched, plain = [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda *a: (searched.append(len(a[2])), plain(*a))[1])
    trees.grow_tree(x, t, w, Rule(max_leaves=8), trees.tree_key(42, 0), 1e-9)
    assert sum(searched) == 13  # the root and all children but those of the last split
