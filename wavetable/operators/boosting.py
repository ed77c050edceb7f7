"""Many boosted tree ensembles at once: gradients of all of them beside one binned table.

Boosters differ in their settings and held-out folds. A round adds one tree to each: of a broadcast table in one
task per booster, of a larger one by shared passes, of which a level of all trees of the round needs one. So the
jobs grow with rounds and depth, not with candidates. Fewer rounds are a prefix of a booster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wavetable.operators.trees import (
    FIELDS, NOISE, TREE, Binned, Forest, Rule, batches_of, grow_tree, histogram_splits, route, row_weights, spread, start_builders, train_part,
    tree_arrays, tree_bytes, tree_key,
)
from wavetable.session import durable

#: Rounds after which the scores of a large table are written anew.
REWRITE = 10


@dataclass(frozen=True)
class Boost:
    """One booster: the held-out fold (None: all rows), rounds, the rule of its trees and what a round sees."""

    fold: int | None
    rounds: int
    rule: Rule
    rate: float = 0.1
    share: float = 1.0
    seed: int = 42


def local_rounds(shared, boost: Boost, least: float):
    """(base, trees) of one booster on a broadcast table; tree values are scaled by the rate."""
    keys, t, x = train_part(shared, boost.fold)
    base = float(t.mean()) if len(t) else 0.0
    score, trees = np.full(len(t), base), []
    for tree in range(boost.rounds):
        key = tree_key(boost.seed, tree)
        w = row_weights(keys, key, boost.share)
        arrays = grow_tree(x, t - score, w, boost.rule, key, least)
        arrays["value"] = arrays["value"] * boost.rate
        score += arrays["value"][route(x, arrays)]
        trees.append(arrays)
    return base, trees


def grow_boosters(data: Binned, boosts: list[Boost]) -> list[tuple[float, Forest]]:
    """(base, trees) of every booster; a prediction is the base plus the sum of the trees' values."""
    if not data.local:
        return boost_by_levels(data, boosts)
    shared, least = data.shared, NOISE * data.variance

    def work(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                base, trees = local_rounds(shared.value, boosts[m], least)
                rows = [(-1, np.float64(base).tobytes()), *[(i, tree_bytes(a)) for i, a in enumerate(trees)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())],
                    names=["model", "tree", "arrays"],
                )

    found = spread(data.table.sparkSession, [(m,) for m in range(len(boosts))], "model int").mapInArrow(work, TREE).collect()
    parts = [{} for _ in boosts]
    for r in found:
        parts[r["model"]][r["tree"]] = r["arrays"]
    return [(float(np.frombuffer(p[-1], float)[0]), Forest.of([tree_arrays(p[i]) for i in range(len(p) - 1)])) for p in parts]


def score_boosters(data: Binned, boosts: list[Boost], stops: list[list[int]]) -> list[list[float]]:
    """Root mean squared error on the held-out fold after each number of rounds in ``stops``."""
    if not data.local:
        return [score_large(data, boost, mine, *grown) for boost, mine, grown in zip(boosts, stops, boost_by_levels(data, boosts))]
    shared, least = data.shared, NOISE * data.variance

    def work(batches):
        _, folds, t, x = shared.value
        for batch in batches:
            for m in batch.column(0).to_pylist():
                base, trees = local_rounds(shared.value, boosts[m], least)
                held = folds == boosts[m].fold
                rows, y = x[held], t[held]
                score, errors = np.full(len(y), base), {}
                for i, arrays in enumerate(trees, 1):
                    score += arrays["value"][route(rows, arrays)]
                    errors[i] = float(np.sqrt(np.mean((y - score) ** 2))) if len(y) else float("nan")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(stops[m]), pa.int32()), pa.array(stops[m], pa.int32()), pa.array([errors[n] for n in stops[m]])],
                    names=["model", "rounds", "rmse"],
                )

    found = spread(data.table.sparkSession, [(m,) for m in range(len(boosts))], "model int").mapInArrow(work, "model int, rounds int, rmse double").collect()
    known = {(r["model"], r["rounds"]): r["rmse"] for r in found}
    return [[known[m, n] for n in mine] for m, mine in enumerate(stops)]


def score_large(data: Binned, boost: Boost, stops: list[int], base: float, forest: Forest) -> list[float]:
    channels, mean = data.channels, data.mean

    def work(batches):
        totals, rows = np.zeros(len(stops)), 0
        for batch in batches:
            for _, x, y, _, _ in batches_of(batch, channels):
                score = base + np.cumsum(forest.predict(x), axis=1)
                totals += [((y - mean - score[:, n - 1]) ** 2).sum() for n in stops]
                rows += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(stops, pa.int32()), pa.array(totals), pa.array([rows] * len(stops))], names=["rounds", "error", "rows"])

    parts = data.table.filter(F.col("fold") == boost.fold).mapInArrow(work, "rounds int, error double, rows long")
    found = {r[0]: float(np.sqrt(r[1] / r[2])) if r[2] else float("nan") for r in parts.groupBy("rounds").agg(F.sum("error"), F.sum("rows")).collect()}
    return [found[n] for n in stops]


def boost_by_levels(data: Binned, boosts: list[Boost]) -> list[tuple[float, Forest]]:
    """Boosters of a table that no task can hold; all of them share the passes of a round."""
    count, channels, mean = len(boosts), data.channels, data.mean
    folds, rules = [b.fold for b in boosts], [b.rule for b in boosts]
    label = lambda part, m: part[2] - mean
    whole = start_builders(data, label, lambda keys, m: np.ones(len(keys)), folds, rules, [tree_key(b.seed, 0) for b in boosts])
    bases = [whole[m].sums[0] / whole[m].columns["weight"][0] if m in whole and whole[m].columns["weight"][0] else 0.0 for m in range(count)]
    state, recent, trees = data, [[] for _ in boosts], [[] for _ in boosts]

    def scores(part, m, recent):
        return (bases[m] if part[4] is None else part[4][:, m]) + sum(a["value"][route(part[1], a)] for a in recent[m])

    for tree in range(max(b.rounds for b in boosts)):
        live = [m for m in range(count) if boosts[m].rounds > tree]
        keys, shares, known = [tree_key(b.seed, tree) for b in boosts], [b.share for b in boosts], [list(r) for r in recent]
        targets = lambda part, m: part[2] - mean - scores(part, m, known)  # noqa: E731, B023
        weights = lambda row_keys, m: row_weights(row_keys, keys[m], shares[m])  # noqa: E731, B023
        builders = start_builders(state, targets, weights, folds, rules, keys)
        builders = {m: b for m, b in builders.items() if m in live}
        while wanted := {m: nodes for m, b in builders.items() if (nodes := b.wanted())}:
            histogram_splits(state, targets, weights, folds, builders, wanted)
            for m in builders:
                if not builders[m].advance():
                    builders[m].frontier = []
        for m, b in builders.items():
            while b.advance():  # leaf-wise trees may have offers left when no child can be split
                pass
            arrays = b.arrays()
            arrays["value"] = arrays["value"] * boosts[m].rate
            trees[m].append(arrays)
            recent[m].append({c: arrays[c] for c in ("feature", "bin", "left", "value")})
        if (tree + 1) % REWRITE == 0:
            state = Binned(rescored(state, scores, [list(r) for r in recent], count, channels), data.edges, data.rows, mean, data.variance)
            recent = [[] for _ in boosts]
    return [(bases[m], Forest.of([{c: t[c] for c in FIELDS} for t in trees[m]])) for m in range(count)]


def rescored(data: Binned, scores, recent, count: int, channels: int):
    """The binned table with the scores of all boosters so far."""

    def work(batches):
        for batch in batches:
            for part in batches_of(batch, channels):
                now = np.stack([scores(part, m, recent) + np.zeros(len(part[1])) for m in range(count)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[0]), pa.array(part[3]), pa.array(part[2]),
                        pa.array([r.tobytes() for r in part[1]], pa.binary()), pa.array([r.tobytes() for r in now], pa.binary()),
                    ],
                    names=["key", "fold", "label", "bins", "scores"],
                )

    return durable(data.table.mapInArrow(work, "key long, fold int, label double, bins binary, scores binary"))
