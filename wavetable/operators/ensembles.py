"""Forests and boosters as estimators, and their candidates scored by cross-validation."""

from __future__ import annotations

from math import log2, sqrt

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from wavetable.functions.spectral import tree_score
from wavetable.operators.boosting import Boost, grow_boosters, score_boosters
from wavetable.operators.params import Settings, a_float, a_text, an_int, floats, ints
from wavetable.operators.trees import Binned, Cut, Growth, PackedForest, Rule, binned, fit_forests, score_forests


def channel_count(share, channels: int) -> int | None:
    """How many channels a node or tree may use: None for all, ``sqrt``, ``log2``, a share or a number."""
    if share is None or share == "all":
        return None
    if share in ("sqrt", "log2"):
        return max(1, int(sqrt(channels) if share == "sqrt" else log2(channels)))
    value = float(share)
    whole = isinstance(share, int) or (isinstance(share, str) and share.isdigit())
    if value <= 0 or (not whole and value > 1):
        raise ValueError(f"not a share of the channels: {share}")
    return min(channels, int(value)) if whole else None if value == 1 else max(1, int(value * channels))


def positive_depth(depth) -> int | None:
    if depth is not None and int(depth) < 1:
        raise ValueError(f"max_depth {depth}: a tree needs a level")
    return None if depth is None else int(depth)


def forest_growth(p: dict, channels: int) -> tuple[Growth, Cut]:
    """The widest growth that holds the forest of these parameters, and the cut that gives it."""
    if int(p["n_estimators"]) < 1 or int(p["min_samples_split"]) < 2 or int(p["min_samples_leaf"]) < 1:
        raise ValueError(f"a forest needs trees, splits of two rows and leaves of one: {p}")
    cut = Cut(int(p["n_estimators"]), positive_depth(p["max_depth"]), int(p["min_samples_split"]))
    rule = Rule(min_leaf=int(p["min_samples_leaf"]), node_channels=channel_count(p.get("max_features"), channels))
    return Growth(None, cut.trees, rule, bool(p.get("bootstrap", True)), int(p["random_state"])), cut


def boost_of(model_type: str, p: dict, channels: int) -> Boost:
    if int(p["n_estimators"]) < 1:
        raise ValueError("a booster needs a round")
    columns = channel_count(float(p.get("colsample_bytree", 1.0)), channels)
    if model_type == "xgb":
        rule = Rule(
            max_depth=positive_depth(p["max_depth"]), min_weight=float(p.get("min_child_weight", 1)), smoothing=float(p.get("reg_lambda", 1.0)),
            min_gain=float(p.get("gamma", 0.0)), tree_channels=columns,
        )
    else:
        depth = int(p["max_depth"])
        rule = Rule(
            max_depth=depth if depth > 0 else None, max_leaves=int(p["num_leaves"]), min_leaf=int(p.get("min_child_samples", 20)),
            smoothing=float(p.get("reg_lambda", 0.0)), tree_channels=columns,
        )
    return Boost(None, int(p["n_estimators"]), rule, float(p["learning_rate"]), float(p.get("subsample", 1.0)), int(p["random_state"]))


def ensemble_errors(data: Binned, model_type: str, candidates: list[dict], folds: int) -> list[list[float]]:
    """Held-out errors of every candidate, a fold each.

    Candidates that differ in trees, depth or ``min_samples_split`` alone are cuts of one forest for each fold, boosters
    that differ in rounds alone are prefixes of one.
    """
    where, groups = [], {}
    for p in candidates:
        grown, cut = forest_growth(p, data.channels) if model_type == "rf" else (b := boost_of(model_type, p, data.channels), b.rounds)
        size = {"trees": 0} if model_type == "rf" else {"rounds": 0}
        key = type(grown)(**{**grown.__dict__, **size})
        mine = groups.setdefault(key, [])
        if cut not in mine:
            mine.append(cut)
        where.append((key, mine.index(cut)))
    order, jobs, cuts = list(groups), [], []
    for key in order:
        for k in range(folds):
            cuts.append(groups[key])
            if model_type == "rf":
                depths, splits = [c.max_depth for c in groups[key]], [c.min_split for c in groups[key]]
                rule = Rule(**{**key.rule.__dict__, "max_depth": None if None in depths else max(depths), "min_split": min(splits)})
                jobs.append(Growth(k, max(c.trees for c in groups[key]), rule, key.bootstrap, key.seed))
            else:
                jobs.append(Boost(**{**key.__dict__, "fold": k, "rounds": max(groups[key])}))
    found = (score_forests if model_type == "rf" else score_boosters)(data, jobs, cuts)
    return [[found[order.index(key) * folds + k][i] for k in range(folds)] for key, i in where]


class TreeEnsemble(Estimator, Settings):
    """Forest (``kind="rf"``) or booster (``xgb``, ``lgbm``) with the parameters of the usual Python toolkits.

    A node's rows, which ``min_samples_split`` and ``min_samples_leaf`` count, are the different rows that its tree has
    drawn. ``xgb`` splits level by level, ``lgbm`` the leaf with the largest gain first.
    """

    kind = a_text("kind")
    rowIdCol = a_text("rowIdCol")
    settings = a_text("settings", "parameters as JSON")
    DEFAULTS = {"kind": "rf", "rowIdCol": "row_id", "settings": "{}", "outputCol": "prediction"}

    def params_given(self) -> dict:
        import json

        return json.loads(self.value("settings"))

    def _fit(self, df):
        p, kind = self.params_given(), self.value("kind")
        data = binned(df, self.spectrum, self.label, self.value("rowIdCol"))
        if kind == "rf":
            growth, cut = forest_growth(p, data.channels)
            rule = Rule(**{**growth.rule.__dict__, "max_depth": cut.max_depth, "min_split": cut.min_split})
            forest, base = fit_forests(data, [Growth(None, cut.trees, rule, growth.bootstrap, growth.seed)])[0], data.mean
            scale = 1.0 / len(forest)
        else:
            base, forest = grow_boosters(data, [boost_of(kind, p, data.channels)])[0]
            base, forest, scale = base + data.mean, forest.packed(data.channels), 1.0
        return self._copyValues(
            TreeEnsembleModel(base=base, scale=scale, forest=forest.encoded(), edges=np.concatenate(data.edges), bins=[len(e) for e in data.edges])
        )


class TreeEnsembleModel(Model, Settings):
    kind = a_text("kind")
    rowIdCol = a_text("rowIdCol")
    settings = a_text("settings")
    base = a_float("base")
    scale = a_float("scale", "weight of a tree's value")
    forest = a_text("forest", "encoded trees")
    edges = floats("edges", "edges of all channels' bins")
    bins = ints("bins", "number of edges of each channel")
    DEFAULTS = {"outputCol": "prediction"}

    def _transform(self, df):
        bounds = np.cumsum([0, *self.value("bins")])
        edges = [self.array("edges")[a:b] for a, b in zip(bounds, bounds[1:])]
        column = F.col(self.spectrum).cast("array<double>")
        return df.withColumn(self.output, tree_score(column, PackedForest.decoded(self.value("forest")), edges, self.value("base"), self.value("scale")))

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(PackedForest.decoded(self.value("forest")).importances(len(self.value("bins"))))
