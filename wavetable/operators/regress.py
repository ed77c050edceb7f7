"""Regressors by name, with the parameter names and defaults of the usual Python toolkits."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.spectral import random_features
from wavetable.operators.ensembles import TreeEnsemble, boost_of, forest_growth
from wavetable.operators.latent import LinearSpectralModel, PLSRegressor
from wavetable.operators.moments import Moments, dense_fits, first_moments, inputs, lot, moments, provisional_shift, rows_of
from wavetable.operators.params import Settings, a_float, a_text, an_int, floats
from wavetable.session import durable

# Default parameters per model type.
DEFAULTS = {
    "pls": {"n_components": 10, "scale": False, "max_iter": 500, "tol": 1e-6},
    "svr": {"kernel": "rbf", "C": 1.0, "epsilon": 0.1, "gamma": "scale"},
    "rf": {
        "n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "random_state": 42,
    },
    "xgb": {
        "n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8,
        "random_state": 42,
    },
    "lgbm": {
        "n_estimators": 100, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31, "random_state": 42,
    },
    "elasticnet": {"alpha": 1.0, "l1_ratio": 0.5, "max_iter": 1000, "random_state": 42},
}


def model_params(model_type: str, **given) -> dict:
    """Defaults of the type with ``given`` on top."""
    if model_type not in DEFAULTS:
        raise ValueError(f"unknown model type: {model_type}")
    return {**DEFAULTS[model_type], **given}


def create_model(model_type: str, spectrum: str = "spectrum", label: str = "label", **given) -> Estimator:
    """Estimator for ``pls``, ``elasticnet``, ``svr``, ``rf``, ``xgb`` or ``lgbm``; always a Pipeline."""
    p = model_params(model_type, **given)
    columns = {"spectrumCol": spectrum, "labelCol": label}
    if model_type == "pls":
        return Pipeline(stages=[PLSRegressor(nComponents=int(p["n_components"]), scale=bool(p["scale"]), **columns)])
    if model_type == "elasticnet":
        return Pipeline(
            stages=[ElasticNet(alpha=float(p["alpha"]), l1Ratio=float(p["l1_ratio"]), maxIter=int(p["max_iter"]), **columns)]
        )
    if model_type == "svr":
        return Pipeline(
            stages=[
                EpsilonRegressor(
                    kernel=p["kernel"], c=float(p["C"]), epsilon=float(p["epsilon"]), gamma=str(p["gamma"]), **columns
                )
            ]
        )
    return Pipeline(stages=[TreeEnsemble(kind=model_type, settings=json.dumps(checked_trees(model_type, p)), **columns)])


def checked_trees(model_type: str, p: dict) -> dict:
    """The parameters, or an error before anything is read."""
    forest_growth(p, 1) if model_type == "rf" else boost_of(model_type, p, 1)
    return p


def train_model(df: DataFrame, model_type: str = "rf", params: dict | None = None, spectrum="spectrum", label="label"):
    return create_model(model_type, spectrum, label, **(params or {})).fit(df)


def feature_importances(model, spark, names=None) -> DataFrame:
    """``(channel, name, importance)`` of a fitted tree model; every channel appears."""
    learner = model.stages[-1] if hasattr(model, "stages") else model
    values = learner.featureImportances.toArray()
    names = names or [f"feature_{i}" for i in range(len(values))]
    rows = [(i, str(names[i]), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "channel int, name string, importance double")


class ElasticNet(Estimator, Settings):
    """Least squares with L1 and L2 penalty: ``1/2n |r|^2 + a l1 |w| + a (1 - l1)/2 |w|^2``.

    Solved on the moment table. ``fit_elastic_net_wide`` is the way for tables too wide for it.
    """

    alpha = a_float("alpha")
    l1Ratio = a_float("l1Ratio")
    maxIter = an_int("maxIter")
    tol = a_float("tol")
    DEFAULTS = {"alpha": 1.0, "l1Ratio": 0.5, "maxIter": 1000, "tol": 1e-10, "outputCol": "prediction"}

    def _fit(self, df):
        shift = provisional_shift(df, self.spectrum, self.label)
        if not dense_fits(len(shift) - 1):
            fit = fit_elastic_net_wide(
                df, self.value("alpha"), self.value("l1Ratio"), self.spectrum, self.label, self.value("maxIter"), self.value("tol")
            )
            return self._copyValues(LinearSpectralModel(coefficients=fit[0], intercept=fit[1]))
        m = moments(df, self.spectrum, self.label, shift)
        w, b = elastic_net(m, self.value("alpha"), self.value("l1Ratio"), self.value("maxIter"), self.value("tol"))
        return self._copyValues(LinearSpectralModel(coefficients=w, intercept=b))


def elastic_net(m: Moments, alpha: float, l1_ratio: float, max_iter: int = 1000, tol: float = 1e-10):
    """Coordinate descent on the covariance; returns coefficients and intercept."""
    covariance = m.scatter / m.n
    inner, cross = covariance[:-1, :-1], covariance[:-1, -1]
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(m.channels)
    image = np.zeros(m.channels)
    for _ in range(max_iter):
        largest = 0.0
        for j in range(m.channels):
            if inner[j, j] <= 0:
                continue
            pull = cross[j] - image[j] + inner[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (inner[j, j] + l2)
            step = new - w[j]
            if step:
                image += inner[:, j] * step
                w[j] = new
                largest = max(largest, abs(step))
        if largest <= tol * max(1.0, np.abs(w).max()):
            break
    return w, float(m.label_mean - w @ m.mean)


def fit_elastic_net_wide(df: DataFrame, alpha: float, l1_ratio: float, spectrum="spectrum", label="label", max_iter: int = 1000, tol: float = 1e-10):
    """The same objective with Spark's solver, which scales the label: penalties are rescaled for it."""
    level = df.agg(F.stddev_samp(label).alias("s")).first()["s"]
    l1, l2 = alpha * l1_ratio / level, alpha * (1 - l1_ratio)
    total = l1 + l2
    data = df.select(
        array_to_vector(F.col(spectrum).cast("array<double>")).alias("features"), (F.col(label) / level).alias("label")
    )
    solver = LinearRegression(
        standardization=False, regParam=total, elasticNetParam=l1 / total if total else 0.0, maxIter=max_iter, tol=tol
    )
    fit = solver.fit(data)
    return fit.coefficients.toArray() * level, fit.intercept * level


class EpsilonRegressor(Estimator, Settings):
    """Support-vector style regression: ``1/2 |w|^2 + C sum max(0, |y - f(x)| - epsilon)``.

    ``linear`` works on the spectrum, ``rbf`` on random Fourier features of it. Rows are written once with
    ``checkpoint()``; every quasi-Newton step is one aggregation pass over them, see ``epsilon_fit``.
    """

    kernel = a_text("kernel")
    c = a_float("c")
    epsilon = a_float("epsilon")
    gamma = a_text("gamma", "scale, auto or a number")
    nFeatures = an_int("nFeatures", "random features of the rbf kernel")
    maxIter = an_int("maxIter", "most quasi-Newton steps")
    seed = an_int("seed")
    DEFAULTS = {
        "kernel": "rbf", "c": 1.0, "epsilon": 0.1, "gamma": "scale", "nFeatures": 256, "maxIter": 200, "seed": 42,
        "outputCol": "prediction",
    }

    def _fit(self, df):
        kernel = self.value("kernel")
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"unsupported kernel: {kernel}")
        directions = phases = None
        data = durable(df.select(
            F.col(self.spectrum).cast("array<double>").alias("spectrum"), F.col(self.label).cast("double").alias("label")
        ))
        if kernel == "rbf":
            directions, phases = self._features(data)
            data = data.withColumn("spectrum", random_features("spectrum", directions, phases))
        w, b = epsilon_fit(data, self.value("c"), self.value("epsilon"), self.value("maxIter"))
        extra = {} if directions is None else {"directions": directions, "phases": phases}
        return self._copyValues(EpsilonModel(coefficients=w, intercept=b, **extra))

    def _features(self, df):
        summary = _block_variance(df)
        p, variance = summary
        text = self.value("gamma")
        if text == "scale":
            gamma = 1.0 / (p * variance) if variance > 0 else 1.0
        else:
            gamma = 1.0 / p if text == "auto" else float(text)
        rng = np.random.default_rng(self.value("seed"))
        size = self.value("nFeatures")
        return rng.normal(0.0, np.sqrt(2 * gamma), (p, size)), rng.uniform(0, 2 * np.pi, size)


def _block_variance(df):
    """Channel count and the variance over all values of all channels."""
    from wavetable.operators.stats import channel_stats

    _, mean, std = channel_stats(df)
    return len(mean), float((std**2).mean() + mean.var())


class EpsilonModel(Model, Settings):
    kernel = a_text("kernel")
    c = a_float("c")
    epsilon = a_float("epsilon")
    gamma = a_text("gamma")
    nFeatures = an_int("nFeatures")
    maxIter = an_int("maxIter")
    seed = an_int("seed")
    coefficients = floats("coefficients")
    intercept = a_float("intercept")
    directions = floats("directions")
    phases = floats("phases")
    DEFAULTS = {"outputCol": "prediction"}

    def _transform(self, df):
        from wavetable.functions.spectral import linear_score

        column = F.col(self.spectrum).cast("array<double>")
        if self.value("phases"):
            phases = self.array("phases")
            column = random_features(column, self.array("directions").reshape(-1, len(phases)), phases)
        return df.withColumn(self.output, linear_score(column, self.array("coefficients"), self.value("intercept")))


#: Width of the smoothed corner of the loss, in standard deviations of the label.
CORNER = 0.01
#: Step lengths that one pass tries.
LENGTHS = np.array([2.0, 1.0, 0.5, 0.2, 0.05, 0.01])
#: Past steps that the quasi-Newton direction knows, and the smallest share of rows that the curvature is taken from.
MEMORY, SHARE = 30, 0.02


def epsilon_fit(data: DataFrame, c: float, epsilon: float, passes: int = 200, tol: float = 1e-5):
    """Coefficients and intercept of the epsilon-insensitive fit on ``(spectrum, label)``.

    Limited-memory quasi-Newton steps on the loss with a smoothed corner, in the metric of the rows' moments. Every
    step is one pass, which has the loss and slope of all step lengths; a pass moves O(channels) numbers.
    """
    shift, n, spread, cross, turn, back, scale = _metric(data)
    p = len(shift) - 1
    # with the diagonal alone some steps are small on the way
    patience = small = 1 if dense_fits(p) else 6
    width = max(CORNER * spread, 1e-6)
    ridge = np.concatenate([[0.0], np.ones(p)])

    def judged(thetas):
        losses, shares, slopes = _epsilon_pass(data, shift, np.array(thetas).T, epsilon, width)
        return [(c * x + 0.5 * t[1:] @ t[1:], c * g + ridge * t, a / n) for t, x, a, g in zip(thetas, losses, shares, slopes)]

    def best_of(thetas):
        found = judged(thetas)
        least = min(range(len(found)), key=lambda k: found[k][0])
        return thetas[least], *found[least]

    # the label's mean alone, and squared-error fits of several strengths
    starts = [back(turn(cross) * k / (scale * k + 1.0)) for k in c * np.array([0.0, 0.1, 1.0, 10.0, 100.0])]
    theta, value, slope, share = best_of([np.concatenate([[0.0], w]) for w in starts])
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(passes):
        curve = c * max(share, SHARE) / width
        direction = _two_loops(slope, steps, lambda g: np.concatenate([g[:1] / (curve * n), back(turn(g[1:]) / (curve * scale + 1.0))]))
        at, after, after_slope, after_share = best_of([theta - k * direction for k in LENGTHS])
        gain = value - after
        if not gain > 0:
            break
        step, change = at - theta, after_slope - slope
        if step @ change > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
            steps = [*steps, (step, change)][-MEMORY:]
        theta, value, slope, share = at, after, after_slope, after_share
        small = small - 1 if gain <= tol * value else patience
        if not small:
            break
    return theta[1:], float(shift[-1] + theta[0] - theta[1:] @ shift[:-1])


def _two_loops(slope, steps, solve):
    """Inverse curvature times ``slope``: ``solve`` corrected by the past ``(step, change of slope)``."""
    rest, pulls = slope.copy(), []
    for step, change in reversed(steps):
        pulls.append(step @ rest / (step @ change))
        rest = rest - pulls[-1] * change
    out = solve(rest)
    for (step, change), pull in zip(steps, reversed(pulls)):
        out = out + (pull - change @ out / (step @ change)) * step
    return out


def _metric(data):
    """Means, rows, spread of the label, ``S_xy`` and the channel scatter as ``back(scale * turn(v))``.

    The whole scatter where its moments fit the driver, otherwise its diagonal.
    """
    shift = provisional_shift(data)
    if dense_fits(len(shift) - 1):
        m = moments(data, "spectrum", "label", shift)
        scatter = m.scatter
        scale, axes = np.linalg.eigh(scatter[:-1, :-1])
        spread = float(np.sqrt(max(scatter[-1, -1], 0.0) / m.n)) or 1.0
        return np.append(m.mean, m.label_mean), m.n, spread, scatter[:-1, -1], lambda v: axes.T @ v, lambda v: axes @ v, np.maximum(scale, 0.0)
    n, mean, level, cross, squares = first_moments(data, "spectrum", "label")
    spread = data.agg(F.stddev_pop("label")).first()[0] or 1.0
    return np.append(mean, level), n, spread, cross, lambda v: v, lambda v: v, squares


def _epsilon_pass(data, shift, trials, epsilon, width):
    """Losses, rows in the corner and slopes of the columns of ``trials``; the driver adds up the sums of about sqrt(tasks) lots."""
    size, count = trials.shape

    def partial(batches):
        total = np.zeros((count, size + 2))
        for batch in batches:
            rows, _ = rows_of(batch, shift)
            design = rows[:, :-1]
            miss = rows[:, -1:] - design @ trials
            excess = np.abs(miss) - epsilon
            inside = np.clip(excess, 0, width)
            total[:, 0] += (inside**2 / (2 * width) + np.maximum(excess - width, 0)).sum(axis=0)
            total[:, 1] += ((excess > 0) & (excess < width)).sum(axis=0)
            total[:, 2:] -= (np.sign(miss) * inside / width).T @ design
        yield pa.RecordBatch.from_pydict({"lot": pa.array([lot()], pa.int32()), "vals": pa.array([total.ravel()], pa.list_(pa.float64()))})

    parts = inputs(data, "spectrum", "label", None).mapInArrow(partial, "lot int, vals array<double>")
    lots = parts.groupBy("lot").agg(Summarizer.sum(array_to_vector("vals")).alias("v")).collect()
    total = sum(r["v"].toArray() for r in lots).reshape(count, size + 2)
    return total[:, 0], total[:, 1], total[:, 2:]


def epsilon_objective(df: DataFrame, label: str, prediction: str, coefficients, c: float, epsilon: float) -> float:
    """The objective of a fitted epsilon-insensitive model."""
    excess = F.greatest(F.abs(F.col(label) - F.col(prediction)) - F.lit(epsilon), F.lit(0.0))
    loss = df.agg(F.sum(excess)).first()[0]
    return float(c * loss + 0.5 * (np.asarray(coefficients) ** 2).sum())


