"""Partial least squares for one label, solved on moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from wavetable.functions.spectral import linear_score, unit_where_zero
from wavetable.operators.moments import Moments, dense_fits, first_moments, moments, provisional_shift, scatter_times
from wavetable.operators.params import Settings, a_flag, a_float, an_int, floats


@dataclass(frozen=True)
class Latent:
    """Components of a fit, in the scaled channel space; ``scale`` maps back."""

    weights: np.ndarray
    rotations: np.ndarray
    label_loadings: np.ndarray
    score_sums: np.ndarray
    mean: np.ndarray
    label_mean: float
    scale: np.ndarray
    n: float

    @property
    def components(self) -> int:
        return self.weights.shape[1]

    def coefficients(self, components: int | None = None) -> np.ndarray:
        """Coefficients for raw channels, using the first ``components``."""
        k = self.components if components is None else min(components, self.components)
        return (self.rotations[:, :k] @ self.label_loadings[:k]) / self.scale

    def intercept(self, coefficients: np.ndarray) -> float:
        return float(self.label_mean - coefficients @ self.mean)

    def importance(self) -> np.ndarray:
        """VIP: weight shares averaged with the variance of each X-score."""
        variance = self.score_sums / self.n
        share = self.weights**2 / (self.weights**2).sum(axis=0)
        return np.sqrt(len(self.mean) * (share @ variance) / variance.sum())


def latent_components(times, cross, n_components: int):
    """Weights, rotations, label loadings and score sums of squares (kernel PLS, one label).

    ``times(v)`` is the scatter matrix times a vector, so the matrix itself may stay distributed.
    """
    steps, image = latent_steps(cross, n_components), None
    while True:
        try:
            image = times(steps.send(image))
        except StopIteration as end:
            return end.value


def latent_steps(cross, n_components: int):
    """The same as a generator: yields each rotation, is sent its image and returns the components.

    Many fits can so advance together. Stops early when nothing of the label is left to explain.
    """
    cross = np.array(cross, dtype=np.float64)
    left = cross.copy()
    start = np.linalg.norm(cross)
    weights, rotations, loadings, gains, sums = [], [], [], [], []
    for _ in range(n_components):
        size = np.linalg.norm(left)
        if size <= 1e-12 * start or size == 0:
            break
        weight = left / size
        rotation = weight - sum(((p @ weight) * r for p, r in zip(loadings, rotations)), np.zeros_like(weight))
        image = yield rotation
        energy = float(rotation @ image)
        if energy <= 0:
            break
        loading = image / energy
        gain = float(rotation @ cross) / energy
        left = left - loading * (gain * energy)
        weights.append(weight)
        rotations.append(rotation)
        loadings.append(loading)
        gains.append(gain)
        sums.append(energy)
    if not weights:
        flat = np.zeros((len(cross), 1))
        return flat + 1 / np.sqrt(len(cross)), flat, np.zeros(1), np.ones(1)
    return np.array(weights).T, np.array(rotations).T, np.array(gains), np.array(sums)


def fit_latent(m: Moments, n_components: int, scale: bool) -> Latent:
    scatter = m.scatter
    cross, inner = scatter[:-1, -1], scatter[:-1, :-1]
    sizes = np.ones(m.channels)
    if scale:
        sizes = unit_where_zero(m.std * np.sqrt(m.n / max(m.n - 1, 1)))
        inner = inner / np.outer(sizes, sizes)
        cross = cross / sizes
    k = int(max(1, min(n_components, m.channels, m.n)))
    parts = latent_components(lambda v: inner @ v, cross, k)
    return Latent(*parts, m.mean, m.label_mean, sizes, m.n)


def fit_latent_wide(df, n_components: int, scale: bool, spectrum: str, label: str) -> Latent:
    """The same fit with one pass per component and O(p) driver state."""
    n, mean, label_mean, cross, squares = first_moments(df, spectrum, label)
    sizes = unit_where_zero(np.sqrt(squares / max(n - 1, 1))) if scale else np.ones(len(mean))
    k = int(max(1, min(n_components, len(mean), n)))
    parts = latent_components(
        lambda v: scatter_times(df, mean, v / sizes, spectrum, label) / sizes, cross / sizes, k
    )
    return Latent(*parts, mean, label_mean, sizes, n)


def fit_table(df, n_components: int, scale: bool, spectrum: str, label: str) -> Latent:
    shift = provisional_shift(df, spectrum, label)
    if dense_fits(len(shift) - 1):
        return fit_latent(moments(df, spectrum, label, shift), n_components, scale)
    return fit_latent_wide(df, n_components, scale, spectrum, label)


class PLSRegressor(Estimator, Settings):
    """Partial least squares regression."""

    nComponents = an_int("nComponents")
    scale = a_flag("scale", "standardise the channels first")
    DEFAULTS = {"nComponents": 10, "scale": False, "outputCol": "prediction"}

    def _fit(self, df):
        fit = fit_table(df, self.value("nComponents"), self.value("scale"), self.spectrum, self.label)
        return self._copyValues(latent_model(fit))


def latent_model(fit: Latent, components: int | None = None) -> "LinearSpectralModel":
    coefficients = fit.coefficients(components)
    return LinearSpectralModel(coefficients=coefficients, intercept=fit.intercept(coefficients))


class LinearSpectralModel(Model, Settings):
    """``prediction = spectrum . coefficients + intercept``."""

    nComponents = an_int("nComponents")
    scale = a_flag("scale")
    coefficients = floats("coefficients")
    intercept = a_float("intercept")
    alpha = a_float("alpha")
    l1Ratio = a_float("l1Ratio")
    DEFAULTS = {"outputCol": "prediction"}

    def _transform(self, df):
        doubles = F.col(self.spectrum).cast("array<double>")
        return df.withColumn(self.output, linear_score(doubles, self.array("coefficients"), self.value("intercept")))
