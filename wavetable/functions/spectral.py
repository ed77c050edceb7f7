"""Per-row spectral corrections as Column functions.

Every function maps an ``array<double>`` column to a new column with a vectorised Arrow kernel.
Spark evaluates chained calls, such as ``savgol(snv("spectrum"))``, in one Python pass and leaves
all other columns in the JVM. A spectrum with a missing channel, or one whose correction is
undefined (for example a flat spectrum under SNV), yields NULL.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.arrow import to_block, to_lists, to_scalars

SPECTRUM = T.ArrayType(T.DoubleType())

# Default filter settings.
SAVGOL_WINDOW = 15
SAVGOL_POLYORDER = 2
SAVGOL_DERIV = 1


def _spectral_function(kernel, name="spectral"):
    def apply(spectra: pa.Array) -> pa.Array:
        block = to_block(spectra)
        if block.shape[1] == 0:  # nothing but missing spectra in this batch
            return pa.nulls(len(block), pa.list_(pa.float64()))
        with np.errstate(divide="ignore", invalid="ignore"):
            return to_lists(kernel(block))

    apply.__name__ = name
    return F.arrow_udf(apply, SPECTRUM)


def _scoring_function(kernel, returns=None, name="score"):
    def apply(spectra: pa.Array) -> pa.Array:
        block = to_block(spectra)
        if block.shape[1] == 0:
            return pa.nulls(len(block), pa.float64())
        with np.errstate(divide="ignore", invalid="ignore"):
            return to_scalars(kernel(block))

    apply.__name__ = name
    return F.arrow_udf(apply, returns or T.DoubleType())


def snv(spectrum: Column | str) -> Column:
    """Standard normal variate: centre and scale each spectrum by its population deviation."""

    def kernel(x):
        centred = x - x.mean(axis=1, keepdims=True)
        spread = np.sqrt((centred * centred).mean(axis=1, keepdims=True))
        size = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        spread[spread <= 1e-14 * size] = np.nan
        return centred / spread

    return _spectral_function(kernel, "snv")(spectrum)


def check_savgol(window: int, polyorder: int, deriv: int) -> None:
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be a positive odd number")
    if not 0 <= polyorder < window:
        raise ValueError("polyorder must be smaller than the window")
    if deriv < 0:
        raise ValueError("deriv must not be negative")


def savgol_weights(window: int, polyorder: int, deriv: int) -> np.ndarray:
    """Row ``s``: weights giving the derivative at window position ``s`` of the fitted polynomial."""
    check_savgol(window, polyorder, deriv)
    offsets = np.arange(window, dtype=np.float64) - window // 2
    fit = np.linalg.pinv(np.vander(offsets, polyorder + 1, increasing=True))
    evaluate = np.zeros((window, polyorder + 1))
    for power in range(deriv, polyorder + 1):
        evaluate[:, power] = factorial(power) / factorial(power - deriv) * offsets ** (power - deriv)
    return evaluate @ fit


def savgol(
    spectrum: Column | str,
    window: int = SAVGOL_WINDOW,
    polyorder: int = SAVGOL_POLYORDER,
    deriv: int = SAVGOL_DERIV,
) -> Column:
    """Savitzky-Golay smoothing or derivative; both ends use the polynomial of the end window."""
    weights = savgol_weights(window, polyorder, deriv)
    half = window // 2

    def kernel(x):
        if x.shape[1] < window:
            raise ValueError("window must not be longer than the spectrum")
        inner = np.lib.stride_tricks.sliding_window_view(x, window, axis=1) @ weights[half]
        head = x[:, :window] @ weights[:half].T
        tail = x[:, -window:] @ weights[half + 1 :].T
        return np.concatenate([head, inner, tail], axis=1)

    return _spectral_function(kernel, "savgol")(spectrum)


def msc(spectrum: Column | str, reference) -> Column:
    """Scatter correction: regress each spectrum on ``reference`` and remove offset and slope."""
    reference = np.asarray(reference, dtype=np.float64)
    centred = reference - reference.mean()
    direction = centred / (centred @ centred)

    def kernel(x):
        slope = (x @ direction)[:, None]
        slope[slope == 0] = np.nan
        return (x - x.mean(axis=1, keepdims=True)) / slope + reference.mean()

    return _spectral_function(kernel, "msc")(spectrum)


def standardize(spectrum: Column | str, mean, scale) -> Column:
    """Channel-wise ``(x - mean) / scale``; a zero scale counts as one."""
    mean = np.asarray(mean, dtype=np.float64)
    scale = unit_where_zero(scale)
    return _spectral_function(lambda x: (x - mean) / scale, "standardize")(spectrum)


def project(spectrum: Column | str, mean, scale, loadings) -> Column:
    """Scores of the standardised spectrum on the columns of ``loadings``."""
    mean = np.asarray(mean, dtype=np.float64)
    weights = np.asarray(loadings, dtype=np.float64) / unit_where_zero(scale)[:, None]
    return _spectral_function(lambda x: (x - mean) @ weights, "project")(spectrum)


def hotelling_t2(spectrum: Column | str, mean, scale, loadings, eigenvalues) -> Column:
    """Sum of squared scores, each divided by the variance of its component."""
    mean = np.asarray(mean, dtype=np.float64)
    weights = np.asarray(loadings) / unit_where_zero(scale)[:, None] / np.sqrt(eigenvalues)
    return _scoring_function(lambda x: (((x - mean) @ weights) ** 2).sum(axis=1), name="hotelling_t2")(spectrum)


def linear_score(spectrum: Column | str, coefficients, intercept: float) -> Column:
    """``spectrum . coefficients + intercept``."""
    coefficients = np.asarray(coefficients, dtype=np.float64)
    return _scoring_function(lambda x: x @ coefficients + intercept, name="linear_score")(spectrum)


def tree_score(spectrum: Column | str, forest, edges, base: float, scale: float) -> Column:
    """``base`` plus ``scale`` times the sum of what the trees of ``forest`` say to the binned spectrum."""

    def kernel(x):
        binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8)
        return np.where(np.isfinite(x).all(axis=1), base + scale * forest.total(binned), np.nan)

    return _scoring_function(kernel, name="tree_score")(spectrum)


def count_extreme_channels(spectrum: Column | str, mean, std, threshold: float) -> Column:
    """How many channels lie more than ``threshold`` deviations from their mean.

    A channel without spread has no z-score and is never counted.
    """
    mean = np.asarray(mean, dtype=np.float64)
    std = np.asarray(std, dtype=np.float64)
    std = np.where(std > 0, std, np.nan)

    def apply(spectra: pa.Array) -> pa.Array:
        x = to_block(spectra)
        if x.shape[1] == 0:
            return pa.nulls(len(x), pa.int32())
        missing = np.isnan(x).any(axis=1)
        counts = (np.abs((x - mean) / std) > threshold).sum(axis=1).astype(np.int32)
        return pa.array(counts, mask=missing)

    return F.arrow_udf(apply, T.IntegerType())(spectrum)


def random_features(spectrum: Column | str, directions, phases) -> Column:
    """Random Fourier features ``sqrt(2/D) cos(x W + b)`` approximating an rbf kernel."""
    directions = np.asarray(directions, dtype=np.float64)
    phases = np.asarray(phases, dtype=np.float64)
    size = np.sqrt(2.0 / len(phases))
    return _spectral_function(lambda x: size * np.cos(x @ directions + phases))(spectrum)


def whole(spectrum: Column | str) -> Column:
    """The spectrum itself, or NULL when a channel is missing (stays in the JVM)."""
    spectrum = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    return F.when(~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v)), spectrum)


def take_channels(spectrum: Column | str, channels) -> Column:
    """Channels at the given positions, in the given order (stays in the JVM)."""
    spectrum = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    return F.when(spectrum.isNotNull(), F.array(*[spectrum.getItem(int(i)) for i in channels]))


def unit_where_zero(scale) -> np.ndarray:
    scale = np.asarray(scale, dtype=np.float64)
    return np.where(scale > 0, scale, 1.0)


def row_function(function, returns: T.DataType = SPECTRUM):
    """Wrap a NumPy function of a (rows, channels) block as a Column function."""
    if isinstance(returns, T.ArrayType):
        return _spectral_function(function)
    return _scoring_function(function, returns)


def spectral_transform(spectrum: Column | str, method: str = "none", reference=None, **options) -> Column:
    """Dispatch by name: ``none``, ``snv``, ``msc`` (needs ``reference``) or ``savgol``.

    Unlike :func:`savgol`, the derivative order defaults to 0 here.
    """
    column = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    if method == "none":
        return column
    if method == "snv":
        return snv(column)
    if method == "msc":
        if reference is None:
            raise ValueError("msc needs a reference spectrum")
        return msc(column, reference)
    if method == "savgol":
        return savgol(
            column,
            options.get("window", SAVGOL_WINDOW),
            options.get("polyorder", SAVGOL_POLYORDER),
            options.get("deriv", 0),
        )
    raise ValueError(f"unknown transformation method: {method}")
