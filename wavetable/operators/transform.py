"""Spectral corrections as ``pyspark.ml`` stages. Only the spectrum column changes."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wavetable.functions import spectral
from wavetable.operators.columns import channel_metadata, channel_names, component_names
from wavetable.operators.params import Settings, a_flag, a_text, an_int, floats
from wavetable.operators.stats import channel_stats


def replace_spectrum(df, stage, column, keep_names=True):
    """``stage.output`` set to ``column``, channel names kept in the metadata."""
    names = channel_names(df, stage.spectrum)
    if keep_names and names:
        column = column.alias(stage.output, metadata=channel_metadata(names))
    return df.withColumn(stage.output, column)


class SNV(Transformer, Settings):
    """Standard normal variate per spectrum."""

    def _transform(self, df):
        return replace_spectrum(df, self, spectral.snv(_doubles(self)))


class SavGol(Transformer, Settings):
    """Savitzky-Golay smoothing or derivative per spectrum."""

    window = an_int("window")
    polyorder = an_int("polyorder")
    deriv = an_int("deriv")
    DEFAULTS = {
        "window": spectral.SAVGOL_WINDOW,
        "polyorder": spectral.SAVGOL_POLYORDER,
        "deriv": spectral.SAVGOL_DERIV,
    }

    def __init__(self, **kwargs):
        super().__init__(**kwargs)
        spectral.check_savgol(self.value("window"), self.value("polyorder"), self.value("deriv"))

    def _transform(self, df):
        column = spectral.savgol(
            _doubles(self), self.value("window"), self.value("polyorder"), self.value("deriv")
        )
        return replace_spectrum(df, self, column)


class MSC(Estimator, Settings):
    """Scatter correction against the mean spectrum of the fitted rows."""

    def _fit(self, df):
        _, mean, _ = channel_stats(df, self.spectrum)
        return self._copyValues(MSCModel(reference=mean))


class MSCModel(Model, Settings):
    reference = floats("reference", "mean spectrum")

    def _transform(self, df):
        return replace_spectrum(df, self, spectral.msc(_doubles(self), self.array("reference")))


class ChannelScaler(Estimator, Settings):
    """Standardise every channel with its population deviation."""

    def _fit(self, df):
        _, mean, std = channel_stats(df, self.spectrum)
        return self._copyValues(ChannelScalerModel(mean=mean, std=std))


class ChannelScalerModel(Model, Settings):
    mean = floats("mean")
    std = floats("std")

    def _transform(self, df):
        column = spectral.standardize(_doubles(self), self.array("mean"), self.array("std"))
        return replace_spectrum(df, self, column)


class ChannelPCA(Estimator, Settings):
    """Principal components of the (standardised) channels.

    The sign of a component is fixed by making its largest loading positive.
    """

    nComponents = an_int("nComponents")
    standardize = a_flag("standardize")
    asColumns = a_flag("asColumns", "PC1, PC2, ... instead of one array")
    DEFAULTS = {"nComponents": 10, "standardize": True, "asColumns": False}

    def _fit(self, df):
        from wavetable.operators.wide import channel_axes

        standardize = self.value("standardize")
        mean, std, loadings, eigenvalues, total = channel_axes(df, self.spectrum, self.value("nComponents"), standardize)
        model = ChannelPCAModel(
            mean=mean, scale=std if standardize else np.ones(len(mean)), loadings=loadings, eigenvalues=eigenvalues,
            totalVariance=[total],
        )
        return self._copyValues(model)


class ChannelPCAModel(Model, Settings):
    nComponents = an_int("nComponents")
    standardize = a_flag("standardize")
    asColumns = a_flag("asColumns")
    mean = floats("mean")
    scale = floats("scale")
    loadings = floats("loadings", "row-major channels x components")
    eigenvalues = floats("eigenvalues", "variance (n - 1) of each component")
    totalVariance = floats("totalVariance")
    DEFAULTS = ChannelPCA.DEFAULTS

    @property
    def components(self) -> np.ndarray:
        return self.array("loadings").reshape(len(self.array("mean")), -1)

    def _transform(self, df):
        scores = spectral.project(_doubles(self), self.array("mean"), self.array("scale"), self.components)
        names = component_names(self.components.shape[1])
        if not self.value("asColumns"):
            return df.withColumn(self.output, scores.alias(self.output, metadata=channel_metadata(names)))
        placed = df.withColumn("__scores", scores)
        others = [c for c in df.columns if c != self.spectrum]
        return placed.select(
            *[F.col("__scores").getItem(i).alias(n) for i, n in enumerate(names)], *[F.col(f"`{c}`") for c in others]
        )


def principal_axes(m, scale, n_components):
    """Loadings, eigenvalues (n - 1) and total variance from moments."""
    scale = spectral.unit_where_zero(scale)
    covariance = m.scatter[:-1, :-1] / np.outer(scale, scale) / (m.n - 1)
    values, vectors = np.linalg.eigh(covariance)
    k = int(min(n_components, m.channels, m.n))
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    return signed(axes), np.maximum(values[order], 0.0), float(np.trace(covariance))


def signed(axes: np.ndarray) -> np.ndarray:
    """The same axes with a positive largest loading."""
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


class AsVector(Transformer, Settings):
    """Spectrum as an ml vector, for the built-in learners."""

    DEFAULTS = {"outputCol": "features"}

    def _transform(self, df):
        return df.withColumn(self.output, array_to_vector(_doubles(self)))


class ColumnFunction(Transformer, Settings):
    """A user function on spectra, given by importable name ``package.module:function``.

    The function gets and returns a (rows, channels) NumPy block.
    """

    function = a_text("function")

    def _transform(self, df):
        return replace_spectrum(df, self, spectral.row_function(_load(self.value("function")))(_doubles(self)), False)


def _load(path: str):
    from importlib import import_module

    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def _doubles(stage):
    return F.col(stage.spectrum).cast("array<double>")
