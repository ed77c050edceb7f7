"""Shared parameters of the estimators; fitted arrays are parameters too, so models save as usual."""

from __future__ import annotations

import numpy as np
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


def declare(name: str, doc: str, converter):
    return Param(Params._dummy(), name, doc, typeConverter=converter)


def an_int(name, doc=""):
    return declare(name, doc, TypeConverters.toInt)


def a_float(name, doc=""):
    return declare(name, doc, TypeConverters.toFloat)


def a_flag(name, doc=""):
    return declare(name, doc, TypeConverters.toBoolean)


def a_text(name, doc=""):
    return declare(name, doc, TypeConverters.toString)


def floats(name, doc=""):
    return declare(name, doc, TypeConverters.toListFloat)


def ints(name, doc=""):
    return declare(name, doc, TypeConverters.toListInt)


def texts(name, doc=""):
    return declare(name, doc, TypeConverters.toListString)


class Settings(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Keyword parameters with defaults; ``self.value("x")`` reads one, None when it is unset."""

    spectrumCol = a_text("spectrumCol", "array<double> column")
    outputCol = a_text("outputCol", "output column")
    labelCol = a_text("labelCol", "label column")

    DEFAULTS: dict = {}

    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(spectrumCol="spectrum", labelCol="label", **self.DEFAULTS)
        given = {k: plain(v) for k, v in kwargs.items() if v is not None}
        self._set(**given)

    def value(self, name: str):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def array(self, name: str) -> np.ndarray:
        return np.asarray(self.value(name), dtype=np.float64)

    @property
    def spectrum(self) -> str:
        return self.value("spectrumCol")

    @property
    def label(self) -> str:
        return self.value("labelCol")

    @property
    def output(self) -> str:
        return self.value("outputCol") or self.spectrum


def plain(value):
    """NumPy values as plain Python, so that they serialise to JSON."""
    if isinstance(value, np.ndarray):
        return value.ravel().tolist()
    if isinstance(value, np.generic):
        return value.item()
    return value
