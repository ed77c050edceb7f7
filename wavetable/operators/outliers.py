"""Outlier scores and flags; a fitted detector also scores rows it has not seen."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from wavetable.functions.spectral import count_extreme_channels, hotelling_t2
from wavetable.operators.columns import filter_late
from wavetable.operators.params import Settings, a_flag, a_float, a_text, an_int, floats
from wavetable.operators.stats import channel_stats
from wavetable.operators.wide import channel_axes

# Detector defaults.
OUTLIER_THRESHOLD = 3.0
CHANNEL_SHARE = 0.05
T2_COMPONENTS = 10
METHODS = ("zscore", "pca", "both")


class OutlierDetector(Estimator, Settings):
    """Adds ``is_outlier`` and optionally drops these rows.

    ``zscore`` flags rows with at least ``int(p * channelShare)`` extreme channels, ``pca`` rows
    whose Hotelling T2 exceeds mean + threshold deviations, ``both`` either of them. A share below
    one channel counts as one channel; ``zeroMeansAll`` flags every row in that case instead.
    """

    method = a_text("method")
    threshold = a_float("threshold")
    channelShare = a_float("channelShare")
    nComponents = an_int("nComponents")
    removeOutliers = a_flag("removeOutliers")
    zeroMeansAll = a_flag("zeroMeansAll")
    keepScores = a_flag("keepScores", "keep the columns extreme_channels and t2")
    DEFAULTS = {
        "method": "zscore",
        "threshold": OUTLIER_THRESHOLD,
        "channelShare": CHANNEL_SHARE,
        "nComponents": T2_COMPONENTS,
        "removeOutliers": False,
        "zeroMeansAll": False,
        "keepScores": False,
        "outputCol": "is_outlier",
    }

    def __init__(self, **kwargs):
        super().__init__(**kwargs)
        if self.value("method") not in METHODS:
            raise ValueError(f"unknown outlier detection method: {self.value('method')}")

    def _fit(self, df):
        method = self.value("method")
        state: dict = {}
        if method == "zscore":
            _, mean, std = channel_stats(df, self.spectrum)
        else:
            mean, std, axes, eigenvalues, _ = channel_axes(df, self.spectrum, self.value("nComponents"), True)
            kept = eigenvalues > 1e-12 * max(float(eigenvalues.max(initial=0.0)), 1e-300)
            axes, eigenvalues = axes[:, kept], eigenvalues[kept]
            t2 = hotelling_t2(F.col(self.spectrum).cast("array<double>"), mean, std, axes, eigenvalues)
            level = df.select(t2.alias("t2")).agg(F.avg("t2").alias("m"), F.stddev_pop("t2").alias("s")).first()
            state = {
                "loadings": axes,
                "eigenvalues": eigenvalues,
                "t2Limit": level["m"] + self.value("threshold") * level["s"],
            }
        least = int(len(mean) * self.value("channelShare"))
        if not self.value("zeroMeansAll"):
            least = max(1, least)
        return self._copyValues(OutlierModel(mean=mean, std=std, leastChannels=least, **state))


class OutlierModel(Model, Settings):
    method = a_text("method")
    threshold = a_float("threshold")
    channelShare = a_float("channelShare")
    nComponents = an_int("nComponents")
    removeOutliers = a_flag("removeOutliers")
    zeroMeansAll = a_flag("zeroMeansAll")
    keepScores = a_flag("keepScores")
    mean = floats("mean")
    std = floats("std")
    loadings = floats("loadings")
    eigenvalues = floats("eigenvalues")
    leastChannels = an_int("leastChannels")
    t2Limit = a_float("t2Limit")
    DEFAULTS = OutlierDetector.DEFAULTS

    def _transform(self, df):
        spectrum = F.col(self.spectrum).cast("array<double>")
        method = self.value("method")
        scores, tests = {}, []
        if method in ("zscore", "both"):
            scores["extreme_channels"] = count_extreme_channels(
                spectrum, self.array("mean"), self.array("std"), self.value("threshold")
            )
            tests.append(F.col("extreme_channels") >= self.value("leastChannels"))
        if method in ("pca", "both"):
            axes = self.array("loadings").reshape(len(self.array("mean")), -1)
            scores["t2"] = hotelling_t2(spectrum, self.array("mean"), self.array("std"), axes, self.array("eigenvalues"))
            tests.append(F.col("t2") > self.value("t2Limit"))
        flagged = df.withColumns(scores)
        flag = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        flagged = flagged.withColumn(self.output, F.coalesce(flag, F.lit(False)))
        if self.value("removeOutliers"):
            flagged = filter_late(flagged, ~F.col(self.output))
        return flagged if self.value("keepScores") else flagged.drop(*scores)
