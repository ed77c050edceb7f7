"""Regression metrics and target summaries as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names in report order; the first two improve downwards.
METRICS = ["rmse", "mae", "r2", "explained_variance"]
ERROR_METRICS = {"rmse", "mae"}


def _paired(label, prediction):
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    both = y.isNotNull() & p.isNotNull()
    return F.when(both, y.cast("double")), F.when(both, p.cast("double"))


def rmse(label, prediction) -> Column:
    y, p = _paired(label, prediction)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(label, prediction) -> Column:
    y, p = _paired(label, prediction)
    return F.avg(F.abs(y - p))


def _explained(unexplained: Column, total: Column) -> Column:
    """``1 - unexplained/total``; a constant target scores 1 when exact and 0 otherwise."""
    return F.when(total > 0, 1 - unexplained / total).otherwise(
        F.when(unexplained > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    )


def r2(label, prediction) -> Column:
    y, p = _paired(label, prediction)
    return _explained(F.avg((y - p) * (y - p)), F.var_pop(y))


def explained_variance(label, prediction) -> Column:
    y, p = _paired(label, prediction)
    return _explained(F.var_pop(y - p), F.var_pop(y))


def pair_counts(label="label", prediction="prediction") -> list[Column]:
    """Rows that the metrics count, and rows left out because label or prediction is missing."""
    y, _ = _paired(label, prediction)
    return [F.count(y).alias("n"), (F.count(F.lit(1)) - F.count(y)).alias("n_skipped")]


def regression_metrics(label="label", prediction="prediction") -> list[Column]:
    """All four metrics; one aggregation pass."""
    return [
        rmse(label, prediction).alias("rmse"),
        mae(label, prediction).alias("mae"),
        r2(label, prediction).alias("r2"),
        explained_variance(label, prediction).alias("explained_variance"),
    ]
