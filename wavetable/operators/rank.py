"""Leaderboards and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.functions.metrics import ERROR_METRICS


def metric_order(metric: str) -> Column:
    """Errors ascending, explained shares descending; undefined values last."""
    value = F.when(~F.isnan(F.col(metric)), F.col(metric))
    return value.asc_nulls_last() if metric in ERROR_METRICS else value.desc_nulls_last()


def leaderboard(results: DataFrame, metric: str = "rmse", name: str = "experiment") -> DataFrame:
    """Rows from best to worst by ``metric``; equal values by name."""
    return results.orderBy(metric_order(metric), F.col(name))


def best_row(results: DataFrame, metric: str = "rmse", by=(), name: str = "experiment") -> DataFrame:
    """The whole row with the best defined ``metric``, per group or overall.

    An aggregate rather than a window: every task keeps one candidate per group.
    """
    by = [by] if isinstance(by, str) else list(by)
    defined = results.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric)))
    value = F.col(metric) if metric in ERROR_METRICS else -F.col(metric)
    row = F.struct(*[F.col(f"`{c}`") for c in results.columns])
    return defined.groupBy(*by).agg(F.min_by(row, F.struct(value, F.col(name))).alias("__row")).select("__row.*")


def top_importances(importances: DataFrame, count: int = 10, by=("model",)) -> DataFrame:
    """The ``count`` most important channels of every model, ranked."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("importance").desc(), "channel"))
    return importances.withColumn("rank", rank).filter(F.col("rank") <= count)


def compare_models(results: DataFrame, metric: str = "rmse", split: str = "test") -> DataFrame:
    """``(model, metric, value)`` of one split, best first."""
    rows = results.filter(F.col("split") == split)
    return rows.orderBy(metric_order(metric), "model").select(
        "model", F.lit(metric).alias("metric"), F.col(metric).alias("value")
    )


def study_summary(results: DataFrame) -> DataFrame:
    """One row: best rmse with its r2 and mae, number of experiments and of successful ones."""
    ok = F.col("rmse").isNotNull() & ~F.isnan("rmse")
    key = F.when(ok, F.struct("rmse", "experiment"))
    return results.agg(
        F.min_by("experiment", key).alias("best_experiment"),
        F.min_by("rmse", key).alias("best_rmse"),
        F.min_by("r2", key).alias("best_r2"),
        F.min_by("mae", key).alias("best_mae"),
        F.count(F.lit(1)).alias("num_experiments"),
        F.count_if(ok).alias("successful_experiments"),
    )


def best_trial(trials: DataFrame, by=()) -> DataFrame:
    """Best params and score, trial count; a failed trial counts as the worst score."""
    by = [by] if isinstance(by, str) else list(by)
    score = F.coalesce(F.col("value"), F.lit(float("-inf")))
    return trials.groupBy(*by).agg(
        F.max_by("params", F.struct(score, -F.col("trial"))).alias("best_params"),
        F.max("value").alias("best_score"),
        F.count(F.lit(1)).alias("n_trials"),
    )
