"""Aggregations over spectra, targets, predictions and runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.arrow import to_block
from wavetable.functions.metrics import pair_counts, regression_metrics
from wavetable.functions.spectral import whole
from wavetable.operators.columns import filter_late, numeric_columns, quoted, split_columns
from wavetable.operators.moments import channel_sums
from wavetable.operators.position import exact_median
from wavetable.session import durable

#: Bytes of the spectra of one sample that a task sorts at once; larger samples are counted instead.
SAMPLE_BYTES = 1 << 26
#: Large samples are broadcast up to this number.
LARGE_SAMPLES = 100_000

# Replicate aggregations.
REPLICATE_METHODS = ["mean", "median", "max", "min"]


def _vector(spectrum: str):
    return array_to_vector(whole(F.col(spectrum).cast("array<double>")))


def channel_stats(df: DataFrame, spectrum: str = "spectrum") -> tuple[int, np.ndarray, np.ndarray]:
    """``(rows, mean, population deviation)`` per channel of the complete spectra: one pass, O(p) state."""
    n, shift, sums, squares = channel_sums(df, spectrum)
    raw = squares / n
    variance = raw - (sums / n) ** 2
    return n, shift + sums / n, np.sqrt(np.where(variance > 1e-13 * raw, variance, 0.0))


def mean_spectrum(df: DataFrame, spectrum: str = "spectrum", by=()) -> DataFrame:
    """``(by..., channel, mean)``; arrays are averaged before anything is exploded.

    Means of lots of about sqrt(tasks) tasks are merged before those of the lots, weighted by their rows.
    """
    by = [by] if isinstance(by, str) else list(by)
    lot = F.floor(F.sqrt(F.spark_partition_id())).alias("__lot")
    vectors = filter_late(df.select(*by, lot, _vector(spectrum).alias("v")), F.col("v").isNotNull())
    lots = vectors.groupBy(*by, "__lot").agg(Summarizer.mean(F.col("v")).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    means = lots.groupBy(*by).agg(Summarizer.mean(F.col("v"), F.col("n")).alias("m"))
    return means.select(*by, F.posexplode(vector_to_array("m")).alias("channel", "mean"))


def replicate_spectra(df: DataFrame, sample: str, method: str = "mean", spectrum: str = "spectrum") -> DataFrame:
    """One spectrum per sample: channel-wise mean, median, max or min of its scans."""
    if method not in REPLICATE_METHODS:
        raise ValueError(f"unknown aggregation method: {method}")
    if method == "median":
        return median_spectra(df, sample, spectrum)
    vectors = filter_late(df.select(sample, _vector(spectrum).alias("x")), F.col("x").isNotNull())
    summary = getattr(Summarizer, method)(F.col("x"))
    return vectors.groupBy(sample).agg(summary.alias("v")).select(sample, vector_to_array("v").alias(spectrum))


def median_spectra(df: DataFrame, sample: str, spectrum: str = "spectrum") -> DataFrame:
    """Channel-wise exact median of the complete scans of each sample.

    A sample of at most ``SAMPLE_BYTES`` is sorted as one block, all channels at once and never exploded. The scans
    of a larger one are not collected: they are counted by value within brackets, spread over many tasks.
    """
    key, x = "__sample", "__x"
    rows = df.select(F.col(sample).alias(key), whole(F.col(spectrum).cast("array<double>")).alias(x))
    sizes = rows.groupBy(key).agg(F.sum(F.when(F.col(x).isNotNull(), 8 * F.size(x)).otherwise(0)).alias("bytes"))
    large = durable(sizes.filter(F.col("bytes") > SAMPLE_BYTES).select(F.col(key).alias("__large")))
    count = large.count()
    complete = filter_late(rows, F.col(x).isNotNull())

    def sort(table: pa.Table) -> pa.Table:
        middle = np.median(to_block(table.column(x)), axis=0)
        return pa.table({key: table.column(key).slice(0, 1), x: pa.array([middle], pa.list_(pa.float64()))})

    schema = T.StructType([rows.schema[key], T.StructField(x, T.ArrayType(T.DoubleType()))])
    named = (F.col(key).alias(sample), F.col(x).alias(spectrum))
    if not count:
        return complete.groupBy(key).applyInArrow(sort, schema).select(*named)
    known = F.broadcast(large) if count <= LARGE_SAMPLES else large
    match = F.col(key).eqNullSafe(F.col("__large"))
    small = complete.join(known, match, "left_anti").groupBy(key).applyInArrow(sort, schema)
    long = complete.join(known, match, "left_semi").select(key, F.posexplode(x).alias("channel", "value"))
    medians = exact_median(long, [key, "channel"], "value", "value")
    points = F.array_sort(F.collect_list(F.struct("channel", "value")))
    counted = medians.groupBy(key).agg(F.transform(points, lambda s: s["value"]).alias(x))
    return small.unionByName(counted).select(*named)


def replicate_columns(df: DataFrame, sample: str, columns, method: str = "mean") -> DataFrame:
    """Wide form: one row per sample, each column aggregated."""
    if method not in REPLICATE_METHODS:
        raise ValueError(f"unknown aggregation method: {method}")
    if method == "median":
        values = F.array(*[quoted(c).cast("double") for c in columns])
        long = df.select(sample, F.posexplode(values).alias("__channel", "__value"))
        medians = exact_median(long, [sample, "__channel"], "__value", "__value")
        packed = medians.groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct("__channel", "__value"))).alias("__m"))
        return packed.select(sample, *[F.try_element_at("__m", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    function = {"mean": F.avg, "max": F.max, "min": F.min}[method]
    return df.groupBy(sample).agg(*[function(quoted(c)).alias(c) for c in columns])


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """min, max, mean, sample std and exact median of the target; one row."""
    basic = df.agg(
        F.min(quoted(target)).cast("double").alias("min"),
        F.max(quoted(target)).cast("double").alias("max"),
        F.avg(quoted(target)).alias("mean"),
        F.stddev_samp(quoted(target)).alias("std"),
    )
    middle = exact_median(df.select(quoted(target).alias("__t")), [], "__t", "median").first()["median"]
    return basic.withColumn("median", F.lit(middle).cast("double"))


def shape_report(df: DataFrame) -> DataFrame:
    """One row: row count, column count, channel and other column names."""
    channels, others = split_columns(df)
    names = [F.array(*[F.lit(n) for n in part]).cast("array<string>") for part in (channels, others)]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        names[0].alias("spectral_columns"),
        names[1].alias("non_spectral_columns"),
    )


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction", by=()) -> DataFrame:
    """rmse, mae, r2, explained variance, ``n`` and ``n_skipped``, for the whole table or per group, in one pass.

    A row without label or prediction counts in ``n_skipped`` alone.
    """
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*regression_metrics(label, prediction), *pair_counts(label, prediction))


def long_metrics(metrics: DataFrame, keys) -> DataFrame:
    """Wide metrics -> ``(keys..., metric, value)``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(keys, values, "metric", "value")


def mean_numeric(df: DataFrame, by: str) -> DataFrame:
    """Mean of every numeric column per group."""
    columns = [c for c in numeric_columns(df) if c != by]
    return df.groupBy(by).agg(*[F.avg(quoted(c)).alias(c) for c in columns])


def mean_fold_score(scores: DataFrame, keys, score: str = "score") -> DataFrame:
    """Mean score over the folds of each candidate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count(score).alias("folds"))


def flag_counts(df: DataFrame, flags) -> DataFrame:
    """One row: how many rows carry each flag."""
    return df.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: missing values per column."""
    return df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in df.columns])


def latest_metrics(metrics: DataFrame, keys=None) -> DataFrame:
    """Run log ``(run_id, key, value, ts, step)`` -> one row per run with the latest value per key.

    The latest value is an aggregate, so a run with very many entries is reduced in every task.
    """
    latest = metrics.groupBy("run_id", "key").agg(
        F.max_by("value", F.struct("step", "ts", "value")).alias("value")
    )
    if keys is None:
        keys = [r["key"] for r in latest.select("key").distinct().orderBy("key").collect()]
    return latest.groupBy("run_id").pivot("key", list(keys)).agg(F.first("value"))


def generation_stats(candidates: DataFrame) -> DataFrame:
    """Fitness avg, std, min and max per generation of a candidate table."""
    return candidates.groupBy("generation").agg(
        F.avg("score").alias("avg"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )


def channel_correlation(df: DataFrame, spectrum: str = "spectrum", label: str = "label") -> DataFrame:
    """Pearson correlation of every channel with the label, reduced in each task to one row per channel."""
    long = df.select(
        F.posexplode(F.col(spectrum).cast("array<double>")).alias("channel", "value"),
        F.col(label).cast("double").alias("__y"),
    )
    return long.groupBy("channel").agg(F.corr("value", "__y").alias("correlation"))


def top_share(df: DataFrame, by: str, order, count: int) -> DataFrame:
    """The first ``count`` rows of each group in ``order``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= count)
