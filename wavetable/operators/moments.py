"""First and second moments of spectra and label, per fold, in one distributed pass.

With ``u = (1, x - shift, y - shift_y)`` the table holds ``sum(u u')`` per fold. It contains n, the
sums, the cross products and everything PCA, PLS, VIP, CARS, elastic net and Pearson ranking need.
Training moments of a fold are ``total - fold``; choosing channels is slicing. So cross-validation
and channel search need no further scan.

Every task reduces its rows to one triangle per fold before the shuffle, which makes the shuffle
independent of the row count and of how the rows spread over the folds. The triangle is summed row
by row in two steps: lots of about sqrt(tasks) tasks first, then the lots. So no reducer reads more than
2 sqrt(tasks) rows of a triangle, however many tasks there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.arrow import to_block

# The dense table is (p + 2)^2 doubles per fold on the driver; wider tables use `scatter_times` and `wide`.
MAX_DENSE_BYTES = 1 << 29
TABLE_SCHEMA = "fold int, part int, lot int, vals array<double>"
BATCH_SCHEMA = "part int, lot int, vals array<double>"


@dataclass(frozen=True)
class Moments:
    """Driver-side view of one summed table (shifted coordinates)."""

    gram: np.ndarray
    shift: np.ndarray

    @property
    def n(self) -> float:
        return float(round(self.gram[0, 0]))

    @property
    def channels(self) -> int:
        return len(self.shift) - 1

    @property
    def means(self) -> np.ndarray:
        """Means of all channels and, last, of the label."""
        return self.shift + self.gram[0, 1:] / self.n

    @property
    def mean(self) -> np.ndarray:
        return self.means[:-1]

    @property
    def label_mean(self) -> float:
        return float(self.means[-1])

    @property
    def scatter(self) -> np.ndarray:
        """Centred cross products of all channels and, last, the label."""
        sums = self.gram[0, 1:]
        return self.gram[1:, 1:] - np.outer(sums, sums) / self.n

    @property
    def std(self) -> np.ndarray:
        """Population deviation per channel, zero where only rounding noise is left."""
        return np.sqrt(self._variances()[:-1])

    def _variances(self) -> np.ndarray:
        raw = np.diag(self.gram)[1:] / self.n
        spread = np.diag(self.scatter) / self.n
        return np.where(spread > 1e-13 * raw, np.maximum(spread, 0.0), 0.0)

    def take(self, channels) -> "Moments":
        index = np.asarray(channels, dtype=int)
        keep = np.concatenate([[0], index + 1, [len(self.shift)]])
        return Moments(self.gram[np.ix_(keep, keep)], self.shift[np.concatenate([index, [-1]])])

    def minus(self, other: "Moments") -> "Moments":
        return Moments(self.gram - other.gram, self.shift)

    def squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        """Sum of squared residuals of a linear model on these rows."""
        coefficients = np.asarray(coefficients)
        offset = self.shift[-1] - intercept - coefficients @ self.shift[:-1]
        v = np.concatenate([[offset], -coefficients, [1.0]])
        return max(float(v @ self.gram @ v), 0.0)

    def label_correlation(self) -> np.ndarray:
        """Pearson correlation of each channel with the label; NaN without spread."""
        scatter = self.scatter
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(self._variances() * self.n)
            return scatter[:-1, -1] / (spread[:-1] * spread[-1])


@dataclass(frozen=True)
class FoldMoments:
    """Moments per fold with their total."""

    folds: dict[int, Moments]

    @property
    def total(self) -> Moments:
        parts = list(self.folds.values())
        return Moments(sum(m.gram for m in parts), parts[0].shift)

    @property
    def channels(self) -> int:
        return next(iter(self.folds.values())).channels

    def label_correlation(self) -> np.ndarray:
        return self.total.label_correlation()

    def take(self, channels) -> "FoldMoments":
        return FoldMoments({k: m.take(channels) for k, m in self.folds.items()})

    def pairs(self):
        """``(train, held out)`` for each fold, in fold order."""
        total = self.total
        for k in sorted(self.folds):
            yield total.minus(self.folds[k]), self.folds[k]


def provisional_shift(df: DataFrame, spectrum: str = "spectrum", label: str | None = "label") -> np.ndarray:
    """One observed row; any point near the data keeps the sums well conditioned."""

    def first_complete(batches):
        for batch in batches:
            x = to_block(batch.column("x"))
            y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), dtype=np.float64)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & np.isfinite(y)) if x.shape[1] else []
            if len(good):
                row = np.append(x[good[0]], y[good[0]])
                yield pa.RecordBatch.from_pydict({"vals": pa.array([row], pa.list_(pa.float64()))})
                return

    row = inputs(df, spectrum, label, None).mapInArrow(first_complete, "vals array<double>").first()
    if row is None:
        raise ValueError("no row has a complete spectrum and a label")
    return np.array(row["vals"], dtype=np.float64)


def inputs(df, spectrum, label, fold):
    return df.select(
        F.col(spectrum).cast("array<double>").alias("x"),
        (F.col(label).cast("double") if label else F.lit(0.0)).alias("y"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
    )


def rows_of(batch: pa.RecordBatch, shift: np.ndarray):
    """Design rows ``(1, x - shift, y - shift_y)`` and folds of rows that miss nothing."""
    x = to_block(batch.column("x"))
    y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), dtype=np.float64)
    folds = batch.column("fold").to_numpy(zero_copy_only=False)
    if x.shape[1] == 0:
        x = np.full((len(x), len(shift) - 1), np.nan)
    good = np.isfinite(x).all(axis=1) & np.isfinite(y) & batch.column("fold").is_valid().to_numpy(zero_copy_only=False)
    rows = np.empty((int(good.sum()), len(shift) + 1))
    rows[:, 0] = 1.0
    rows[:, 1:-1] = x[good] - shift[:-1]
    rows[:, -1] = y[good] - shift[-1]
    return rows, folds[good]


def lot() -> int:
    """The lot of the running task: lot s holds the 2 s + 1 tasks from number s * s on."""
    return math.isqrt(TaskContext.get().partitionId())


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., vals)``: the sums of the tasks' arrays, merged within each ``lot`` first."""
    lots = parts.groupBy(*keys, "lot").agg(Summarizer.sum(array_to_vector("vals")).alias("v"))
    return lots.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v")).select(*keys, vector_to_array("v").alias("vals"))


def moment_table(
    df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", fold: str | None = None, shift=None
) -> DataFrame:
    """Distributed table ``(fold, part, vals)``: row ``part`` of the upper triangle per fold."""
    shift = provisional_shift(df, spectrum, label) if shift is None else np.asarray(shift, dtype=np.float64)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, folds = rows_of(batch, shift)
            for k in np.unique(folds):
                mine = rows if fold is None else rows[folds == k]
                gram = mine.T @ mine
                sums[int(k)] = sums[int(k)] + gram if int(k) in sums else gram
        for k, gram in sums.items():
            size = len(gram)
            yield pa.RecordBatch.from_pydict(
                {
                    "fold": pa.array([k] * size, pa.int32()),
                    "part": pa.array(range(size), pa.int32()),
                    "lot": pa.array([lot()] * size, pa.int32()),
                    "vals": pa.array([gram[i, i:] for i in range(size)], pa.list_(pa.float64())),
                }
            )

    parts = inputs(df, spectrum, label, fold).mapInArrow(partial, TABLE_SCHEMA)
    return summed(parts, "fold", "part")


def fold_moments(
    df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", fold: str | None = None, shift=None
) -> FoldMoments:
    """The summed table on the driver. Its size depends on p and the folds, never on the rows."""
    shift = provisional_shift(df, spectrum, label) if shift is None else shift
    size = len(shift) + 1
    if size * size * 8 > MAX_DENSE_BYTES:
        raise ValueError(f"{size - 2} channels are too many for a dense moment table")
    grams: dict[int, np.ndarray] = {}
    for batch in moment_table(df, spectrum, label, fold, shift).toArrow().to_batches():
        lists = batch.column("vals")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, (k, part) in enumerate(zip(batch.column("fold").to_pylist(), batch.column("part").to_pylist())):
            gram = grams.setdefault(k, np.zeros((size, size)))
            gram[part, part:] = values[ends[i] : ends[i + 1]]
    if len(grams) * size * size * 8 > MAX_DENSE_BYTES:
        raise ValueError("too many folds x channels for dense moment tables")
    return FoldMoments(
        {k: Moments(np.triu(g) + np.triu(g, 1).T, shift) for k, g in grams.items()}
    )


def moments(df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", shift=None) -> Moments:
    return fold_moments(df, spectrum, label, None, shift).total


def gram_entries(df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", fold: str | None = None) -> DataFrame:
    """The unshifted table in long form ``(fold, i, j, value)``, i <= j; 0 is the constant one."""
    width = len(provisional_shift(df, spectrum, label))
    table = moment_table(df, spectrum, label, fold, np.zeros(width))
    return table.select(
        "fold", F.col("part").alias("i"), F.posexplode("vals").alias("offset", "value")
    ).select("fold", "i", (F.col("i") + F.col("offset")).alias("j"), "value")


def dense_fits(channels: int, folds: int = 1) -> bool:
    return folds * (channels + 2) ** 2 * 8 <= MAX_DENSE_BYTES


def _sum_rows(df: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all rows of a per-block vector, reduced in each task first."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            total += function(batch)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([0], pa.int32()), "lot": pa.array([lot()], pa.int32()),
            "vals": pa.array([total], pa.list_(pa.float64())),
        })

    return np.array(summed(df.mapInArrow(partial, BATCH_SCHEMA), "part").first()["vals"])


def scatter_times(df: DataFrame, mean: np.ndarray, vector: np.ndarray, spectrum: str, label: str) -> np.ndarray:
    """``S v`` for the centred channel scatter S, by one pass and without forming S.

    For tables whose channel count makes the dense moment table too large.
    """
    shift = np.concatenate([mean, [0.0]])

    def function(batch):
        rows, _ = rows_of(batch, shift)
        x = rows[:, 1:-1]
        return x.T @ (x @ vector)

    return _sum_rows(inputs(df, spectrum, label, None), function, len(mean))


def channel_sums(df: DataFrame, spectrum: str):
    """``(n, shift, sums, sums of squares)`` of the shifted channels of complete spectra: one pass, O(p) state."""
    shift = provisional_shift(df, spectrum, None)
    p = len(shift) - 1

    def function(batch):
        rows, _ = rows_of(batch, shift)
        x = rows[:, 1:-1]
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _sum_rows(inputs(df, spectrum, None, None), function, 2 * p + 1)
    return int(round(total[0])), shift[:-1], total[1 : p + 1], total[p + 1 :]


def first_moments(df: DataFrame, spectrum: str, label: str):
    """``(n, mean, label mean, S_xy, channel sums of squares)`` by two O(p) passes."""
    shift = provisional_shift(df, spectrum, label)
    p = len(shift) - 1

    def sums(batch):
        rows, _ = rows_of(batch, shift)
        return rows.sum(axis=0)

    needed = inputs(df, spectrum, label, None)
    total = _sum_rows(needed, sums, p + 2)
    means = shift + total[1:] / total[0]

    def cross(batch):
        rows, _ = rows_of(batch, means)
        x, y = rows[:, 1:-1], rows[:, -1]
        return np.concatenate([x.T @ y, (x * x).sum(axis=0)])

    crossed = _sum_rows(needed, cross, 2 * p)
    return int(round(total[0])), means[:-1], float(means[-1]), crossed[:p], crossed[p:]
