"""Fits on tables with more channels than a dense moment table can hold.

PLS, PCA and channel searches need the centred scatter S of the channels only as ``S v``. One pass over the
rows gives ``S v`` for a whole block of vectors, and every vector may leave out a fold of its own. So all
folds and all candidates of a search advance together: a pass for each component, however many fits there
are. No task and no driver array is larger than channels x vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavetable.functions.spectral import unit_where_zero
from wavetable.operators.latent import Latent, latent_steps
from wavetable.operators.moments import (
    BATCH_SCHEMA, FoldMoments, dense_fits, fold_moments, inputs, lot, provisional_shift, rows_of, summed,
)
from wavetable.session import durable

#: Bytes of one block of vectors, and of the components that one round of fits keeps on the driver.
BLOCK_BYTES = 1 << 27
#: A basis of this many blocks starts anew from its best vectors.
BASIS_BLOCKS = 12
KRYLOV_PASSES = 400
NO_FOLD = -1


def _sums(df: DataFrame, function, parts: int) -> np.ndarray:
    """Sum over all tasks of ``function(total, batch)``, which adds to (parts, size) arrays; by two merges."""

    def partial(batches):
        total = None
        for batch in batches:
            total = function(total, batch)
        if total is not None:
            rows = [np.asarray(r) for r in total]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(len(rows)), pa.int32()),
                "lot": pa.array([lot()] * len(rows), pa.int32()),
                "vals": pa.array(rows, pa.list_(pa.float64())),
            })

    found = summed(df.mapInArrow(partial, BATCH_SCHEMA), "part").toArrow()
    order = np.argsort(found["part"].to_numpy())
    lists = found["vals"].combine_chunks()
    return lists.flatten().to_numpy().reshape(parts, -1)[order]


@dataclass(frozen=True)
class WideTable:
    """Complete rows ``(x, y, fold)`` in the checkpoint folder with their O(folds x channels) sums.

    Rows without a label, a fold or a channel are left out, as in the dense table. Sums are taken around
    ``shift``, the mean of all rows; the label comes last in each of them.
    """

    data: DataFrame
    shift: np.ndarray
    counts: dict[int, float]
    sums: dict[int, np.ndarray]
    squares: dict[int, np.ndarray]
    cross: dict[int, np.ndarray]

    @property
    def channels(self) -> int:
        return len(self.shift) - 1

    @property
    def folds(self) -> list[int]:
        return sorted(self.counts)

    def _left(self, parts: dict, fold: int):
        """Total of ``parts`` without one fold."""
        return sum(v for k, v in parts.items() if k != fold)

    def stats(self, fold: int = NO_FOLD):
        """``(n, mean and label mean, centred cross products, centred squares)`` of the rows outside ``fold``."""
        n, s = self._left(self.counts, fold), self._left(self.sums, fold)
        raw = self._left(self.squares, fold)
        spread = raw - s * s / n
        squares = np.where(spread > 1e-13 * raw, np.maximum(spread, 0.0), 0.0)
        return n, self.shift + s / n, self._left(self.cross, fold) - s[:-1] * s[-1] / n, squares

    def label_correlation(self) -> np.ndarray:
        """Pearson correlation of each channel with the label; NaN without spread."""
        _, _, cross, squares = self.stats()
        with np.errstate(divide="ignore", invalid="ignore"):
            return cross / np.sqrt(squares[:-1] * squares[-1])

    def times(self, vectors: np.ndarray, left_out) -> np.ndarray:
        """``S v`` for each column of ``vectors``, S being the centred scatter without the column's fold."""
        step = max(1, BLOCK_BYTES // (8 * len(vectors)))
        left_out = np.asarray(left_out)
        blocks = [self._times(vectors[:, i : i + step], left_out[i : i + step]) for i in range(0, len(left_out), step)]
        return np.hstack(blocks)

    def _times(self, vectors, left_out):
        shared = self.data.sparkSession.sparkContext.broadcast(np.ascontiguousarray(vectors))
        shift = self.shift

        def add(total, batch):
            rows, folds = rows_of(batch, shift)
            x = rows[:, 1:-1]
            scores = x @ shared.value
            scores[folds[:, None] == left_out[None, :]] = 0.0
            found = scores.T @ x
            return found if total is None else total + found

        try:
            raw = _sums(self.data, add, vectors.shape[1]).T
        finally:
            shared.unpersist()
        for j, fold in enumerate(left_out):
            s = self._left(self.sums, fold)[:-1]
            raw[:, j] -= s * (s @ vectors[:, j]) / self._left(self.counts, fold)
        return raw

    def held_errors(self, coefficients: np.ndarray, intercepts, held) -> np.ndarray:
        """Per column the sum of squared residuals on the fold it names; one pass."""
        shared = self.data.sparkSession.sparkContext.broadcast(np.ascontiguousarray(coefficients))
        shift, held = self.shift, np.asarray(held)
        offsets = np.asarray(intercepts) + shift[:-1] @ coefficients - shift[-1]

        def add(total, batch):
            rows, folds = rows_of(batch, shift)
            miss = rows[:, -1:] - rows[:, 1:-1] @ shared.value - offsets
            miss[folds[:, None] != held[None, :]] = 0.0
            found = (miss * miss).sum(axis=0)[None, :]
            return found if total is None else total + found

        try:
            return _sums(self.data, add, 1)[0]
        finally:
            shared.unpersist()

    def fit_many(self, fits, n_components, scale: bool) -> list[Latent]:
        """PLS of every ``(channels, fold left out)``, all of them a component further in each pass."""
        steps, sizes, stats, pending, done = [], [], [], {}, {}
        for i, (channels, fold) in enumerate(fits):
            n, means, cross, squares = self.stats(fold)
            size = unit_where_zero(np.sqrt(squares[channels] / max(n - 1, 1))) if scale else np.ones(len(channels))
            k = int(max(1, min(n_components, len(channels), n)))
            steps.append(latent_steps(cross[channels] / size, k))
            sizes.append(size)
            stats.append((n, means))
        self._advance(steps, {i: None for i in range(len(fits))}, pending, done)
        while pending:
            order = sorted(pending)
            block = np.zeros((self.channels, len(order)))
            for j, i in enumerate(order):
                block[fits[i][0], j] = pending[i] / sizes[i]
            images = self.times(block, [fits[i][1] for i in order])
            answers = {i: images[fits[i][0], j] / sizes[i] for j, i in enumerate(order)}
            pending.clear()
            self._advance(steps, answers, pending, done)
        out = []
        for i, (channels, _) in enumerate(fits):
            n, means = stats[i]
            out.append(Latent(*done[i], means[:-1][channels], float(means[-1]), sizes[i], n))
        return out

    @staticmethod
    def _advance(steps, answers, pending, done):
        for i, answer in answers.items():
            try:
                pending[i] = steps[i].send(answer)
            except StopIteration as end:
                done[i] = end.value

    def cv_errors(self, candidates, n_components: int, scale: bool, least: int = 0) -> list[list[float]]:
        """Held-out rmse per fold of every candidate channel set; folds that train on ``least`` rows or fewer are skipped."""
        folds = [k for k in self.folds if self._left(self.counts, k) > least]
        tasks = [(i, np.asarray(c, dtype=int), k) for i, c in enumerate(candidates) for k in folds]
        out: list[list[float]] = [[] for _ in candidates]
        room = max(1, BLOCK_BYTES // (24 * self.channels * max(1, min(n_components, self.channels))))
        for start in range(0, len(tasks), room):
            part = tasks[start : start + room]
            fits = self.fit_many([(c, k) for _, c, k in part], n_components, scale)
            block, intercepts = np.zeros((self.channels, len(part))), []
            for j, ((_, channels, _), fit) in enumerate(zip(part, fits)):
                b = fit.coefficients()
                block[channels, j] = b
                intercepts.append(fit.intercept(b))
            errors = self.held_errors(block, intercepts, [k for _, _, k in part])
            for (i, _, k), error in zip(part, errors):
                out[i].append(float(np.sqrt(error / self.counts[k])))
        return out

    def dense(self, channels) -> FoldMoments | None:
        """The dense moments of some channels by one pass, if they fit."""
        channels = np.asarray(channels, dtype=int)
        if not dense_fits(len(channels), len(self.counts)):
            return None
        from wavetable.functions.spectral import take_channels

        part = self.data.select(take_channels("x", channels).alias("x"), "y", "fold")
        return fold_moments(part, "x", "y", "fold", self.shift[np.append(channels, -1)])


def wide_table(df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", fold: str | None = None) -> WideTable:
    """Write the needed columns once and sum them around their mean: two passes."""
    first = provisional_shift(df, spectrum, label)
    data = durable(inputs(df, spectrum, label, fold))

    def mean(total, batch):
        rows, _ = rows_of(batch, first)
        found = rows.sum(axis=0)[None, :]
        return found if total is None else total + found

    total = _sums(data, mean, 1)[0]
    shift = first + total[1:] / total[0]

    def add(total, batch):
        rows, folds = rows_of(batch, shift)
        total = {} if total is None else total
        for k in np.unique(folds):
            u = rows[folds == k]
            x, y = u[:, 1:-1], u[:, -1]
            found = np.concatenate([[len(u)], u[:, 1:].sum(axis=0), (u[:, 1:] ** 2).sum(axis=0), x.T @ y])
            total[int(k)] = total[int(k)] + found if int(k) in total else found
        return total

    def partial(batches):
        total = None
        for batch in batches:
            total = add(total, batch)
        if total:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(list(total), pa.int32()),
                "lot": pa.array([lot()] * len(total), pa.int32()),
                "vals": pa.array(list(total.values()), pa.list_(pa.float64())),
            })

    p = len(shift) - 1
    counts, sums, squares, cross = {}, {}, {}, {}
    for row in summed(data.mapInArrow(partial, BATCH_SCHEMA), "part").toArrow().to_pylist():
        v, k = np.array(row["vals"]), row["part"]
        counts[k] = float(round(v[0]))
        sums[k], squares[k], cross[k] = v[1 : p + 2], v[p + 2 : 2 * p + 3], v[2 * p + 3 :]
    return WideTable(data, shift, counts, sums, squares, cross)


def moment_source(df: DataFrame, spectrum: str = "spectrum", label: str | None = "label", fold: str | None = None, folds: int = 1):
    """The dense moments of a table, or a ``WideTable`` where ``folds`` dense tables would not fit."""
    shift = provisional_shift(df, spectrum, label)
    if dense_fits(len(shift) - 1, folds):
        return fold_moments(df, spectrum, label, fold, shift)
    return wide_table(df, spectrum, label, fold)


def leading_axes(times, size: int, count: int, tolerance: float = 1e-12, seed: int = 42):
    """The ``count`` largest eigenvalues of a symmetric operator and their vectors: block Lanczos, restarted.

    ``times(block)`` is the operator times (size, b) vectors. The whole basis is kept orthogonal; the best
    vectors and the next block start a new one when it has ``BASIS_BLOCKS`` blocks. Ends when the residuals of
    the wanted vectors are ``tolerance`` of the largest eigenvalue, or when nothing is left outside the basis.
    """
    width = min(size, count + 4)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis, images = np.empty((size, 0)), np.empty((size, 0))
    for _ in range(KRYLOV_PASSES):
        image = times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, small = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1]
        best = order[:count]
        vectors = basis @ small[:, best]
        rest = images @ small[:, best] - vectors * values[best]
        scale = max(float(np.abs(values).max()), 1e-300)
        block = _outside(basis, image, 1e-13 * scale)
        if np.linalg.norm(rest, axis=0).max() <= tolerance * scale or not block.shape[1]:
            return values[best], vectors
        if basis.shape[1] >= BASIS_BLOCKS * width:
            keep = order[: 2 * width]
            basis, images = basis @ small[:, keep], images @ small[:, keep]
            block = _outside(basis, np.hstack([rest, block])[:, : 2 * width], 1e-13 * scale)
            if not block.shape[1]:
                return values[best], vectors
    raise RuntimeError(f"{count} components did not converge in {KRYLOV_PASSES} passes")


def _outside(basis, block, least: float):
    """An orthonormal basis of what ``block`` adds to ``basis``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    vectors, sizes, _ = np.linalg.svd(block, full_matrices=False)
    vectors = vectors[:, sizes > least]
    vectors = vectors - basis @ (basis.T @ vectors)
    return np.linalg.qr(vectors)[0] if vectors.shape[1] else vectors


def channel_axes(df: DataFrame, spectrum: str, n_components: int, standardize: bool):
    """``(mean, deviation, loadings, eigenvalues, total variance)`` of the channels, whatever their number."""
    from wavetable.operators.transform import principal_axes, signed

    source = moment_source(df, spectrum, None)
    if isinstance(source, FoldMoments):
        m = source.total
        axes, values, total = principal_axes(m, m.std if standardize else np.ones(m.channels), n_components)
        return m.mean, m.std, axes, values, total
    n, means, _, squares = source.stats()
    std = np.sqrt(squares[:-1] / n)
    scale = unit_where_zero(std) if standardize else np.ones(source.channels)

    def times(block):
        return source.times(block / scale[:, None], [NO_FOLD] * block.shape[1]) / scale[:, None] / (n - 1)

    values, axes = leading_axes(times, source.channels, int(min(n_components, source.channels, n)))
    return means[:-1], std, signed(axes), np.maximum(values, 0.0), float((squares[:-1] / scale**2).sum() / (n - 1))
