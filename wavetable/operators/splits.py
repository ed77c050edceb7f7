"""Exact-size random splits and folds; all of them end as a comparison with literals."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.position import hash_cut_points, id_cut_points, rank_within, shuffle_key


def part_sizes(n: int, test_size: float, val_size: float | None) -> tuple[int, int]:
    """Rows in test and validation; the validation share refers to what the test part leaves."""
    test = _ceil_share(n, test_size)
    if not val_size:
        return test, 0
    return test, _ceil_share(n - test, val_size / (1 - test_size))


def _ceil_share(n: int, share: float) -> int:
    return min(n, ceil(round(n * share, 9)))


def assign_splits(
    df: DataFrame,
    row_id: str = "row_id",
    test_size: float = 0.2,
    val_size: float | None = 0.2,
    seed: int = 42,
    output: str = "split",
) -> DataFrame:
    """Column ``train`` / ``val`` / ``test``: the smallest hash keys are test, the next ones val."""
    return df.withColumn(output, split_column(df, row_id, test_size, val_size, seed))


def split_column(
    df: DataFrame, row_id: str = "row_id", test_size: float = 0.2, val_size: float | None = 0.2, seed: int = 42
) -> Column:
    """The split of the rows of ``df`` as a column of ``row_id`` alone.

    It also labels tables derived from ``df``, without a join.
    """

    def ends(n):
        test, val = part_sizes(n, test_size, val_size)
        return test, test + val

    n, cuts = hash_cut_points(df, row_id, ends, seed)
    test, val = part_sizes(n, test_size, val_size)
    return _label(shuffle_key(row_id, seed), cuts, test, val)


def _label(key: Column, cuts: dict, test: int, val: int) -> Column:
    label = F.lit("train")
    if val:
        label = F.when(key <= cuts[test + val], "val").otherwise(label)
    if test:
        label = F.when(key <= cuts[test], "test").otherwise(label)
    return label


def two_way_split(df: DataFrame, row_id: str = "row_id", test_size: float = 0.2, seed: int = 42, output: str = "split") -> DataFrame:
    """Train and test only; ``test_size`` between 0.1 and 0.5."""
    return df.withColumn(output, two_way_column(df, row_id, test_size, seed))


def two_way_column(df: DataFrame, row_id: str = "row_id", test_size: float = 0.2, seed: int = 42) -> Column:
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.1 and 0.5")
    return split_column(df, row_id, test_size, None, seed)


def stratified_splits(
    df: DataFrame,
    stratum,
    row_id: str = "row_id",
    test_size: float = 0.2,
    val_size: float | None = 0.2,
    seed: int = 42,
    output: str = "split",
) -> DataFrame:
    """As :func:`assign_splits`, with the shares met inside each stratum."""
    ranked = rank_within(df, stratum, row_id, seed, "__rank")
    n = F.col("__rank_of")
    test = F.ceil(F.round(n * F.lit(test_size), 9))
    label = F.lit("train")
    if val_size:
        val = F.ceil(F.round((n - test) * F.lit(val_size / (1 - test_size)), 9))
        label = F.when(F.col("__rank") <= test + val, "val").otherwise(label)
    label = F.when(F.col("__rank") <= test, "test").otherwise(label)
    return ranked.withColumn(output, label).drop("__rank", "__rank_of")


def fold_ends(n: int, folds: int) -> list[int]:
    """Last rank of every fold but the last; the first ``n % folds`` folds get one row more."""
    small, extra = floor(n / folds), n % folds
    ends, running = [], 0
    for i in range(folds - 1):
        running += small + (1 if i < extra else 0)
        ends.append(running)
    return ends


def _fold_column(key: Column, cuts: dict, ends: list[int]) -> Column:
    fold = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        if ends[i] > 0:
            fold = F.when(key <= F.lit(cuts[ends[i]]), F.lit(i)).otherwise(fold)
    return fold.cast("int")


def shuffled_folds(df: DataFrame, folds: int = 5, row_id: str = "row_id", seed: int = 42, output: str = "fold") -> DataFrame:
    """Exact-size folds 0..k-1 in hash order."""
    n, cuts = hash_cut_points(df, row_id, lambda n: fold_ends(n, folds), seed)
    return df.withColumn(output, _fold_column(shuffle_key(row_id, seed), cuts, fold_ends(n, folds)))


def contiguous_folds(df: DataFrame, folds: int = 5, row_id: str = "row_id", output: str = "fold") -> DataFrame:
    """Exact-size folds 0..k-1 in id order."""
    n, cuts = id_cut_points(df, row_id, lambda n: fold_ends(n, folds))
    return df.withColumn(output, _fold_column(F.col(row_id).cast("long"), cuts, fold_ends(n, folds)))


def hash_folds(df: DataFrame, folds: int = 5, row_id: str = "row_id", seed: int = 42, output: str = "fold") -> DataFrame:
    """Folds of nearly equal size without any pass over the data."""
    return df.withColumn(output, F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)).cast("int"))


def stack_splits(**parts: DataFrame) -> DataFrame:
    """Separate tables -> one table with a ``split`` column."""
    stacked = None
    for name, part in parts.items():
        tagged = part.withColumn("split", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked
