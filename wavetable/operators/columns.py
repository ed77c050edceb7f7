"""Schema operators: which columns are channels, packing them, and unpacking them again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of wavelength columns.
CHANNEL_NAME = re.compile(r"^(\d+[,.]\d+|\d+)$", re.ASCII)
WL_NAME = "wl_"


def quoted(name: str) -> Column:
    """Column by exact name; names such as ``900.5`` need back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def filter_late(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a condition that is computed from whole spectra.

    Spark rewrites the condition of a filter for every alias of every column in it. A spectrum packed
    from hundreds of renamed columns makes that exponential, so a non-deterministic term (never true)
    keeps the condition out of the rewriting. There is nothing to push down in such a condition.
    """
    return df.filter(condition | (F.spark_partition_id() < 0))


def split_columns(names) -> tuple[list[str], list[str]]:
    """(channel names, other names), each in the given order."""
    names = list(names.columns if isinstance(names, DataFrame) else names)
    channels = [n for n in names if CHANNEL_NAME.match(n)]
    found = set(channels)
    return channels, [n for n in names if n not in found]


def wavelength(name: str) -> float:
    """``"900,5"`` or ``"900.5"`` -> 900.5."""
    return float(name.replace(",", "."))


def wl_numbers(names) -> list[int]:
    """Integers of ``wl_<int>`` names; other names are skipped."""
    numbers = []
    for name in names:
        if name.startswith(WL_NAME):
            text = name.split("_")[1]
            if re.fullmatch(r"\s*[+-]?\d+\s*", text, re.ASCII):
                numbers.append(int(text))
    return numbers


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is always NULL: NaN in float and double columns becomes NULL."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(n)), quoted(n)).alias(n) if n in floating else quoted(n)
            for n in df.columns
        ]
    )


def pack(df: DataFrame, channels=None, extras=(), output: str = "spectrum") -> DataFrame:
    """Wide table -> one ``array<double>`` column; the channel names move to its metadata.

    ``extras`` are numeric non-channel columns put after the channels, untransformed.
    """
    if channels is None:
        channels, _ = split_columns(df)
    names = [*channels, *extras]
    if not names:
        raise ValueError("no channel column found")
    packed = F.array(*[quoted(n).cast("double") for n in names])
    dropped = set(names)
    return df.select(
        *[quoted(c) for c in df.columns if c not in dropped],
        packed.alias(output, metadata=channel_metadata(names)),
    )


def channel_metadata(names) -> dict:
    return {"channels": [str(n) for n in names]}


def channel_names(df: DataFrame, spectrum: str = "spectrum") -> list[str] | None:
    """Channel names kept in the metadata of the spectrum column, if any."""
    return df.schema[spectrum].metadata.get("channels")


def unpack(df: DataFrame, names=None, spectrum: str = "spectrum") -> DataFrame:
    """``array<double>`` -> one column per channel, other columns first."""
    names = names or channel_names(df, spectrum)
    if not names:
        raise ValueError("channel names are neither given nor in the column metadata")
    others = [quoted(c) for c in df.columns if c != spectrum]
    return df.select(*others, *[F.col(spectrum).getItem(i).alias(n) for i, n in enumerate(names)])


def generic_names(count: int) -> list[str]:
    return [f"feature_{i}" for i in range(count)]


def component_names(count: int) -> list[str]:
    return [f"PC{i + 1}" for i in range(count)]


def to_long(df: DataFrame, key: str = "row_id", spectrum: str = "spectrum", names=None) -> DataFrame:
    """Spectrum -> rows ``(key, channel, wavelength, value)``; wavelength is NULL without names."""
    names = names or channel_names(df, spectrum)
    # the outer form: Spark puts a filter on the array below the inner one and so computes the array twice
    long = df.select(F.col(key), F.posexplode_outer(spectrum).alias("channel", "value")).filter(F.col("channel").isNotNull())
    if names and all(CHANNEL_NAME.match(str(n)) for n in names):
        place = F.get(F.array(*[F.lit(wavelength(str(n))) for n in names]), F.col("channel"))
    else:
        place = F.lit(None).cast("double")
    return long.select(key, "channel", place.alias("wavelength"), "value")


def from_long(long: DataFrame, key: str = "row_id", output: str = "spectrum") -> DataFrame:
    """Rows ``(key, channel, value)`` -> one spectrum per key, in channel order."""
    points = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return long.groupBy(key).agg(F.transform(points, lambda s: s["value"]).alias(output))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans do not count."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def filter_numeric(df: DataFrame, exclude=(), keep=()) -> DataFrame:
    """Drop ``exclude``; then exactly the existing ``keep`` columns, else the numeric ones."""
    gone = set(exclude)
    remaining = [c for c in df.columns if c not in gone]
    kept = [c for c in keep if c in remaining]
    if not kept:
        numeric = set(numeric_columns(df))
        kept = [c for c in remaining if c in numeric]
    return df.select(*[quoted(c) for c in kept])


def restrict_features(df: DataFrame, exclude=(), additional=None, always=()) -> DataFrame:
    """Drop ``exclude``; with ``additional`` keep the channels, these columns and ``always`` only."""
    gone = set(exclude)
    names = [c for c in df.columns if c not in gone]
    if additional:
        channels, _ = split_columns(names)
        names = [*channels, *[c for c in [*additional, *always] if c in names and c not in channels]]
    return df.select(*[quoted(c) for c in dict.fromkeys(names)])


def with_target(df: DataFrame, target: str, label: str = "label", required: bool = True) -> DataFrame:
    """Keep the target in its row, as a double named ``label``; error or NULL when it is missing."""
    if target in df.columns:
        others = [quoted(c) for c in df.columns if c not in (target, label)]
        return df.select(*others, quoted(target).cast("double").alias(label))
    if required:
        raise ValueError(f"target column '{target}' not found")
    return df.withColumn(label, F.lit(None).cast("double"))


def rename_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Fix column names; without a mapping the table is returned as it is."""
    return df.withColumnsRenamed(mapping) if mapping else df


def removed_columns(before, after) -> list[str]:
    """Names that are gone, in their old order."""
    left = set(after)
    return [n for n in before if n not in left]


def merged_columns(*groups) -> list[str]:
    """Union of name lists, first position wins."""
    return list(dict.fromkeys(n for group in groups for n in group))
