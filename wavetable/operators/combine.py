"""Joins, grids and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def beside(left: DataFrame, right: DataFrame, key: str = "row_id", how: str = "inner") -> DataFrame:
    """Columns of both tables side by side, aligned on ``key``; ``full_outer`` keeps lone rows."""
    return left.join(right, key, how)


def surviving(rows: DataFrame, kept: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is still in ``kept``."""
    return rows.join(kept.select(key), key, "left_semi")


def removed(rows: DataFrame, kept: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is no longer in ``kept``."""
    return rows.join(kept.select(key), key, "left_anti")


def apply_channel_params(long: DataFrame, params: DataFrame, key: str = "channel") -> DataFrame:
    """Long spectra with the fitted parameters of their channel.

    The parameter table has one row per channel; the planner chooses the join by its measured size.
    """
    return long.join(params, key)


def experiment_grid(models: DataFrame, methods: list[dict]) -> DataFrame:
    """Every model row with every selection method; the method list is a literal, no join is made."""
    keys = list(dict.fromkeys(k for m in methods for k in m))
    options = F.array(*[F.struct(*[F.lit(m.get(k)).alias(k) for k in keys]) for m in methods])
    return models.select("*", F.explode(options).alias("__m")).select(*models.columns, "__m.*")


def append_rows(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are NULL there."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked


def names_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.subtract(right)


def names_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def merged_params(defaults: Column, given: Column) -> Column:
    """Two string maps as one; ``given`` wins on equal keys."""
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(rest, given)
