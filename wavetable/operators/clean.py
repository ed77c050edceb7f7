"""Duplicates, uninformative columns, missing values and sample ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.names import sample_id
from wavetable.operators.columns import numeric_columns, quoted
from wavetable.operators.position import with_position
from wavetable.session import durable

# Columns that together name a physical sample.
SAMPLE_COLUMNS = ["SAMPLE NO", "plant", "wetlab ID"]


#: Fingerprints that more than one row has are broadcast up to this number.
REPEATED = 1_000_000
PRINTS = ["__print_a", "__print_b"]


def fingerprinted(df: DataFrame, content: list[str]) -> DataFrame:
    """Add 128 bits that equal rows have in common; which columns are NULL counts as well."""
    columns = [quoted(c) for c in content]
    missing = [c.isNull() for c in columns]
    return df.withColumns({PRINTS[0]: F.xxhash64(*columns, *missing), PRINTS[1]: F.xxhash64(F.lit("row"), *missing, *columns)})


def repeated_prints(df: DataFrame, content: list[str]) -> DataFrame | None:
    """Fingerprints of more than one row; None if they are too many to broadcast. Only fingerprints are shuffled."""
    prints = fingerprinted(df, content).select(*PRINTS)
    found = durable(prints.groupBy(*PRINTS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*PRINTS))
    return F.broadcast(found) if found.count() <= REPEATED else None


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per distinct content; with ``row_id`` the smallest id of the copies is kept.

    Rows of a fingerprint of their own stay where they are. Only those that share one are shuffled and compared
    as a whole; copies are merged before that, so a row repeated very often is no hot spot. Beyond ``REPEATED``
    shared fingerprints all rows are compared that way.
    """
    content = [c for c in df.columns if c != row_id]

    def merged(rows: DataFrame) -> DataFrame:
        if row_id is None:
            return rows.dropDuplicates()
        kept = rows.groupBy(*[quoted(c) for c in content]).agg(F.min(row_id).alias(row_id))
        return kept.select(*[quoted(c) for c in df.columns])

    repeated = repeated_prints(df, content) if content else None
    if repeated is None:
        return merged(df)
    rows = fingerprinted(df, content)
    alone, shared = (rows.join(repeated, PRINTS, kind).select(*[quoted(c) for c in df.columns]) for kind in ("left_anti", "left_semi"))
    return alone.unionByName(merged(shared))


def duplicate_census(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: members of any duplicate group, and how many rows removal would drop."""
    content = [c for c in df.columns if c != row_id]
    repeated = repeated_prints(df, content) if content else None
    rows = df if repeated is None else fingerprinted(df, content).join(repeated, PRINTS, "left_semi")
    copies = rows.groupBy(*[quoted(c) for c in content]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("removed_rows"),
    )


def column_profile(df: DataFrame) -> dict[str, tuple[int, int, bool]]:
    """``{column: (rows, present values, min equals max)}`` from one aggregation, no distinct."""
    orderable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spans = [F.count(F.lit(1)).alias("n")]
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    for i, name in enumerate(df.columns):
        column = F.when(~F.isnan(quoted(name)), quoted(name)) if name in floating else quoted(name)
        spans.append(F.count(column).alias(f"c{i}"))
        if name in orderable:
            spans.append(F.min(column).eqNullSafe(F.max(column)).alias(f"e{i}"))
    row = df.agg(*spans).first()
    return {
        name: (row["n"], row[f"c{i}"], bool(row[f"e{i}"]) if name in orderable else False)
        for i, name in enumerate(df.columns)
    }


def empty_columns(df: DataFrame, profile=None) -> list[str]:
    profile = profile or column_profile(df)
    return [c for c, (_, present, _) in profile.items() if present == 0]


def constant_columns(df: DataFrame, profile=None) -> list[str]:
    """Columns with at most one value, where a missing value counts as a value."""
    profile = profile or column_profile(df)
    return [
        c
        for c, (rows, present, level) in profile.items()
        if rows == 0 or present == 0 or (present == rows and level)
    ]


def drop_uninformative(
    df: DataFrame, empty: bool = True, constant: bool = True, keep=()
) -> DataFrame:
    """Drop empty and constant columns; ``keep`` names columns that always stay."""
    profile = column_profile(df)
    gone = set(empty_columns(df, profile)) if empty else set()
    if constant:
        gone |= {c for c in constant_columns(df, profile) if c not in gone}
    gone -= set(keep)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def require_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label; an error when there is none."""
    labelled = df.filter(F.col(label).isNotNull())
    if labelled.isEmpty():
        raise ValueError(f"no row has a value in '{label}'")
    return labelled


def impute(df: DataFrame, exclude=()) -> DataFrame:
    """Missing numbers -> column mean; other missing values -> most frequent, ties to the smallest.

    The numeric means come from one aggregation. The most frequent text value needs counts per
    value: they are pre-aggregated before the shuffle and one row per column comes back.
    """
    skipped = set(exclude)
    numeric = [c for c in numeric_columns(df) if c not in skipped]
    texts = [
        f.name for f in df.schema
        if f.name not in skipped and isinstance(f.dataType, (T.StringType, T.BooleanType))
    ]
    fills: dict[str, object] = {}
    if numeric:
        means = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        fills.update({c: means[f"m{i}"] for i, c in enumerate(numeric)})
    if texts:
        fills.update(most_frequent(df, texts))
    out = []
    for name in df.columns:
        column = quoted(name)
        fill = fills.get(name)
        out.append(column if fill is None else F.coalesce(column, F.lit(fill)).alias(name))
    return df.select(*out)


def most_frequent(df: DataFrame, columns) -> dict[str, object]:
    """``{column: most frequent present value}``, ties to the smallest value."""
    kinds = {f.name: f.dataType for f in df.schema}
    entries = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in columns]
        )
    )
    counts = (
        df.select(entries.alias("entry"))
        .select("entry.*")
        .filter("value is not null")
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    top = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("copies"), "value")).alias("value"))
    found = {row["name"]: row["value"] for row in top.collect()}
    return {
        c: (v == "true") if isinstance(kinds[c], T.BooleanType) else v for c, v in found.items()
    }


def add_sample_id(df: DataFrame, row_id: str = "row_id", output: str = "Sample_ID") -> DataFrame:
    """Id of the physical sample, or ``sample_{i}`` by position when its columns are missing."""
    if all(c in df.columns for c in SAMPLE_COLUMNS):
        return df.withColumn(output, sample_id(*[quoted(c) for c in SAMPLE_COLUMNS]))
    numbered = with_position(df, row_id, output="__position")
    return numbered.withColumn(
        output, F.concat(F.lit("sample_"), F.col("__position").cast("string"))
    ).drop("__position")
