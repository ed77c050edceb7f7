"""Registration and the pieces shared by the query modules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.operators.columns import channel_metadata, unpack

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, folder) -> DataFrame`` under ``name``."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, spectrum, label)``: 64 channels named 900 ... 1530."""
    rows = table(spark, folder, "embeddings")
    packed = F.col("embedding").cast("array<double>")
    return rows.select(
        F.col("vec_id").alias("row_id"),
        packed.alias("spectrum", metadata=channel_metadata(NAMES)),
        F.col("label").cast("double").alias("label"),
    )


NAMES = [str(900 + 10 * i) for i in range(64)]


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """The same scans with one column per channel, ``Brix`` and a text column."""
    plain = spectra(spark, folder)
    named = plain.withColumn("Lab", F.concat(F.lit("lab"), F.col("label").cast("int").cast("string")))
    return unpack(named.withColumnRenamed("label", "Brix"))


def two_channels(spark: SparkSession, folder: str, first: int = 0, second: int = 1) -> DataFrame:
    return spectra(spark, folder).withColumn(
        "spectrum", F.array(F.col("spectrum")[first], F.col("spectrum")[second])
    )


def rounded(column, digits: int = 6):
    """Rounded double without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def long_values(df: DataFrame, *keys: str, spectrum: str = "spectrum", digits: int = 6) -> DataFrame:
    """``(keys..., k, v)`` with rounded values, for comparing array columns."""
    # the outer form: Spark puts a filter on the array below the inner one and so computes the array twice
    exploded = df.select(*keys, F.posexplode_outer(spectrum).alias("k", "v")).filter(F.col("k").isNotNull())
    return exploded.select(*keys, F.col("k").cast("long").alias("k"), rounded("v", digits).alias("v"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder (a temporary one on a local master without it)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="wavetable-")
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"


# SQL views used by many twins: scans, and their values in long form.
T = """t as (select vec_id as row_id, label::double as label,
  list_transform(embedding, lambda e: e::double) as x from embeddings)"""
L = "l as (select row_id, label, generate_subscripts(x, 1) - 1 as k, unnest(x) as v from t)"
SNV = """s as (select row_id, label, k,
  (v - avg(v) over (partition by row_id)) / stddev_pop(v) over (partition by row_id) as v from l)"""
MEAN = "c as (select k, avg(v) as m, stddev_pop(v) as s from l group by k)"
MSC = """fit as (select row_id, regr_slope(l.v, c.m) as slope, regr_intercept(l.v, c.m) as icept
  from l join c using (k) group by row_id),
 msc as (select l.row_id, l.label, l.k, (l.v - icept) / slope as v from l join fit using (row_id))"""


def savgol_view(source: str, name: str, deriv: int) -> str:
    """Closed form of the 15-point quadratic filter: slope 1/280, curvature around the mean 56/3."""
    value = {
        0: "mean + slope * o + curve * (o * o - 56.0 / 3)",
        1: "slope + 2 * curve * o",
        2: "2 * curve",
    }[deriv]
    return f"""{name}_w as (select a.row_id, a.label, a.k, a.k - least(greatest(a.k - 7, 0), 49) - 7 as o,
  b.k - least(greatest(a.k - 7, 0), 49) - 7 as i, b.v
  from {source} a join {source} b on a.row_id = b.row_id
  and b.k between least(greatest(a.k - 7, 0), 49) and least(greatest(a.k - 7, 0), 49) + 14),
 {name}_f as (select row_id, label, k, o, avg(v) as mean, sum(i * v) / 280.0 as slope,
  sum((i * i - 56.0 / 3) * v) / sum((i * i - 56.0 / 3) * (i * i - 56.0 / 3)) as curve
  from {name}_w group by row_id, label, k, o),
 {name} as (select row_id, label, k, {value} as v from {name}_f)"""


def values_of(view: str, digits: int = 6) -> str:
    return f"select row_id, k::bigint as k, round(v, {digits}) + 0.0 as v from {view}"


def with_views(*parts: str, body: str) -> str:
    return "with " + ",\n ".join(parts) + "\n" + body
