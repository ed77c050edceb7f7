"""Reading scans and writing prepared data sets."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetable.operators.clean import REPEATED
from wavetable.operators.columns import channel_names, generic_names, nan_to_null, quoted, unpack
from wavetable.operators.position import SLICE_ROWS
from wavetable.operators.stats import long_metrics
from wavetable.session import durable

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    for suffix, name in FORMATS.items():
        if path.rstrip("/").lower().endswith(suffix):
            return name
    raise ValueError(f"unsupported file format: {path}; use one of {', '.join(FORMATS)}")


def read_table(
    spark: SparkSession, path: str, schema=None, format: str | None = None, row_id: str | None = "row_id", ids: str = "position"
) -> DataFrame:
    """Scan table by file suffix, missing values as NULL, with an increasing ``row_id``.

    ``ids="content"`` gives ids that do not depend on how the files are cut: see ``content_id``.
    Pass a schema in production: inferring one reads a text source twice.
    """
    format = format or format_of(path)
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("nanValue", "NaN")
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("inferSchema", True)
    df = nan_to_null(reader.load(path))
    if ids not in ("position", "content"):
        raise ValueError(f"unknown ids: {ids}")
    if row_id and row_id not in df.columns:
        if ids == "content":
            return content_id(df, output=row_id).select(row_id, *[quoted(c) for c in df.columns])
        df = df.select(F.monotonically_increasing_id().alias(row_id), *[quoted(c) for c in df.columns])
    return df


def content_id(df: DataFrame, columns=None, output: str = "row_id") -> DataFrame:
    """Text id ``<128 bits of the content>-<copy>``: a table has the same ids in every run and file layout.

    Copies of a row are numbered from 0; as they are alike, it does not matter which gets which number. Only
    contents that more than one row has are numbered, each in as many slices as its copies need, so neither a global
    sort nor a hot key is needed. Rows alike in ``columns`` alone count as copies, and their numbers are arbitrary.
    """
    columns = columns or df.columns
    mark, copies, part, place = "__content", "__copies", "__part", "__place"
    values = [quoted(c) for c in columns]
    missing = [c.isNull() for c in values]
    digits = [F.lower(F.lpad(F.hex(h), 16, "0")) for h in (F.xxhash64(*values, *missing), F.xxhash64(F.lit("row"), *missing, *values))]
    marked = df.withColumn(mark, F.concat(*digits))
    repeated = durable(marked.groupBy(mark).agg(F.count(F.lit(1)).alias(copies)).filter(F.col(copies) > 1))
    known = F.broadcast(repeated) if repeated.count() <= REPEATED else repeated
    alone = marked.join(known, mark, "left_anti").withColumn(output, F.concat(mark, F.lit("-0")))
    slices = F.ceil(F.col(copies) / SLICE_ROWS)
    # written, so that counts and numbers see the same slices
    shared = durable(marked.join(known, mark).withColumn(part, F.pmod(F.monotonically_increasing_id(), slices)))
    sizes = shared.groupBy(mark, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(mark).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(mark, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(place))
    inside = F.row_number().over(Window.partitionBy(mark, part).orderBy(F.lit(0))) - 1
    numbered = shared.withColumn("__inside", inside).join(starts, [mark, part])
    numbered = numbered.withColumn(output, F.concat_ws("-", F.col(mark), (F.col(place) + F.col("__inside")).cast("string")))
    kept = [*[quoted(c) for c in df.columns if c != output], F.col(output)]
    return alone.select(*kept).unionByName(numbered.select(*kept))


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    if format not in FORMATS.values():
        raise ValueError(f"unsupported format: {format}")
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def split_table(df: DataFrame, row_id: str = "row_id", split: str = "split") -> DataFrame:
    return df.select(F.col(row_id).alias("index"), F.col(split).alias("split"))


def write_dataset(
    df: DataFrame, folder: str, report: dict | None = None, model: PipelineModel | None = None,
    format: str = "parquet", row_id: str = "row_id", spectrum: str = "spectrum", label: str = "label",
    split: str = "split",
) -> None:
    """``features/``, ``target/``, ``splits/``, ``report/`` and, with a model, ``model/``.

    Text formats get one column per channel; parquet and orc keep the spectrum as an array.
    """
    features = df.drop(label)
    if format == "csv":
        names = channel_names(df, spectrum)
        if not names:
            names = generic_names(df.agg(F.max(F.size(spectrum)).alias("p")).first()["p"] or 0)
        features = unpack(features, names, spectrum)
    has_split = split in df.columns
    write_table(features, f"{folder}/features", format, [split] if has_split else ())
    if label in df.columns:
        write_table(df.select(row_id, label), f"{folder}/target", format)
    if has_split:
        write_table(split_table(df, row_id, split), f"{folder}/splits", format)
    if report is not None:
        write_json(df.sparkSession, report, f"{folder}/report")
    if model is not None:
        model.write().overwrite().save(f"{folder}/model")


def write_json(spark: SparkSession, info: dict, path: str) -> None:
    """One small JSON document."""
    row = spark.createDataFrame([(json.dumps(info, default=str, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def prediction_table(df: DataFrame, label: str = "label", prediction: str = "prediction", keys=()) -> DataFrame:
    """``(keys..., actual, predicted, error)`` with error = actual - predicted."""
    return df.select(
        *keys, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
        (F.col(label) - F.col(prediction)).alias("error"),
    )


def metrics_table(metrics: DataFrame, keys=("experiment", "split")) -> DataFrame:
    """Wide metrics as ``(experiment, split, metric, value)``."""
    return long_metrics(metrics, list(keys))


def selected_table(channels: DataFrame) -> DataFrame:
    """Selected channels as ``(feature_index, wavelength)``."""
    return channels.filter("selected").select(F.col("channel").alias("feature_index"), "wavelength")


def save_model(model, path: str, info: dict | None = None, spark: SparkSession | None = None) -> str:
    """A fitted pipeline and its info document below ``path``."""
    spark = spark or SparkSession.getActiveSession()
    if not isinstance(model, PipelineModel):
        model = PipelineModel(stages=[model])
    model.write().overwrite().save(f"{path}/model")
    write_json(spark, info or {}, f"{path}/info")
    return path


def load_model(path: str, spark: SparkSession | None = None):
    """``(pipeline model, info)``."""
    spark = spark or SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), read_json(spark, f"{path}/info")
