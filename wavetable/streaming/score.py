"""Scoring scans as they arrive.

Fitted corrections, detectors, selections and regressors hold no state per row, so one fitted
pipeline transforms a stream exactly as it transforms a table. Files of a folder, or any other
stream with the spectrum column, are read; scored rows are appended to a sink with a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wavetable.operators.columns import pack


def read_scans(spark: SparkSession, folder: str, schema, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files that appear in ``folder``."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def score_stream(scans: DataFrame, model, spectrum: str = "spectrum", channels=None) -> DataFrame:
    """Model output for every scan; wide scans are packed first."""
    if spectrum not in scans.columns:
        scans = pack(scans, channels, output=spectrum)
    return model.transform(scans)


def write_scores(scores: DataFrame, folder: str, checkpoint: str, format: str = "parquet", once: bool = True, keep=None) -> StreamingQuery:
    """Append scored rows; ``once`` handles what is there and stops, else the query keeps running."""
    rows = scores.select(*[F.col(c) for c in keep]) if keep else scores
    writer = rows.writeStream.format(format).outputMode("append").option("path", folder)
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
