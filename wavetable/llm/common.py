"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wavetable-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_file(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later passes read the table instead of recomputing it, also after executors were lost. An empty
    table keeps its schema. Nobody reads the shuffles of the write again, so they don't wait for a garbage collection.
    """
    spark = df.sparkSession
    path = shared_file(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Texts, and bytes of them, that a worker and its JVM hold at once; the operators cut a batch into such pieces anyway.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks get texts in batches of bounded size; Spark's own take 10,000 rows, however long."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as a string; a null text has a key of its own."""
    text = text.cast("string")
    return F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit("text"), text)))


def fresh(*taken: str, base: str) -> str:
    """A column name that is not in ``taken``; names compare without case, as Spark's do."""
    used = {t.lower() for t in taken}
    name = base
    while name.lower() in used:
        name = "_" + name
    return name


def slices_for(rows: int) -> int:
    """Slices of a numbering: each stays small however many rows one group has."""
    return max(64, rows // 100_000)


def number_within(df: DataFrame, groups: list[str], order: list[Column], name: str, slices: int) -> DataFrame:
    """Add ``name``: a number from 0 without gaps within each group.

    Every group is cut into ``slices`` by a hash of ``order``; a window numbers each slice and the counts of
    the slices before it are added. So a group that holds most rows is spread over many tasks, and the
    window over the counts sees ``slices`` rows a group. ``df`` is read twice: pass a written table.
    """
    part, before = fresh(*df.columns, base="slice"), fresh(*df.columns, base="before")
    cut = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*groups, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = Window.partitionBy(*groups, part).orderBy(*order)
    local = cut.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return local.join(offsets, [*groups, part]).withColumn(name, F.col(name) + F.col(before)).drop(part, before)
