"""Whole trees grown in the JVM of the executors: ``java/Grower.java``, compiled by the Janino that Spark brings along.

The source is compiled once a session on the driver and sent as a jar, as any jar of a session is.
"""

from __future__ import annotations

import tempfile
import threading
import zipfile
from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

SOURCE = "Grower.java"
TREES = "array<struct<model int, tree int, arrays binary>>"
SUMS = "array<struct<model int, depth int, split int, low int, stop int, sums binary>>"
#: The columns of a tree as the JVM gives them.
COLUMNS = (("feature", "<i4"), ("bin", "<i4"), ("left", "<i4"), ("rows", "<i4"), ("depth", "<i4"), ("value", "<f8"), ("weight", "<f8"), ("gain", "<f8"))

_compiled: dict = {}
_lock = threading.Lock()


def grower(spark: SparkSession):
    """The compiled class, which the executors of this session have too."""
    context = spark.sparkContext
    with _lock:
        if context.applicationId not in _compiled:
            _compiled[context.applicationId] = compile_for(context)
    return _compiled[context.applicationId]


def compile_for(context):
    jvm = context._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(files("wavetable").joinpath("java", SOURCE).read_text())
    code = compiler.getBytecodes()
    jar = tempfile.NamedTemporaryFile(prefix="wavetable-", suffix=".jar", delete=False).name
    with zipfile.ZipFile(jar, "w") as out:
        for name in code:
            out.writestr(name.replace(".", "/") + ".class", bytes(code[name]))
    context._jsc.addJar(jar)
    return compiler.getClassLoader().loadClass("wavetable.Grower")


def array(spark, values):
    context = spark.sparkContext
    out = context._gateway.new_array(context._jvm.java.lang.Object, len(values))
    for i, value in enumerate(values):
        out[i] = value
    return out


def jvm_table(data):
    """A binned table as a broadcast of the JVM; its rows do not pass through Python."""
    spark = data.table.sparkSession
    make = next(m for m in grower(spark).getMethods() if m.getName() == "table")
    rows = data.ordered.select("key", "fold", "label", "bins")._jdf
    return spark.sparkContext._jsc.broadcast(make.invoke(None, array(spark, [rows, float(data.mean), data.channels])))


def grown_in_jvm(data, families: list[list[tuple]], tasks: DataFrame, poisson, least: float, cuts=None) -> DataFrame:
    """Trees of tasks ``(family, low, high)``, or with ``cuts`` the held-out sums of these.

    A family has growths with their numbers, the smallest leaves first; ``cuts`` are (trees, depth, least rows of a split)
    for each number, -1 for any depth.
    """
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    spec = [len(families)]
    for family in families:
        g = family[0][1]
        none = lambda value: -1 if value is None else value
        spec += [none(g.fold), int(g.bootstrap), g.seed, g.rule.min_split, none(g.rule.max_depth), none(g.rule.node_channels), len(family)]
        for number, growth in family:
            mine = cuts[number] if cuts else []
            spec += [number, growth.rule.min_leaf, len(mine), *(value for cut in mine for value in cut)]
    spark = tasks.sparkSession
    context = spark.sparkContext
    values = [data.compiled, bytes(np.array(spec, np.int64)), bytes(np.asarray(poisson, float)), float(least), data.channels, cuts is not None]
    made = grower(spark).getConstructors()[0].newInstance(array(spark, values))
    kind = spark._jsparkSession.parseDataType(_parse_datatype_string(SUMS if cuts else TREES).json())
    found = Classic(made.function(kind).apply(_to_seq(context, ["family", "low", "high"], _to_java_column)))
    return tasks.select(found.alias("found")).select(F.inline("found"))


def columns_of(data: bytes) -> dict[str, np.ndarray]:
    """A tree as the JVM gives it."""
    count, at, out = len(data) // 44, 0, {}
    for name, kind in COLUMNS:
        out[name] = np.frombuffer(data, kind, count, at)
        at += out[name].nbytes
    return out
