"""Merkle manifest of a dataset: a ternary hash tree per source, and one over the sources.

Leaves are sorted by range and numbered within their tree. Every ``BLOCK`` consecutive nodes are a superblock,
which one task reduces to one node; the nodes of all superblocks are the next, much smaller table, until each
tree has one node left. Proofs go the other way: the siblings above a superblock are one row, its outer nodes,
and are cogrouped with the superblock. There the lower levels are reduced again, joined with the outer nodes and
folded. So no task holds more than a superblock and nothing but a count for each partition reaches the driver.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import written

#: Children of a node, and levels of a superblock.
WIDTH, LEVELS = 3, 7
BLOCK = WIDTH**LEVELS


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def tree_key(source: Column) -> Column:
    """A string that sorts as the source does bytewise, with null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``position``: numbers from 0 within ``tree`` by ``order``; ``tree`` may hold most rows.

    Rows are dealt by ranges of (tree, order). In a range only the first tree can have rows in earlier ranges, so
    one number for each range, how many those are, makes local numbers global.
    """
    spark = nodes.sparkSession
    ranges = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = T.StructType([*nodes.schema.fields, T.StructField("chunk", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("local", T.LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        chunk, seen, last, inside = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            trees = batch.column(batch.schema.names.index("tree")).to_pylist()
            local = np.empty(len(trees), np.int64)
            for i, tree in enumerate(trees):
                inside = inside + 1 if tree == last else 0
                local[i], last = inside, tree
            columns = [pa.array(np.full(len(trees), chunk, np.int32)), pa.array(np.arange(seen, seen + len(trees))), pa.array(local)]
            seen += len(trees)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    placed = written(ranges.mapInArrow(count, schema))
    ends = placed.groupBy("chunk").agg(
        F.min_by("tree", "place").alias("first"), F.max_by("tree", "place").alias("last"), F.max_by("local", "place").alias("n")
    )
    carried, rows = 0, []
    previous = None
    for r in sorted(ends.collect()):  # one row a partition
        carried = carried if r["first"] == previous else 0
        rows.append((r["chunk"], r["first"], carried))
        carried = r["n"] + 1 + (carried if r["first"] == r["last"] else 0)
        previous = r["last"]
    # bounded: one row a partition
    before = F.broadcast(spark.createDataFrame(rows, "chunk int, first string, before long"))
    earlier = F.when(F.col("tree") == F.col("first"), F.col("before")).otherwise(0)
    return placed.join(before, "chunk").withColumn("position", F.col("local") + earlier).drop("chunk", "place", "local", "first", "before")


def levels_of(nodes: list[str], block: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes to the one above them.

    Only a tree's first superblock can be the whole tree, which ends at its only node; if it is full, that is at
    ``LEVELS`` as well. Any other one goes up all levels, a single node alone too.
    """
    levels = [nodes]
    while len(levels) <= LEVELS and (block or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])
    return levels


def siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """The nodes left and right of node ``i``'s ancestors in their runs, level by level."""
    left, right = [], []
    for level in levels[:-1]:
        low = i - i % WIDTH
        left.append("".join(level[low:i]))
        right.append("".join(level[i + 1 : low + WIDTH]))
        i //= WIDTH
    return left, right


def grouped(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("position") / BLOCK).cast("long")).groupBy("tree", "block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, position, node) from ``nodes`` to one row a tree, all but the first written."""

    def reduce(key, rows):
        levels = levels_of(rows.sort_values("position")["node"].tolist(), key[1])
        return pd.DataFrame({"tree": [key[0]], "position": [key[1]], "node": levels[-1]})

    tables = [nodes]
    while tables[-1].filter(F.col("position") > 0).limit(1).count():
        small = grouped(tables[-1].select("tree", "position", "node"))
        tables.append(written(small.applyInPandas(reduce, "tree string, position long, node string")))
    return tables


PATH = "array<string>"
OUTER = f"tree string, position long, left {PATH}, right {PATH}"


def descend(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Outer nodes of the lowest table's superblocks, from those of the ``top`` (tree, position, left, right)."""

    def split(key, rows, outer):
        rows = rows.sort_values("position")
        levels = levels_of(rows["node"].tolist(), key[1])
        above = outer.iloc[0]
        paths = [siblings(levels, i) for i in range(len(rows))]
        return pd.DataFrame(
            {
                "tree": rows["tree"], "position": rows["position"],
                "left": [left + list(above["left"]) for left, _ in paths], "right": [right + list(above["right"]) for _, right in paths],
            }
        )

    outer = top
    for table in tables[:0:-1]:
        below = grouped(table.select("tree", "position", "node"))
        outer = written(below.cogroup(outer.withColumnRenamed("position", "block").groupBy("tree", "block")).applyInPandas(split, OUTER))
    return outer


def manifest(docs: DataFrame, id_col: str = "doc_id", columns=("source", "lang", "n_chars", "text")) -> DataFrame:
    """Leaves, roots and proofs of every row, and the root folded after a trial tampering.

    (id, leaf, subroot, root, proof_sha256, folded_root, verified). The first of ``columns`` names the tree, the last
    the text. Leaves of a tree ascend by id, null first, and by their digest where ids repeat; repeated rows are
    leaves of their own. Where 2 divides the CRC of the decimal id, the text loses its line ends before the leaf
    is folded; null texts and null ids stay as they are. A lone leaf is its tree's root. No rows, no rows.
    """
    source, text = F.col(columns[0]), F.col(columns[-1]).cast("string")
    given = [F.col(id_col), *[F.col(c) for c in columns[:-1]]]
    tampered = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    changed = F.when(tampered, leaf_of([*given, F.replace(text, F.lit("\n"), F.lit(""))]))
    # rows that are equal in all else are told apart, so that a range holds no more of them than of others
    rows = docs.select(
        tree_key(source).alias("tree"), F.col(id_col).alias("id"), leaf_of([*given, text]).alias("node"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = numbered(written(rows), ["id", "node", "row"]).drop("row")
    trees = climb(leaves)
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    forest = climb(numbered(subroots, ["source"]))
    root = forest[-1].select("node").limit(1)
    empty = F.array().cast(PATH)
    top = forest[-1].select("tree", F.lit(0).cast("long").alias("position"), empty.alias("left"), empty.alias("right"))
    if len(forest) == 1:  # one source: its subroot is the root
        over = forest[0].select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("position"), empty.alias("left"), empty.alias("right"))
    else:
        paths = leaf_paths(forest, descend(forest, top))
        over = paths.withColumnsRenamed({"source": "tree"}).withColumn("position", F.lit(0).cast("long"))
    ends = trees[-1].select("tree", F.col("node").alias("subroot"))
    outer = descend(trees, over.select("tree", "position", "left", "right"))
    found = root.first()
    return folded(trees, outer, ends, found["node"] if found else None, id_col)


def leaf_paths(tables: list[DataFrame], outer: DataFrame) -> DataFrame:
    """(source, left, right) of every node of the lowest table."""

    def join(key, rows, outer):
        rows = rows.sort_values("position")
        levels, above = levels_of(rows["node"].tolist(), key[1]), outer.iloc[0]
        paths = [siblings(levels, i) for i in range(len(rows))]
        return pd.DataFrame({"source": rows["source"], "left": [x + list(above["left"]) for x, _ in paths], "right": [x + list(above["right"]) for _, x in paths]})

    over = outer.withColumnRenamed("position", "block").groupBy("tree", "block")
    return grouped(tables[0]).cogroup(over).applyInPandas(join, f"source string, left {PATH}, right {PATH}")


def folded(tables: list[DataFrame], outer: DataFrame, ends: DataFrame, root: str | None, id_col: str) -> DataFrame:
    """The result rows: local reduction, proofs joined with the outer nodes, and folding, a superblock at a time."""
    leaves = tables[0]
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField(id_col, leaves.schema["id"].dataType), *[T.StructField(t, T.StringType()) for t in texts], T.StructField("verified", T.BooleanType())])

    def fold(key, rows, outer):
        rows = rows.sort_values("position")
        nodes, changed, above = rows["node"].tolist(), rows["changed"].tolist(), outer.iloc[0]
        levels = levels_of(nodes, key[1])
        high_left, high_right = list(above["left"]), list(above["right"])
        high = "".join(a + b for a, b in zip(high_left, high_right))
        proofs, roots = [], []
        for i, (node, other) in enumerate(zip(nodes, changed)):
            left, right = siblings(levels, i)
            proofs.append(digest("".join(a + b for a, b in zip(left, right)) + high))
            now = other if isinstance(other, str) else node
            for a, b in zip(left + high_left, right + high_right):
                now = digest(a + now + b)
            roots.append(now)
        return pd.DataFrame(
            {
                id_col: rows["id"], "leaf": nodes, "subroot": above["subroot"], "root": root, "proof_sha256": proofs,
                "folded_root": roots, "verified": [r == root for r in roots],
            }
        )

    over = outer.join(ends, "tree").withColumnRenamed("position", "block").groupBy("tree", "block")
    return grouped(leaves.select("tree", "position", "id", "node", "changed")).cogroup(over).applyInPandas(fold, schema)
