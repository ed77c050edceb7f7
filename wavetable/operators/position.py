"""Exact positions, cut points and quantiles without a single-task sort.

A global ``row_number`` sorts the whole table in one task. Here the key space is counted in
buckets first (a small, map-side combined aggregation); only the bucket that holds the wanted rank
is looked at again. Splits and folds then become plain comparisons with a literal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
HEX_DIGITS = 3
VALUE_SLICES = 16
SMALL = 20_000
SLICE_ROWS = 500_000


def shuffle_key(row_id: str | Column, seed: int = 42) -> Column:
    """``md5(seed:row_id)``: a reproducible random order key, the same on every engine; rows without an id share one."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))))


def cut_points(df: DataFrame, key: Column, number: Column, ranks_of, low: int, high: int) -> tuple[int, dict[int, object]]:
    """``(rows, {rank: key of the row at that 1-based rank})`` in key order.

    ``number`` is a long that never decreases with ``key`` and lies in ``[low, high]``;
    ``ranks_of(rows)`` names the wanted ranks. Each pass counts ``BINS`` bins inside every interval
    that may still hold a wanted rank; the first one also yields the row count.
    """
    keyed = df.select(key.alias("k"), number.alias("x"))
    total, spans, found = None, [(low, high, 0, None)], {}
    while spans:
        counts = _bin_counts(keyed, [(lo, hi, _width(lo, hi)) for lo, hi, _, _ in spans])
        if total is None:
            total = sum(n for _, n in counts[0])
            spans = [(low, high, 0, sorted({int(r) for r in ranks_of(total) if 0 < r <= total}))]
        following, finals = [], []
        for (lo, hi, position, wanted), bins in zip(spans, counts):
            for place, n in bins:
                here = [r for r in wanted if position < r <= position + n]
                if here:
                    start = lo + place * _width(lo, hi)
                    stop = min(hi, start + _width(lo, hi) - 1)
                    (finals if n <= SMALL or start == stop else following).append((start, stop, position, here))
                position += n
        if finals:
            found.update(_keys_at(keyed, finals))
        spans = following
    return total, found


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low + 1) // BINS))


def _bin_counts(keyed: DataFrame, pieces) -> list[list[tuple[int, int]]]:
    """Per piece ``(low, high, width)`` the ``(bin, rows)`` pairs, in order; at most BINS each."""
    x = F.col("x")
    bins = [F.expr(f"(x - ({lo}L)) div {w}L") for lo, _, w in pieces]
    if len(pieces) == 1:
        lo, hi, _ = pieces[0]
        placed = keyed.filter(x.between(F.lit(lo), F.lit(hi))).select(F.lit(0).alias("span"), bins[0].alias("bin"))
    else:
        # intervals do not overlap
        span, place = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi, _) in enumerate(pieces):
            inside = x.between(F.lit(lo), F.lit(hi))
            span, place = F.when(inside, F.lit(i)).otherwise(span), F.when(inside, bins[i]).otherwise(place)
        placed = keyed.select(span.alias("span"), place.alias("bin")).filter("span is not null")
    rows = placed.groupBy("span", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for row in rows:
        out[row["span"]].append((row["bin"], row["n"]))
    return [sorted(part) for part in out]


def _keys_at(keyed: DataFrame, finals) -> dict[int, object]:
    """Keys at ranks inside short intervals; equal keys are counted before they are compared."""
    wanted = F.lit(False)
    for start, stop, _, _ in finals:
        wanted = wanted | F.col("x").between(F.lit(start), F.lit(stop))
    rows = keyed.filter(wanted).groupBy("x", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["x"], r["k"]))
    found = {}
    for start, stop, below, ranks in finals:
        position = below
        for row in rows:
            if start <= row["x"] <= stop:
                for rank in ranks:
                    if position < rank <= position + row["n"]:
                        found[rank] = row["k"]
                position += row["n"]
    return found


def hash_cut_points(df: DataFrame, row_id: str, ranks_of, seed: int = 42) -> tuple[int, dict[int, str]]:
    """The same for the ``md5`` order, counted by hex prefixes: three digits are 4096 even bins."""
    keyed = df.select(shuffle_key(row_id, seed).alias("k"))
    total, digits, found = None, HEX_DIGITS, {}
    spans: dict[str, tuple[int, list[int]]] = {"": (0, [])}
    finals: dict[str, tuple[int, list[int]]] = {}
    while spans:
        inside = keyed if total is None else keyed.filter(F.substring("k", 1, digits - HEX_DIGITS).isin(list(spans)))
        rows = inside.groupBy(F.substring("k", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = sorted((r["p"], r["n"]) for r in rows)
        if total is None:
            total = sum(n for _, n in counts)
            spans = {"": (0, sorted({int(r) for r in ranks_of(total) if 0 < r <= total}))}
        following = {}
        for parent, (position, wanted) in spans.items():
            for prefix, n in (c for c in counts if c[0].startswith(parent)):
                here = [r for r in wanted if position < r <= position + n]
                if here and digits >= 32:
                    found.update({r: prefix for r in here})
                elif here:
                    (finals if n <= SMALL else following)[prefix] = (position, here)
                position += n
        spans, digits = following, digits + HEX_DIGITS
    if finals:
        starts = F.lit(False)
        for size in {len(p) for p in finals}:
            starts = starts | F.substring("k", 1, size).isin([p for p in finals if len(p) == size])
        keys = sorted(r["k"] for r in keyed.filter(starts).collect())
        for prefix, (position, wanted) in finals.items():
            mine = [k for k in keys if k.startswith(prefix)]
            found.update({r: mine[r - position - 1] for r in wanted})
    return total, found


def id_cut_points(df: DataFrame, row_id: str, ranks_of) -> tuple[int, dict[int, int]]:
    """Row count and cut points of an integer id."""
    span = df.agg(F.min(row_id).alias("lo"), F.max(row_id).alias("hi")).first()
    if span["lo"] is None:
        return 0, {}
    key = F.col(row_id).cast("long")
    return cut_points(df, key, key, ranks_of, int(span["lo"]), int(span["hi"]))


def with_position(df: DataFrame, row_id: str, output: str = "position", rows_per_task: int = 2_000_000) -> DataFrame:
    """0-based position in the order of an integer id.

    Approximate quantiles cut the id range into tasks of similar size however many there are, exact
    counts give each task its offset, and the numbering runs inside the tasks in parallel.
    """
    total = df.count()
    tasks = int(max(1, -(-total // rows_per_task)))
    edges: list[int] = []
    if tasks > 1:
        shares = [i / tasks for i in range(1, tasks)]
        found = df.agg(F.percentile_approx(F.col(row_id).cast("long"), shares, 10 * tasks)).first()[0]
        edges = sorted(set(int(e) for e in found or []))
    bounds = np.asarray(edges, dtype=np.int64)

    def locate(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(ids), side="left").astype(np.int32))

    bucket = F.arrow_udf(locate, T.IntegerType())(F.col(row_id).cast("long")) if edges else F.lit(0)
    placed = df.withColumn("__bucket", bucket)
    sizes = {r["__bucket"]: r["n"] for r in placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, running = [], 0
    for i in range(len(edges) + 1):
        offsets.append((i, running))
        running += sizes.get(i, 0)
    starts = df.sparkSession.createDataFrame(offsets, "__bucket int, __start long")  # one row a task
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(row_id))
    numbered = placed.withColumn("__inside", inside).join(F.broadcast(starts), "__bucket")
    return numbered.withColumn(output, F.col("__start") + F.col("__inside") - 1).drop("__bucket", "__start", "__inside")


def rank_within(df: DataFrame, groups, row_id: str, seed: int = 42, output: str = "rank", digits: int | None = None) -> DataFrame:
    """1-based rank in ``md5`` order inside each group, plus the group size ``<output>_of``.

    A group is cut into ``16 ** digits`` even slices by key prefix, so that one group holding much of
    the table is still ranked by many tasks. Without ``digits`` the largest group's size sets them.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    if digits is None:
        largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
        digits = 2
        while largest > SLICE_ROWS * 16**digits:
            digits += 1
    keyed = df.withColumn("__key", shuffle_key(row_id, seed))
    sliced = keyed.withColumn("__slice", F.substring("__key", 1, digits))
    counts = sliced.groupBy(*groups, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    in_group = Window.partitionBy(*groups)
    counts = counts.select(
        *groups,
        "__slice",
        (F.sum("__n").over(in_group.orderBy("__slice")) - F.col("__n")).alias("__below"),
        F.sum("__n").over(in_group).alias(f"{output}_of"),
    )
    keys = [*groups, "__slice"]
    renamed = counts.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__below", f"{output}_of")
    match = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        match = equal if match is None else match & equal
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("__key", row_id))
    ranked = sliced.withColumn("__local", local).join(renamed, match, "left")
    ranked = ranked.withColumn(output, (F.col("__below") + F.col("__local")).cast("long"))
    return ranked.select(*df.columns, output, f"{output}_of")


def value_at(data: DataFrame, rank: int, rows: int, accuracy: int = 10_000) -> float:
    """Value of column ``__v`` at a 1-based rank of ``rows`` values, with NaN last.

    Sketches narrow an interval until what is inside can be collected. Counts decide each step, so the
    value is exact, and every step leaves out at least one value.
    """
    v, below = F.col("__v"), 0
    while rows > SMALL:
        share, margin = (rank - below) / rows, 4.0 / accuracy
        shares = [max(0.0, share - margin), min(1.0, share + margin)]
        low, high = map(F.lit, data.agg(F.percentile_approx("__v", shares, accuracy)).first()[0])
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & (high > low), v > high]
        counts = data.agg(*[F.count_if(part) for part in parts]).first()
        for i, (part, n) in enumerate(zip(parts, counts)):
            if rank <= below + n:
                break
            below += n
        if i in (1, 3):
            return data.filter(part).first()["__v"]
        data, rows = data.filter(part), n
    values = sorted((r["__v"] for r in data.collect()), key=lambda x: (x != x, x))
    return values[rank - below - 1]


def exact_median(df: DataFrame, keys, value: str, output: str = "median", accuracy: int = 10_000) -> DataFrame:
    """Exact median per group (mean of both middle values) for groups of any size; without keys of the table.

    A mergeable sketch first brackets the middle of each group. The second pass joins the brackets to the
    rows, by group and value slice, so that a group with much of the table is spread over many tasks; what
    lies above goes, what lies below is summed up in each task, and only the few values inside are
    shuffled to be counted.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    if not keys:
        rows = data.count()
        ends = [value_at(data, rank, rows, accuracy) for rank in sorted({(rows + 1) // 2, rows // 2 + 1})] if rows else []
        middle = (ends[0] + ends[-1]) / 2 if ends else None
        return df.sparkSession.createDataFrame([(middle,)], f"`{output}` double")
    margin = 4.0 / accuracy
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx("__v", [0.5 - margin, 0.5 + margin], accuracy).alias("__b"),
        F.count(F.lit(1)).alias("__n"),
    )
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(VALUE_SLICES - 1).cast("long")))
    sketch = sketch.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"),
        "__n", slices.alias("__r_slice"),
    )
    match = F.pmod(F.xxhash64("__v"), F.lit(VALUE_SLICES)) == F.col("__r_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    joined = data.join(sketch, match)
    # values below the bracket share one entry per group, so they vanish in the partial aggregation
    spot = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counted = (
        joined.filter(F.col("__v") <= F.col("__hi"))
        .groupBy(*keys, spot.alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__upto", F.sum("__c").over(order)).withColumn(
        "__from", F.col("__upto") - F.col("__c") + 1
    )
    lower = F.expr("(__n + 1) div 2")
    upper = F.expr("__n div 2 + 1")
    at = [
        F.max(F.when((F.col("__from") <= r) & (r <= F.col("__upto")), F.col("__v"))) for r in (lower, upper)
    ]
    middle = F.coalesce((at[0] + at[1]) / 2, F.raise_error(F.lit("median outside its bracket")).cast("double"))
    return ranked.groupBy(*keys).agg(middle.alias(output))
