"""Near duplicates by MinHash: many universal hash minima, banding, verification, connected components.

Documents with equal shingle sets are one class from the start, so copies cost one row each. Classes that
share a band are candidates. The signature sketch drops pairs that can't reach the threshold, and full sets
decide. Within a bucket not all pairs are formed: every member meets the bucket's smallest class first, and
after the components are known only pairs of classes that are still in different components are left. Those
that can be links by their deviations from the bucket's common shingles are then decided too. So no link that
changes a component is lost, and a large bucket of true copies costs one pair a member.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import text_key, written

#: A pair at the threshold of 0.8 shares none of the bands with a probability of (1 - 0.8 ** ROWS) ** BANDS = 3e-8.
BANDS, ROWS = 57, 6
#: One byte of so many minima is the sketch; a pair at the threshold agrees in fewer than LEAST with 1e-9.
SKETCH, LEAST = 128, 70
#: Rounds in which members meet one class of their bucket, before all remaining pairs are decided.
ROUNDS = 2
#: Buckets of so many members give all pairs of different components; larger ones only pairs that can be links (see ``remaining``).
FEW = 32
#: Members that share no more than a group's core meet in so many blocks a side.
BLOCKS = 8
PERCENT = 80


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        hashes, width = np.append(hashes, np.uint64(len(words))), len(words) + 1
    n = len(hashes) - width + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[k : k + n])
    return np.unique(mixed(rolled))


@lru_cache(maxsize=4)
def multipliers(count: int) -> np.ndarray:
    """Odd factors of the multiply-shift family, which is universal; minima need its high bits only."""
    return np.random.default_rng(20240229).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minima of ``count`` hash functions for each non-empty set, sets x count; a few thousand shingles at a time."""
    out = np.empty((len(sets), count), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 60_000):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k, a in enumerate(multipliers(count)):
            out[first:last, k] = np.minimum.reduceat(flat * a, starts)
        first = last
    return out


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, key, sketch, bands) in one pass over the texts.

    ``key`` is 128 bits that stand for the set, ``sketch`` one byte of SKETCH minima, ``bands`` a key for each
    band; all three are null without words.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("sketch", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches):
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                found = minima([sets[i] for i in full], BANDS * ROWS)
                small = (found[:, :SKETCH] >> np.uint64(40)).astype(np.uint8)
                bands = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + found[:, r::ROWS])
                keys: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                for k, i in enumerate(full):
                    keys[i], sketches[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), small[k].tobytes()
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), long_array(bands.ravel()))
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                rows = rows.take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), rows],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, schema)


@F.pandas_udf(T.IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal bytes of two sketches."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Pairs of one ``a`` are tested as they stream past, so a frequent ``a`` may be split over tasks. Texts
    travel with the pairs; only pairs that the sketch let through are here.
    """

    def test(batches):
        known: dict = {}
        for batch in batches:
            rows = batch.to_pydict()
            keep = []
            for a, x, y in zip(rows["a"], rows["x"], rows["y"]):
                if a not in known:
                    known.clear()
                    known[a] = shingles(x, width)
                left, right = known[a], shingles(y, width)
                if len(left) * 100 < percent * len(right) or len(right) * 100 < percent * len(left):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    kind = texts.schema["id"].dataType
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return rows.mapInArrow(test, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id that each end of ``edges`` (a, b) reaches, by large-star and small-star.

    Minima are aggregates with partial aggregation and joined back, so a hub with very many neighbours is
    split by skew joins. Every round is written to the shared folder.
    """

    def star(directed: DataFrame, low: DataFrame) -> DataFrame:
        return directed.join(low, "a").select("a", "b", "low")

    state, before = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            ends = F.explode(F.array("a", "b")).alias("id")
            return state.select(ends, F.col("b").alias("component")).distinct()
        before = mark
        # large star: every larger neighbour to the smallest id around
        both = state.union(state.select("b", "a"))
        around = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = star(both, around).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: every smaller neighbour, and the id itself, to the smallest one
        below = large.groupBy("a").agg(F.min("b").alias("low"))
        small = star(large, below).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        state = written(small.union(below.select("a", F.col("low").alias("b"))).distinct())


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of each text (id, text)."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                rows = [shingles(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "shingles"])

    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return texts.select("id", "text").mapInArrow(run, schema)


def remaining(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, among ``members`` (band, id, component) of one band, that can be links.

    Small bands give all their pairs. Large bands with the same most frequent component form a group, whose
    core is the set of shingles that more than half of its members hold. A member's deviation is what it holds
    beside the core and what it lacks of it. The symmetric difference of two members is that of their
    deviations, so with excess = (100 + percent) * deviation - (100 - percent) * shingles they are linked if
    and only if 2 * (100 + percent) * shared deviations >= the sum of both excesses. Pairs whose excesses need no
    shared deviation are links and met in blocks. All others must share some, so a prefix filter finds them: of
    each deviation, rarest first, only so many as leave fewer than must be shared. No link is lost.
    """
    per = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    bands = written(per.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")))
    few = members.join(bands.filter(F.col("n") <= FEW).select("band"), "band")
    x, y = (few.select("band", F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    direct = x.join(y, "band").filter("a < b and ca <> cb").select("a", "b")

    groups = bands.filter(F.col("n") > FEW).select("band", F.col("most.component").alias("group"))
    grouped = written(members.join(groups, "band").select("group", "id", "component").distinct())
    sets = shingle_sets(texts.join(grouped.select("id").distinct(), "id", "left_semi"), width)
    # each set of an id that has several texts is a member of its own
    full = written(grouped.join(sets.withColumn("set", F.xxhash64("shingles")).dropDuplicates(["id", "set"]), "id"))
    of = full.groupBy("group").agg(F.count(F.lit(1)).alias("of"))
    held = full.select("group", F.explode("shingles").alias("shingle")).groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("n"))
    # at most twice the mean number of shingles of a member
    core = held.join(of, "group").filter(F.col("n") * 2 > F.col("of")).groupBy("group").agg(F.collect_list("shingle").alias("core"))
    with_core = full.join(written(core), "group", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    deviation = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    excess = (100 + percent) * F.size("deviation").cast("long") - (100 - percent) * F.size("shingles").cast("long")
    apart = with_core.withColumn("deviation", deviation).withColumn("excess", excess).withColumn("n", F.size("shingles"))
    apart = written(apart.select("group", "id", "set", "component", "n", "excess", "deviation", (F.col("component") == F.col("group")).alias("main")))

    least = written(
        apart.groupBy("group").agg(
            F.min("excess").alias("least"),
            F.min(F.when(F.col("main"), F.col("excess"))).alias("least_main"),
            F.min(F.when(~F.col("main"), F.col("excess"))).alias("least_other"),
        )
    )
    # one end of each pair is outside the group's most frequent component
    able = written(apart.join(least, "group").filter(F.col("excess") + F.col("least") <= 0).select("group", "id", "component", "excess", "main"))
    side = lambda c: [F.col("id").alias(c), F.col("component").alias(f"c{c}"), F.col("excess").alias(f"e{c}")]
    block, every = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    x = able.filter(~F.col("main")).select("group", *side("a"), block.alias("i")).withColumn("j", every)
    y = able.select("group", *side("b"), block.alias("j")).withColumn("i", every)
    bounded = x.join(y, ["group", "i", "j"]).filter("ca <> cb and ea + eb <= 0")
    bounded = bounded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    rows = written(apart.select("group", "id", "set", "component", "main", "n", "excess", F.explode("deviation").alias("shingle")))
    shared = rows.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("x"), F.max("component").alias("y"))
    rows = rows.join(shared.filter("x <> y").select("group", "shingle", "held"), ["group", "shingle"]).join(least, "group")
    # what a member must share with any partner: by the partner's excess, and as a partner's deviation holds at least what is shared
    by_size = (F.col("excess") - (100 - percent) * 100 * F.col("n") / percent) / (100 + percent)
    must = lambda other: F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(other)) / (2 * (100 + percent))), F.ceil(by_size))
    member = Window.partitionBy("group", "id", "set")
    rows = rows.withColumn("place", F.row_number().over(member.orderBy("held", "shingle"))).withColumn("count", F.count(F.lit(1)).over(member))
    within = lambda other: F.col("place") <= F.col("count") - must(other) + 1
    rows = rows.select("group", "shingle", "id", "component", "main", "excess", "count", within("least_main").alias("wide"), within("least_other").alias("narrow"))
    rows = written(rows.filter("narrow or (wide and not main)"))

    def meeting(a: DataFrame, b: DataFrame, condition: str) -> DataFrame:
        x, y = (t.select("group", "shingle", *side(c), F.col("count").alias(f"n{c}")) for t, c in ((a, "a"), (b, "b")))
        pairs = x.join(y, ["group", "shingle"]).filter(condition)
        pairs = pairs.filter(2 * (100 + percent) * F.least("na", "nb") >= F.col("ea") + F.col("eb"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    mains, others = rows.filter("main and narrow"), rows.filter("not main")
    crossing = meeting(mains, others.filter("wide"), "ca <> cb")
    outside = meeting(others.filter("narrow"), others.filter("narrow"), "a < b and ca <> cb")
    return direct.union(bounded).union(crossing).union(outside)


def links(signed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``signed`` documents that connect the same components as all links; each is a link or a chain of links.

    ``signed`` has one row for each set (see ``signatures``); ``texts`` (id, text) holds at least its documents.
    """
    sketches = signed.select("id", "sketch")
    buckets = signed.select("id", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).filter("n > 1")
    members = written(buckets.join(shared.select("band", "low"), "band"))
    near = written(texts.join(members.select("id").distinct(), "id", "left_semi"))

    def decided(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        close = pairs.distinct().join(a, "a").join(b, "b").filter(agreeing("sa", "sb") >= LEAST)
        return written(confirm(close.select("a", "b"), near, width, percent))

    found = decided(members.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    for number in range(1, ROUNDS + 1):
        known = components(found)
        placed = members.select("id", "band").join(known, "id", "left")
        placed = written(placed.withColumn("component", F.coalesce("component", "id")))
        pick = F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("order"), F.col("id").alias("centre"), F.col("component").alias("of"))).alias("pick")
        mixed_bands = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), pick).filter("x <> y")
        left = placed.join(mixed_bands.select("band", "pick.centre", "pick.of"), "band")
        if number < ROUNDS:  # a random member as centre, for the members outside its component
            pairs = left.filter("component <> of").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        else:  # every remaining pair of different components that can be a link
            pairs = remaining(left.select("band", "id", "component"), near, width, percent)
        found = known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(decided(pairs))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; ``component_id`` is
    the smallest id that a document reaches, and the document with that id is kept. A document without
    words (null, empty or blank text) is linked with nothing. Rows with the same id are one document; if their
    texts differ, it has the links of all of them. Rows with a null id are documents of their own that link
    others too; one that reaches no id has a null ``component_id`` and is kept, any other is not. Other columns
    are not carried on.
    """
    if not docs.filter(F.col(id_col).isNull()).isEmpty():
        return _by_text(docs, id_col, text_col, width, percent)
    signed = written(signatures(docs, id_col, text_col, width))
    classes = signed.filter("key is not null").groupBy("key").agg(F.min("id").alias("class"))
    placed = written(signed.select("id", "key").join(classes, "key").select("id", "class").distinct())
    several = placed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low")).filter("n > 1")
    bridges = placed.join(several, "id").filter("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    first = written(signed.join(classes, "key").filter("id = class").dropDuplicates(["key"]).select("id", "sketch", "bands"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = components(links(first, texts, width, percent).union(bridges))
    of_class = found.select(F.col("id").alias("class"), "component")
    reached = placed.join(of_class, "class", "left").groupBy("id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    out = signed.select("id", "n_shingles").join(reached, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _by_text(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` of a table with null ids: texts stand for their rows, and ids with several texts link these."""
    text = F.col(text_col).cast("string")
    rows = written(docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), text.alias("text")))
    found = written(near_duplicates(rows.groupBy("key").agg(F.first("text").alias("text")), "key", "text", width, percent))
    placed = written(rows.join(found.select("key", "n_shingles", F.col("component_id").alias("component")), "key").select("id", "n_shingles", "component"))
    lows = placed.filter("n_shingles > 0 and id is not null").groupBy("id").agg(F.min("component").alias("low"))
    bridges = placed.filter("n_shingles > 0").join(lows, "id").filter("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b"))
    joined = components(bridges.distinct()).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    placed = written(placed.join(joined, "component", "left").withColumn("whole", F.when(F.col("n_shingles") > 0, F.coalesce("whole", "component"))))
    least = placed.filter("whole is not null").groupBy("whole").agg(F.min("id").alias("low"))
    # a row without words belongs to its id, which other rows of the id may have linked
    of_id = placed.filter("id is not null").join(least, "whole", "left").groupBy("id").agg(F.min("low").alias("mine"))
    out = placed.join(least, "whole", "left").join(of_id, "id", "left")
    component = F.coalesce("mine", "low", "id")
    kept = F.when(F.col("id").isNull(), component.isNull()).otherwise(F.col("id") == component)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` without near duplicates; all columns stay.

    Rows are compared by their texts alone, so ids may be null or used again. Of each component (see
    ``near_duplicates``) the row with the smallest id stays, null ids last; of exact repeats one. Every row
    without words stays.
    """
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), text_key(text), F.xxhash64(*hashed))
    rows = docs.filter(worded).select(text_key(text).alias("key"), F.struct(*docs.columns).alias("row"), order.alias("order"))
    texts = written(rows.groupBy("key").agg(F.min_by("row", "order").alias("row"), F.min("order").alias("order")))
    found = near_duplicates(texts.select("key", F.col("row").getField(text_col).alias("text")), "key", "text", width, percent)
    first = found.join(texts.select("key", "order"), "key").groupBy("component_id").agg(F.min_by("key", "order").alias("key"))
    kept = texts.join(first, "key", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionAll(docs.filter(~worded))
