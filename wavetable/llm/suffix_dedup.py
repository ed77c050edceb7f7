"""Repeated passages by sparse suffix arrays.

Of all suffixes of the documents only those at content-selected positions are kept: in every window of
neighbouring heads (runs of HEAD words) the one with the smallest hash. Equal passages of at least
``least`` words select the same positions, so each of them holds a kept suffix whose head lies inside.
Suffixes whose head occurs in several documents are sorted, neighbours are compared, and matches are
extended to the right and to the left.

Neighbours in suffix order share the longest right extension, not always the longest passage: a suffix may
match one document to the left and another to the right. So every passage of ``least`` words around a kept
head is then counted as well, which makes the result exact (up to hash collisions) without pairs: a group of
equal suffixes is represented by its first and last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import written
from wavetable.llm.minhash import mixed, words_of

#: Shortest passage in words.
LEAST = 50
#: Suffixes of one head that one task compares.
HOT = 20_000
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text or "")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words, from prefix sums modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * powers(FACTOR, len(hashes)), dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, n))


def selected(heads: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest head of each window, the leftmost of equal ones."""
    if len(heads) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(heads, window)
    return np.unique(np.concatenate([views[k : k + 4096].argmin(axis=1) + np.arange(k, min(k + 4096, len(views))) for k in range(0, len(views), 4096)]))


def suffixes(docs: DataFrame, id_col: str, text_col: str, head: int, window: int) -> DataFrame:
    """(doc, pos, head) of the kept suffixes."""
    schema = T.StructType(
        [T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("head", T.LongType())]
    )

    def find(batches):
        for batch in batches:
            for low in range(0, len(batch), 1024):
                rows, places, heads = [], [], []
                for i, text in enumerate(batch.column(1).slice(low, 1024).to_pylist(), low):
                    runs = run_hashes(word_hashes(text), head)
                    pos = selected(runs, window)
                    rows.append(np.full(len(pos), i))
                    places.append(pos)
                    heads.append(runs[pos])
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(heads).view(np.int64))],
                    names=schema.names,
                )

    return keyed(docs, id_col, text_col).select("doc", "text").mapInArrow(find, schema)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text): ``doc`` stands for the id and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("doc"), F.col(id_col).alias("id"), text.alias("text"))


def contexts(texts: DataFrame, head: int, reach: int) -> DataFrame:
    """(doc, pos, head, right, left, n): up to ``reach`` 32-bit word hashes on either side of repeated heads.

    ``texts`` has ``places``, (pos, n) of the repeated heads of a text, where n suffixes have that head.
    ``left`` runs away from the head.
    """
    fields = [("doc", T.LongType()), ("pos", T.IntegerType()), ("head", T.LongType()), ("right", T.BinaryType()), ("left", T.BinaryType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def cut(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                out: list[list] = [[] for _ in schema.fields]
                rows = []
                for i, (text, places) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    hashes = word_hashes(text)
                    heads, words = run_hashes(hashes, head).view(np.int64), (hashes >> np.uint64(32)).astype("<u4")
                    for pos, n in sorted((x["pos"], x["n"]) for x in places):
                        rows.append(i)
                        values = (pos, heads[pos], words[pos + head : pos + head + reach].tobytes(), words[max(0, pos - reach) : pos][::-1].tobytes(), n)
                        for column, value in zip(out[1:], values):
                            column.append(value)
                take = pa.array(rows, pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), *[pa.array(c, k) for c, k in zip(out[1:], kinds)]], names=schema.names)

    return texts.select("doc", "text", "places").mapInArrow(cut, schema)


def side(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes as a matrix with zeros behind each row's end, and the rows' lengths."""
    values = column.to_pylist()
    lengths = np.array([len(v) // 4 for v in values], np.int64)
    return np.frombuffer(b"".join(v.ljust(4 * reach, b"\0") for v in values), "<u4").reshape(len(values), reach), lengths


def prefixes(words: np.ndarray, factor: int) -> np.ndarray:
    """Hash of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        out[:, k + 1] = mixed(out[:, k] * np.uint64(factor) + words[:, k] + np.uint64(1))
    return out


def compare_neighbours(ordered: DataFrame, head: int, reach: int) -> DataFrame:
    """Passages that sorted neighbours of different documents share, and keys of the passages still to be counted.

    Rows (doc, pos, start, end, shared, open, least, keys): the match extended right and left, ``shared`` if it
    has head + reach words or more. ``open`` suffixes may share more with others than with their neighbours.
    ``keys`` stand for the passages of head + reach words with least, least + 1, ... words before the head;
    open suffixes have them, and the first and last of equal suffixes beside open ones.
    """
    names = [("doc", T.LongType()), ("pos", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("shared", T.BooleanType()), ("open", T.BooleanType()), ("least", T.IntegerType()), ("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in names])

    def judged(table: pa.Table, before: bool, after: bool) -> pa.RecordBatch:
        """Rows of ``table`` but the first, if ``before``, and the last, if ``after``: those are there as neighbours."""
        n = table.num_rows
        get = lambda name: table.column(name).combine_chunks()
        ids, heads, pos, members = get("doc").to_numpy(), get("head").to_numpy(), get("pos").to_numpy(), get("n").to_numpy()
        (right, right_n), (left, left_n) = side(get("right"), reach), side(get("left"), reach)
        same = heads[1:] == heads[:-1]

        def common(x, lengths):
            differ = x[1:] != x[:-1]
            found = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
            return np.where(same, np.minimum(found, np.minimum(lengths[1:], lengths[:-1])), 0)

        r, l = common(right, right_n), common(left, left_n)
        equal = same & (r == right_n[1:]) & (r == right_n[:-1]) & (l == left_n[1:]) & (l == left_n[:-1])
        other = same & (ids[1:] != ids[:-1])
        low, high, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for rows in (slice(1, n), slice(0, n - 1)):  # with the one before, with the one after
            size = np.where(other, head + r + l, 0)
            better = size > (high - low)[rows]
            low[rows] = np.where(better, pos[rows] - l, low[rows])
            high[rows] = np.where(better, pos[rows] + head + r, high[rows])
            whole[rows] |= other & (l == left_n[rows]) & (r == right_n[rows])
        # of two suffixes each has met the only other one
        unsure = ~whole & (members > 2)
        group = np.concatenate([[0], np.cumsum(~same)])
        beside = np.bincount(group, unsure) > 0
        beside[[0, -1]] = True  # the rest of these may be in other batches
        stands = (~np.append(False, equal) | ~np.append(equal, False)) & (members > 2) & (beside[group] | (members > HOT))
        wanted = np.flatnonzero(unsure | stands)
        fronts, behinds = prefixes(left[wanted], FACTOR), prefixes(right[wanted], INVERSE)
        a = np.arange(reach + 1)
        keys = mixed(mixed(fronts * np.uint64(3) + behinds[:, reach - a]) + heads[wanted].view(np.uint64)[:, None] + a.astype(np.uint64))
        least = np.maximum(0, reach - right_n)
        lists: list = [None] * n
        for k, i in enumerate(wanted):
            lists[i] = keys[k, least[i] : left_n[i] + 1].view(np.int64)
        columns = [
            get("doc"), get("pos"), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(high - low >= head + reach),
            pa.array(unsure), pa.array(least, pa.int32()), pa.array(lists, pa.list_(pa.int64())),
        ]
        first, last = int(before), n - int(after)
        return pa.RecordBatch.from_arrays(columns, names=schema.names).slice(first, last - first)

    def extend(batches):
        tail, done = None, False  # the last two rows, of which the first is done; at the start one row
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if tail is not None:
                table = pa.concat_tables([tail, table])
            if table.num_rows > 1:
                yield judged(table, done, True)
                done, tail = True, table.slice(table.num_rows - 2)
            else:
                tail = table
        if tail is not None:
            yield judged(tail, done, False)

    return ordered.mapInArrow(extend, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, start_word, end_word): maximal unions of passages of ``least`` or more words that other documents hold too.

    Words are separated by ASCII white space and compared without the case of A-Z; ends are exclusive. Every
    occurrence is returned, the first one too. Null, empty and shorter texts have none. Repeated rows (equal
    id and text) are one document and return their spans once; rows of one id with different texts are
    different documents. Other columns are not carried on.
    """
    head = least // 2
    reach = least - head
    kept = written(suffixes(docs, id_col, text_col, head, reach + 1))
    often = kept.groupBy("head").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("head", "n")
    places = kept.join(often, "head").groupBy("doc").agg(F.collect_set(F.struct("pos", "n")).alias("places"))
    texts = keyed(docs, id_col, text_col).select("doc", "text").join(places, "doc")
    # a head of many suffixes is dealt to several tasks; what neighbours then miss is counted below
    part = F.pmod(F.xxhash64("doc"), F.floor(F.col("n") / HOT) + 1)
    ordered = contexts(texts, head, reach).withColumn("part", part).repartition("head", "part").sortWithinPartitions("head", "right", "left", "doc", "pos")
    matched = written(compare_neighbours(ordered.drop("part"), head, reach))
    near = matched.filter("shared").select("doc", "start", "end")
    keys = matched.filter("keys is not null").select("doc", F.explode("keys").alias("key"))
    known = keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("key")
    start = F.col("pos") - F.col("least") - F.col("k")
    every = matched.filter("open").select("doc", "pos", "least", "shared", F.col("start").alias("from"), F.col("end").alias("to"), F.posexplode("keys").alias("k", "key"))
    every = every.select("doc", "key", start.alias("start"), "shared", "from", "to")
    every = every.filter(~F.col("shared") | (F.col("start") < F.col("from")) | (F.col("start") + least > F.col("to"))).select("doc", "key", "start")
    exact = every.join(known, "key", "left_semi").select("doc", "start", (F.col("start") + least).alias("end"))
    ids = keyed(docs, id_col, text_col).select("doc", "id").distinct()
    return merged(near.union(exact)).join(ids, "doc").select(F.col("id").alias(id_col), "start_word", "end_word")


def merged(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching spans (doc, start, end) of a document."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    number = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    groups = spans.withColumn("begins", begins).withColumn("number", number)
    return groups.groupBy("doc", "number").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("number")


def cut_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, passage): the words of each span, joined by single spaces; ids must be unique."""
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    passage = F.array_join(F.slice(words, F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " ")
    return docs.select(id_col, text_col).join(spans, id_col).select(id_col, "start_word", "end_word", passage.alias("passage"))
