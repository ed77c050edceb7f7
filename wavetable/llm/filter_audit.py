"""How document filters interact: what each one removes, alone, first, or after the others.

Word statistics come from a sparse document-term matrix. Every task cuts its documents into blocks and
encodes each block's words with a vocabulary of its own; only these vocabularies are shuffled, in slices by hash,
to number all words of the corpus, and each block then gets the numbers of its words. A block so becomes a shard in CSR form
(``starts``, ``terms``, ``counts``) with corpus-wide columns, of which row sums are word counts and nonzero
counts are distinct words. Documents carry their failures as five bits. A filter order only depends on how many
documents have which bits, so all 120 orders follow from 32 counts a part.
"""

from __future__ import annotations

from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import shared_file, text_key, written

LETTERS = "ABCDE"
#: A block ends at this many bytes of text or documents; one longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 1 << 22, 1 << 14
#: Blocks in one file, which bounds what a reader holds at once.
FILE_BLOCKS = 8
#: Bytes of block vocabularies that one task numbers.
SLICE_BYTES = 1 << 23
MARKS = b"#$%&*|"
KINDS = np.zeros(256, np.uint8)
KINDS[ord("A") : ord("Z") + 1] = 1
KINDS[list(MARKS)] = 2


def cuts(sizes: np.ndarray, most: int, rows: int) -> list[int]:
    """Bounds of runs of rows that hold ``most`` bytes or ``rows`` rows, each at least one row."""
    ends, total, low = [0], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and (total + size > most or i - low >= rows):
            ends.append(i)
            total, low = 0, i
        total += size
    return [*ends, len(sizes)] if len(sizes) else [0]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.empty(0, np.int64)


def csr(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(starts, terms, counts, words, slots) of texts; ``terms`` number ``words``, which ascend by their hash ``slots``."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.not_equal(flat, "")
    row, flat = row[filled.to_numpy(zero_copy_only=False)], flat.filter(filled).dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    slots = np.fromiter(map(crc32, words), np.uint32, len(words))
    order = np.argsort(slots, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    width = max(1, len(words))
    cells, counts = np.unique(row * width + rank[flat.indices.to_numpy()], return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    return starts.astype(np.int32), cells % width, counts, [words[i] for i in order], slots[order]


def others(texts: pa.Array) -> np.ndarray:
    """Bits of the failures that need no words: 4 for too many capitals, 8 for a mark."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kinds, offsets = KINDS[data], offsets - offsets[0]
    points = per_row((data & 0xC0) != 0x80, offsets)
    return (4 * (100 * per_row(kinds == 1, offsets) > 10 * points) + 8 * (per_row(kinds == 2, offsets) > 0)).astype(np.int32)


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def text_blocks(docs: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """Blocks of documents, written: (block, docs, starts, other, terms, counts, words, slots).

    ``docs`` is a list of structs with the columns ``keep``; ``terms`` number the block's own ``words``. A null
    text is empty. Repeated rows are rows of their own.
    """
    rows = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("docs", T.ArrayType(rows.schema["doc"].dataType)),
            *[T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("starts", "other")],
            *[T.StructField(name, T.BinaryType()) for name in ("terms", "counts", "words", "slots")],
        ]
    )

    def cut(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends = cuts(sizes, BLOCK_BYTES, BLOCK_DOCS)
            for a, b in zip(ends, ends[1:]):
                texts = batch.column(1).slice(a, b - a)
                starts, terms, counts, words, slots = csr(texts)
                lists = [one_list(x) for x in (batch.column(0).slice(a, b - a), pa.array(starts), pa.array(others(texts)))]
                binary = [pa.array([x], pa.binary()) for x in (packed(terms), packed(counts), b" ".join(words), slots.tobytes())]
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, *binary], names=schema.names)

    path = shared_file(docs.sparkSession)
    rows.mapInArrow(cut, schema).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def vocabularies(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(slice, owner, words): every block's words, split by their hash into slices, and the number of slices."""
    slices = max(16, int(blocks.agg(F.sum(F.length("words"))).first()[0] or 0) // SLICE_BYTES)

    def split(batches):
        for batch in batches:
            out = [[], [], []]
            for block, words, slots in zip(*(c.to_pylist() for c in batch.columns)):
                words = words.split()
                bounds = np.searchsorted(np.frombuffer(slots, np.uint32).astype(np.uint64) * np.uint64(slices) >> np.uint64(32), np.arange(slices + 1))
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    for column, value in zip(out, (k, block, b" ".join(words[bounds[k] : bounds[k + 1]]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["slice", "owner", "words"]
            )

    return blocks.select("block", "words", "slots").mapInArrow(split, "slice int, owner long, words binary"), slices


def number_slice(rows: pa.Table, slices: int) -> tuple[pa.Array, np.ndarray, list[list[bytes]], np.ndarray]:
    """Distinct words of a slice in order with their numbers, and each block's words with the place of each."""
    lists = [w.split() for w in rows.column("words").to_pylist()]
    coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), np.arange(len(order)) * slices + rows.column("slice")[0].as_py(), lists, place[coded.indices.to_numpy()]


def dictionary(blocks: DataFrame) -> DataFrame:
    """(word, term): all words of the corpus, each with a number of its own; slices take turns in the numbers."""
    words, slices = vocabularies(blocks)

    def name(rows):
        distinct, terms, _, _ = number_slice(rows, slices)
        return pa.Table.from_arrays([distinct.cast(pa.string()), pa.array(terms)], names=["word", "term"])

    return words.groupBy("slice").applyInArrow(name, "word string, term long")


def shards(blocks: DataFrame, finish, schema: T.StructType) -> DataFrame:
    """``finish(docs, starts, terms, counts, other)`` of every block, with the terms of the whole corpus.

    A block and the numbers of its words meet in one task, so a shard is as large as a block however large the
    dictionary is. A word is at most once in a block, so no word is a hot key.
    """
    words, slices = vocabularies(blocks)

    def number(rows):
        _, terms, lists, place = number_slice(rows, slices)
        numbers, ends = terms[place], np.cumsum([0, *map(len, lists)])
        data = [packed(numbers[a:b]) for a, b in zip(ends, ends[1:])]
        columns = [rows.column("owner"), rows.column("slice"), pa.array(list(map(len, lists)), pa.int32()), pa.array(data, pa.binary())]
        return pa.Table.from_arrays(columns, names=["owner", "slice", "n", "numbers"])

    numbers = words.groupBy("slice").applyInArrow(number, "owner long, slice int, n int, numbers binary")

    def renumber(block, numbers):
        parts = sorted(zip(*(numbers.column(c).to_pylist() for c in ("slice", "n", "numbers"))))
        where = np.concatenate([np.empty(0, np.int64), *[unpacked(data, n) for _, n, data in parts]])
        starts, other = (block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("starts", "other"))
        terms, counts = (unpacked(block.column(c)[0].as_py(), int(starts[-1])) for c in ("terms", "counts"))
        return finish(block.column("docs").combine_chunks().flatten(), starts, where[terms], counts, other)

    return blocks.drop("words", "slots").groupBy("block").cogroup(numbers.groupBy("owner")).applyInArrow(renumber, schema)


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix (ids, starts, terms, counts) in CSR shards, and its dictionary (word, term).

    Row ``i`` of a shard is document ``ids[i]`` with ``terms`` and ``counts`` from ``starts[i]`` to ``starts[i + 1]``.
    A null or empty text is an empty row; an empty table has no shards.
    """
    blocks = text_blocks(docs, [F.col(id_col).alias("id")], text_col)
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def whole(docs, starts, terms, counts, other):
        return pa.Table.from_arrays([one_list(x) for x in (docs.field(0), *map(pa.array, (starts, terms, counts)))], names=schema.names)

    return shards(blocks, whole, schema), dictionary(blocks)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, failed) of every document: bits 1 to 16 for filters A to E.

    A: under 100 words. B: fewer than 80 distinct words in 100. C: more than 10 capitals A-Z in 100 characters.
    D: holds one of ``#$%&*|``. E: some smaller id has the same text. Null texts are empty, a null part is "". A null
    id is larger and smaller than no other, so it never fails E; repeated rows don't fail E by each other.
    """
    keep = [F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")]
    key = text_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key")
    blocks = text_blocks(docs, [*keep, key], text_col)
    inner = blocks.schema["docs"].dataType.elementType
    schema = T.StructType([*inner.fields, T.StructField("failed", T.IntegerType())])

    def decide(docs, starts, terms, counts, other):
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        words, distinct = total[starts[1:]] - total[starts[:-1]], np.diff(starts).astype(np.int64)
        failed = (1 * (words < 100) + 2 * (100 * distinct < 80 * words) + other).astype(np.int32)
        return pa.Table.from_arrays([*docs.flatten(), pa.array(failed)], names=schema.names)

    rows = written(shards(blocks, decide, schema))
    # joined by (id, key), of which every first has one row, and not by the key, which many copies share
    firsts = rows.filter("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["id", "key"], "left").select("id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))


def plans() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) of all steps, and for each the sets of failures it counts as kept, removed, redundant and alone."""
    steps, sets = [], []
    masks = np.arange(2 ** len(LETTERS))
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, gone = (masks & bit) > 0, (masks & before) > 0
            steps.append(("".join(order), step))
            sets.append([~fails & ~gone, fails & ~gone, fails & gone, masks == bit])
            before |= bit
    return steps, np.array(sets, np.int64)


RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def interactions(failed: DataFrame, good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, filter order and step, of (part, failed, good, toxic).

    ``kept`` after the step, ``removed`` by it, ``redundant``: fail its filter but went before, ``unique_fails``: fail
    only its filter; ``good_lost`` and ``toxic_lost``: removed with the flag; ``shapley``: removed by the step's
    filter over all orders. No rows, no parts.
    """
    cells = failed.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(good).cast("long")).alias("good"), F.sum(F.col(toxic).cast("long")).alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # at most 32

    def work(batches):
        steps, sets = plans()
        filters = np.array([LETTERS.index(order[step - 1]) for order, step in steps])
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, 2 ** len(LETTERS)), np.int64)
                for c in cells:
                    n[c["failed"]], good[c["failed"]], toxic[c["failed"]] = c["n"], c["good"], c["toxic"]
                kept, removed, redundant, alone = (sets @ n).T
                shapley = np.bincount(filters, removed, len(LETTERS)).astype(np.int64)[filters]
                columns = [kept, removed, redundant, alone, sets[:, 1] @ good, sets[:, 1] @ toxic, shapley]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(steps)),
                        pa.array([order for order, _ in steps]),
                        pa.array([step for _, step in steps], pa.int32()),
                        *map(pa.array, columns),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return parts.mapInArrow(work, RESULT)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Interactions of the five filters on ``docs``, with what they lose of ``labels`` (id, quality, toxic).

    A document is good (toxic) if some label row of its id says 1; unlabelled ones are neither. An empty table of
    documents gives no rows, an empty table of labels zeros.
    """
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return interactions(rows.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
