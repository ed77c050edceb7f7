"""Best-fit packing of token pieces into sequences, by linear grouping.

Large pieces are sorted by length and cut into groups of equal cardinality; every length is rounded up to
the longest of its group. That leaves few sizes, for which column generation finds the best mix of
configurations (which sizes share a sequence). Actual pieces then take the places of their group, which
leaves some room in each sequence, and the small pieces go by best fit into what is left.

Only histograms of lengths reach the driver: at most ``capacity`` counts, however many pieces there are.
Both plans say "pieces r0 to r1 of this length class go to sequences b0 to b1", and Spark applies them to
numbered pieces.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import number_within, slices_for, written

CAPACITY = 1024
#: Length groups of the large pieces.
GROUPS = 200
#: Pieces of at most this share of the capacity are small.
SMALL_SHARE = 1 / 8
#: Words whose ids a Python worker keeps.
CACHE = 400_000
#: Ends every document.
END = 2


class Ids(dict):
    """Ids of `" " + word` as little-endian uint32 bytes, computed once a word."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = np.array(self.encode(" " + word), "<u4").tobytes()
        return ids


@lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """text -> ids as little-endian uint32 bytes, equal to `tokenizers` on the file ``tokenizer``.

    The byte-level pattern always splits before a single space between two visible characters, so such a
    text is encoded word by word and repeated words are looked up. The rank file of the same vocabulary
    beside ``tokenizer`` (same name, .tiktoken) encodes new words faster; without it, or when a text
    contains a special token's string, `tokenizers` does the work.
    """
    import os
    import re

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)")
    plain, ranks = (lambda text: whole.encode(text, add_special_tokens=False).ids), tokenizer[: -len(".json")] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    else:
        quick = plain
    words = Ids(quick)
    odd = re.compile(r"\s | \s|\A | \Z")

    def encode(text: str) -> bytes:
        if special.search(text):
            return np.array(plain(text), "<u4").tobytes()
        if odd.search(text):
            return np.array(quick(text), "<u4").tobytes()
        first, _, rest = text.partition(" ")
        head = np.array(quick(first), "<u4").tobytes()
        return head + b"".join(map(words.__getitem__, rest.split(" "))) if rest else head

    return encode


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: (id, piece, start, length, ids).

    ``ids`` are little-endian uint32 token ids; a document's ids end with ``END``. Documents longer than
    ``capacity`` are cut into pieces of ``capacity`` ids, the first one takes the rest. A null text is an
    empty text, which has one piece with ``END`` alone. Repeated rows give repeated pieces; other columns
    are not carried on.
    """
    end = np.array([END], "<u4").tobytes()
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(batch), 512):
                row, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(texts.slice(low, 512).to_pylist(), low):
                    data = encode(text or "") + end
                    n = len(data) // 4
                    bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (a, b) in enumerate(pairwise(bounds)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(data[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def length_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths from long to short in groups of about equal cardinality; equal lengths stay together."""
    total, seen, out = sum(counts.values()), 0, {}
    for length in sorted(counts, reverse=True):
        out.setdefault(seen * groups // total, []).append(length)
        seen += counts[length]
    return list(out.values())


def fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth: a knapsack in which every size may repeat."""
    best, taken = np.zeros(capacity + 1), []
    for size, value in zip(sizes, worth):
        new, times = best.copy(), np.zeros(capacity + 1, np.int32)
        if value > 1e-12:
            for t in range(1, capacity // size + 1):
                cand = best[: capacity + 1 - t * size] + t * value
                better = cand > new[t * size :] + 1e-12
                new[t * size :][better] = cand[better]
                times[t * size :][better] = t
        best = new
        taken.append(times)
    room, mix = capacity, np.zeros(len(sizes), np.int64)
    for g in range(len(sizes) - 1, -1, -1):
        mix[g] = taken[g][room]
        room -= mix[g] * sizes[g]
    return float(best[capacity]), mix


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, list[int]]]:
    """(number of sequences, pieces of each size in one) that hold ``demand`` pieces of each size.

    Column generation on the linear relaxation; its solution is rounded down, and the at most
    len(sizes) sequences' worth of pieces that this leaves go by best fit, longest first.
    """
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        gain, mix = fullest(s, inverse.sum(axis=0), capacity)
        if gain <= 1 + 1e-7:
            break
        amount, move = inverse @ d, inverse @ mix
        ratio = np.where(move > 1e-9, np.maximum(amount, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = mix
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    amount = np.linalg.solve(basis, d)
    whole = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    columns, left = np.rint(basis).astype(np.int64), np.array(demand, np.int64)
    out = []
    for column, n in zip(columns.T, whole):
        used = column > 0
        n = int(min(n, (left[used] // column[used]).min()))
        if n:
            out.append((n, column.tolist()))
            left -= n * column
    open_bins: list[list] = []
    for g in np.argsort(-s, kind="stable"):
        for _ in range(int(left[g])):
            fits = [b for b in open_bins if b[0] >= s[g]]
            target = min(fits, key=lambda b: b[0]) if fits else [capacity, [0] * len(sizes)]
            if not fits:
                open_bins.append(target)
            target[0] -= int(s[g])
            target[1][g] += 1
    return out + [(1, b[1]) for b in open_bins]


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple], int]:
    """Rows (length, skip, r0, r1, bin, each) and the number of sequences.

    A piece's rank in its group is ``skip`` plus its number among pieces of its length; ranks r0 to r1 go,
    ``each`` to a sequence, to the sequences from ``bin`` on.
    """
    grouped = length_groups({n: c for n, c in counts.items() if n < capacity}, groups) if any(n < capacity for n in counts) else []
    if capacity in counts:
        grouped = [[capacity], *grouped]
    if not grouped:
        return [], 0
    demand = [sum(counts[n] for n in g) for g in grouped]
    mixes, taken, bins, spans = configurations([g[0] for g in grouped], demand, capacity), [0] * len(grouped), 0, []
    for n, mix in mixes:
        for g, each in enumerate(mix):
            if each:
                spans.append((g, taken[g], taken[g] + n * each, bins, each))
                taken[g] += n * each
        bins += n
    rows = []
    for g, lengths in enumerate(grouped):
        skip = 0
        for length in lengths:
            rows += [(length, skip, r0, r1, b, each) for k, r0, r1, b, each in spans if k == g and r0 < skip + counts[length] and r1 > skip]
            skip += counts[length]
    return rows, bins


def plan_small(counts: dict[int, int], free: dict[int, int], capacity: int, first_new: int) -> tuple[list[tuple], int]:
    """Best fit, longest first: rows (length, r0, r1, room, bin, each) and the number of sequences.

    ``free`` counts sequences by the room left. Sequences with the same room and history are one run, and a
    run changes as a whole, so there are at most as many runs as rooms and lengths. ``bin`` counts among the
    sequences that had ``room`` at first; room -1 means new sequences, which it numbers from ``first_new``.
    """
    runs = [(f, f, 0, n) for f, n in sorted(free.items())]  # room now, room at first, first bin, bins
    rows, new = [], first_new
    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        runs.sort()
        after = []
        for room, first, low, n in runs:
            each = room // length
            if not left or not each:
                after.append((room, first, low, n))
                continue
            full = min(n, left // each)
            if full:
                rows.append((length, at, at + full * each, first, low, each))
                after.append((room - each * length, first, low, full))
                at, left = at + full * each, left - full * each
            if full < n:
                if left:  # fewer than one sequence can take
                    rows.append((length, at, at + left, first, low + full, left))
                    after.append((room - left * length, first, low + full, 1))
                    at, left, full = at + left, 0, full + 1
                if full < n:
                    after.append((room, first, low + full, n - full))
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                rows.append((length, at, at + full * each, -1, new, each))
                after.append((capacity - each * length, -1, new, full))
                at, new = at + full * each, new + full
            if rest:
                rows.append((length, at, at + rest, -1, new, rest))
                after.append((capacity - rest * length, -1, new, 1))
                new += 1
        runs = after
    return rows, new


def histogram(df: DataFrame, column: str) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(column).count().collect()}


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``keys`` order the pieces; rows with equal keys are separate pieces. All columns are kept, so leave
    out token ids and join them afterwards. Offsets are gapless from 0 in each sequence. An empty table
    gives an empty table. Reserved names: rank, room, bin, each, skip, r0, r1, slice, before.
    """
    spark = pieces.sparkSession
    pieces = written(pieces)
    counts = histogram(pieces, "length")
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    ranked = written(number_within(pieces, ["length"], [F.col(k) for k in keys], "rank", slices_for(sum(counts.values()))))
    small = int(capacity * small_share)
    rows, bins = plan_large({n: c for n, c in counts.items() if n > small}, capacity, groups)
    # bounded: spans of each group meet each of its lengths once, at most capacity + spans rows
    plan = F.broadcast(spark.createDataFrame(rows, "length long, skip long, r0 long, r1 long, bin long, each long"))
    at = F.col("skip") + F.col("rank")
    large = ranked.filter(F.col("length") > small).join(plan, "length").filter((at >= F.col("r0")) & (at < F.col("r1")))
    large = large.withColumn("sequence_id", F.col("bin") + F.floor((at - F.col("r0")) / F.col("each")).cast("long"))
    large = large.select(*pieces.columns, "sequence_id")
    tiny = {n: c for n, c in counts.items() if n <= small}
    if tiny:
        room = (F.lit(capacity) - F.sum("length")).alias("room")
        open_bins = written(large.groupBy("sequence_id").agg(room).filter(F.col("room") >= min(tiny)))
        free = histogram(open_bins, "room")
        numbered = number_within(open_bins, ["room"], [F.col("sequence_id")], "bin", slices_for(sum(free.values())))
        rows, _ = plan_small(tiny, free, capacity, bins)
        # bounded: one row for each length and run of sequences, see plan_small
        plan = F.broadcast(spark.createDataFrame(rows, "length long, r0 long, r1 long, room long, bin long, each long"))
        placed = ranked.filter(F.col("length") <= small).join(plan, "length")
        placed = placed.filter((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
        placed = placed.withColumn("bin", F.col("bin") + F.floor((F.col("rank") - F.col("r0")) / F.col("each")).cast("long"))
        into = placed.filter("room >= 0").join(numbered, ["room", "bin"])
        opened = placed.filter("room < 0").withColumn("sequence_id", F.col("bin"))
        large = large.unionByName(into.select(*pieces.columns, "sequence_id")).unionByName(opened.select(*pieces.columns, "sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    return large.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def sequences(pieces: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """(sequence_id, length, ids): the token ids of every sequence; ``keys`` must be unique in both tables.

    A sequence has at most ``capacity`` pieces of one token, so a group is small.
    """
    joined = pieces.select(*keys, "ids").join(packed.select(*keys, "sequence_id", "offset", "length"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("part"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda x: x["part"]), ""))
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = tokenize(docs, tokenizer, id_col, text_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, [id_col, "piece"]).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
