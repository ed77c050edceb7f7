"""Minimax contiguous partition of atomic groups into shards.

Groups (equal texts) are ordered by a hash of their text. The smallest capacity that some contiguous
partition needs is found by binary search with a greedy check, then the cuts are made there.

The groups stay in Spark. The driver works on atoms, runs of neighbouring groups with their total, largest
and number of groups. Cutting atoms anywhere gives a lower bound of the capacity, never cutting them an
upper one; as long as they differ, the atoms in which a cut may lie are split by further bits of the hash.
So the driver holds some thousand atoms however many groups there are, and the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import number_within, slices_for, written

FIRST_BITS, MORE_BITS = 12, 6


@dataclass(frozen=True, order=True)
class Atom:
    """Groups whose key, shifted right by ``shift``, is ``prefix``."""

    low: int
    shift: int
    total: int
    groups: int
    largest: int

    @property
    def high(self) -> int:
        return self.low + (1 << self.shift) - 1


def atoms_of(groups: DataFrame, shift: int, inside: list[Atom] | None = None) -> list[Atom]:
    if inside is not None:  # all of the same shift; some hundred at most
        groups = groups.filter(F.shiftright("key", inside[0].shift).isin([a.low >> a.shift for a in inside]))
    prefix = F.shiftright("key", shift).alias("prefix")
    rows = groups.groupBy(prefix).agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect()
    return sorted(Atom(r[0] << shift, shift, r[1], r[2], r[3]) for r in rows)


def cuts_of(atoms: list[Atom], ends: list[int], shards: int, capacity: int, fluid: bool) -> list[int] | None:
    """Greedy positions of the cuts, or None if ``capacity`` needs more shards. fluid: atoms of several groups can be cut."""
    at, out = 0, []
    for _ in range(shards - 1):
        reach = at + capacity
        if reach >= ends[-1]:
            return out + [ends[-1]] * (shards - 1 - len(out))
        k = bisect_right(ends, reach)  # the first atom that doesn't fit whole
        start = ends[k - 1] if k else 0
        if fluid and atoms[k].groups > 1:
            at = reach
        elif start <= at:
            return None
        else:
            at = start
        out.append(at)
    return out if ends[-1] - at <= capacity else None


def least_capacity(atoms: list[Atom], ends: list[int], shards: int, fluid: bool) -> int:
    low, high = max(max(a.largest for a in atoms), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if cuts_of(atoms, ends, shards, middle, fluid) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the last key of each shard but the last, for groups (key, size)."""
    atoms = atoms_of(groups, 64 - FIRST_BITS)
    if not atoms:
        return 0, []
    while True:
        ends = list(accumulate(a.total for a in atoms))
        low, high = (least_capacity(atoms, ends, shards, fluid) for fluid in (True, False))
        split = {a for a in atoms if a.groups > 1 and a.largest * 2 * shards > ends[-1]}
        if low < high:
            near, far = (cuts_of(atoms, ends, shards, c, f) for c, f in ((low, True), (high, False)))
            for a, b in zip(near, far):
                first, last = bisect_right(ends, min(a, b) - 1), bisect_right(ends, max(a, b))
                split |= {x for x in atoms[first : last + 1] if x.groups > 1}
        split = {a for a in split if a.shift}
        if not split:
            return high, [atoms[k - 1].high if k else -(1 << 63) for k in balanced(atoms, ends, shards, high)]
        atoms = [a for a in atoms if a not in split]
        for shift in {a.shift for a in split}:
            atoms += atoms_of(groups, max(0, shift - MORE_BITS), [a for a in split if a.shift == shift])
        atoms.sort()


def balanced(atoms: list[Atom], ends: list[int], shards: int, capacity: int) -> list[int]:
    """Numbers of atoms before each cut: within ``capacity``, and shards that a hot group leaves are near equal."""
    starts = [0, *ends]
    earliest, at = [0] * shards, len(atoms)
    for j in range(shards - 1, 0, -1):  # later shards filled from the back
        at = next(k for k in range(len(starts)) if starts[at] - starts[k] <= capacity)
        earliest[j] = at
    out, at = [], 0
    for j in range(1, shards):
        left, parts = ends[-1] - starts[at], shards - j + 1
        big: list[int] = []
        aim = left / parts
        for size in sorted((a.total for a in atoms[at:] if a.total > left / parts), reverse=True):
            if size <= aim or len(big) + 1 >= parts:
                break
            big.append(size)
            aim = (left - sum(big)) / (parts - len(big))
        k = bisect_right(starts, starts[at] + aim) - 1
        if k < len(atoms) and abs(starts[k + 1] - starts[at] - aim) < abs(starts[k] - starts[at] - aim):
            k += 1
        most = bisect_right(starts, starts[at] + capacity) - 1
        at = max(earliest[j], at, min(k, most))
        out.append(at)
    return out


def text_key(text: Column) -> Column:
    """Key of a text; texts that collide (or null and the empty text) form one group, which breaks no law."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, key, shard, slot): rows with equal texts share a shard.

    ``size`` is the text's UTF-8 bytes plus 1, a null text counts no bytes (its crc32 is 0). The largest
    shard is as small as the order of the groups allows. ``slot`` numbers the rows of a shard from 0 without
    gaps; repeated rows get slots of their own. With fewer groups than shards some shards are empty, an
    empty table gives an empty table. Other columns are not carried on.
    """
    text = F.col(text_col).cast("string")
    rows = written(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            text_key(text).alias("key"),
        )
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")))
    _, lasts = minimax(groups, shards)
    number = sum(((F.col("key") > F.lit(last)).cast("int") for last in lasts), F.lit(0))
    placed = rows.withColumn("shard", number.cast("int"))
    return number_within(placed, ["shard"], [F.col(id_col), F.col("key")], "slot", slices_for(rows.count()))
