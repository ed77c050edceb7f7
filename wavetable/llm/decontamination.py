"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``budget`` edits. Cut into budget + 1 pieces, at least one piece occurs
unchanged, so exact piece hits (one Aho-Corasick pass over a text) find every occurrence, and Myers'
bit-parallel distance decides around each hit. Letters' case, punctuation and white space don't count.
"""

from __future__ import annotations

import re
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import written

#: Edits allowed for 100 characters of an item; items of fewer words and characters would match by chance and have to occur exactly.
PERCENT, MIN_WORDS, MIN_CHARS = 6, 8, 40
#: Items of one pass over the documents: bounds what is sent to the tasks.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
WORD = re.compile(r"\w+")


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, percent: int) -> int:
    return length * percent // 100


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``item`` cut into edits + 1 pieces of near equal length."""
    bounds = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:]) if a < b]


def distances(pattern: str, text: str, anchored: bool = False):
    """Myers: the edit distance of ``pattern`` to the best substring that ends at each place of ``text``; anchored: to each prefix."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << size - 1
    up, down, score = full, 0, size
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | anchored) & full, less << 1 & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        yield score


def occurrence(item: str, text: str, near: int, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence that begins within ``edits`` of ``near``."""
    low = max(0, near - edits)
    window = text[low : near + len(item) + edits]
    best, end = min(((d, k) for k, d in enumerate(distances(item, window), 1)), default=(edits + 1, 0))
    if best > edits:
        return None
    back = window[max(0, end - len(item) - edits) : end][::-1]
    length = min((abs(d - best), abs(k - len(item)), k) for k, d in enumerate(distances(item[::-1], back, True), 1))[2]
    return best, low + end - length, low + end


class Items:
    """Test items as an automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], percent: int, min_words: int = MIN_WORDS):
        import ahocorasick

        self.short = [text.count(" ") + 1 < min_words and len(text) < MIN_CHARS for _, text in items]
        self.items = [(key, text, 0 if short else budget(len(text), percent)) for (key, text), short in zip(items, self.short)]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) in the normal form ``text``; overlapping occurrences of an item count once, the closest.

        Short items occur without edits and between word borders only.
        """
        if not len(self.automaton):
            return []
        tried, found = set(), {}
        for last, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                near = last + 1 - length - offset
                if self.short[k]:
                    if text[near - 1 : near] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        found.setdefault(k, set()).add((0, near, last + 1))
                elif (k, near) not in tried:
                    tried.add((k, near))
                    got = occurrence(self.items[k][1], text, max(0, near), self.items[k][2])
                    if got:
                        found.setdefault(k, set()).add(got)
        out = []
        for k, places in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            for distance, start, end in sorted(places):
                if (not taken or start >= taken[-1][1]) if self.short[k] else all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((self.items[k][0], distance, start, end))
        return out

    def spans(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """The same with code points of ``text`` itself."""
        out = []
        hits = self.hits(normal(text or ""))
        if hits:
            starts, ends = [], []  # of each character of the normal form, in the text
            lower = text.lower()
            exact = len(lower) == len(text)
            for m in WORD.finditer(lower):
                if starts:
                    starts.append(m.start())
                    ends.append(m.start())
                starts += range(m.start(), m.end())
                ends += range(m.start() + 1, m.end() + 1)
            back = (lambda x: x) if exact else source_places(text).__getitem__
            out = [(key, d, back(starts[a]), back(ends[b - 1] - 1) + 1) for key, d, a, b in hits]
        return out


def source_places(text: str) -> list[int]:
    """For each character of text.lower() the character of ``text`` it comes from (some letters grow)."""
    return [k for k, c in enumerate(text) for _ in c.lower()]


def blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of bounded size of (item, normal form), read one after the other; items without words are left out."""
    rows = benchmark.select(F.col(item_col), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator()
    cleaned = ((r[0], normal(r[1])) for r in rows)
    usable = (x for x in cleaned if x[1])
    while chunk := list(islice(usable, 1)):
        size = len(chunk[0][1])
        while len(chunk) < BLOCK_ITEMS and size < BLOCK_CHARS and (more := next(usable, None)):
            chunk.append(more)
            size += len(more[1])
        yield chunk


#: The automaton of the last block that this worker has seen, by the block's number.
_BUILT: dict[str, Items] = {}


def built(shared, percent: int, min_words: int) -> Items:
    """The automaton of a block that was broadcast, built once in each worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Items(shared.value, percent, min_words)
    return _BUILT[shared.id]


class Block:
    """A broadcast block of items (see BLOCK_CHARS for its bound) under a number of its own."""

    def __init__(self, spark: SparkSession, items: list):
        self.id, self._items = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @property
    def value(self) -> list:
        return self._items.value


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """(id, item, distance, start, end): occurrences of test items in whole texts, in code points.

    Each block of items is one pass over the documents, so the size of the benchmark is not limited. Null and
    empty texts have no hits, nor have items without words. Items of fewer than ``min_words`` words and MIN_CHARS
    characters have to occur whole and without edits. Repeated rows give their hits each; repeated items count
    each. Other columns are not carried on.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
    types = [pa.int32()] * 3

    def search(items):
        shared = Block(docs.sparkSession, items)

        def run(batches):
            tool = built(shared, percent, min_words)
            for batch in batches:
                for low in range(0, len(batch), 512):
                    texts = batch.column(1).slice(low, 512).to_pylist()
                    rows = [(i, *hit) for i, text in enumerate(texts, low) for hit in tool.spans(text)]
                    columns = list(zip(*rows)) or [()] * 5
                    keys = pa.array(columns[1], from_arrow)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(columns[0], pa.int64())), keys, *[pa.array(c, t) for c, t in zip(columns[2:], types)]], names=schema.names
                    )

        return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    from_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    found = [written(search(chunk)) for chunk in blocks(benchmark, item_col, item_text)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """Rows of ``docs`` in which no test item occurs; all columns stay. See ``leaks`` for what counts."""

    def keep(items):
        shared = Block(docs.sparkSession, items)

        def run(batches):
            tool = built(shared, percent, min_words)
            for batch in batches:
                clean = [not tool.hits(normal(t or "")) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    at, first = docs.columns.index(text_col), True
    for chunk in blocks(benchmark, item_col, item_text):
        if not first:
            docs = written(docs)
        docs, first = docs.mapInArrow(keep(chunk), docs.schema), False
    return docs
