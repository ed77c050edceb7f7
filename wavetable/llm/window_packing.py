"""Order-preserving packing: a token stream is cut into windows at document and sentence ends.

Documents stay in the order of their table and their tokens form one stream a task. A dynamic program chooses
the cuts: a window costs its padding, a cut inside a document costs a penalty. Padding falls by one with every
token, so the best start of a window within reach is the minimum of a sliding window, which a monotone queue
gives in constant time; windows of a power of two need no padding and are tried one by one.

Nothing is shuffled: a task reads its documents once, solves blocks of the stream and writes their pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.packing import encoder

CAPACITY = 2048
#: Ends every document.
END = 1
#: Tokens of padding that a cut at a sentence end, and one inside a sentence, are worth.
SENTENCE, INSIDE = 8, 64
#: A block of the stream ends with the first document that reaches this many tokens.
BLOCK = 1 << 19


@lru_cache(maxsize=2)
def marks(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every id: ends a sentence, starts with white space, holds a line end."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    stop, space, line = np.zeros((3, max(vocabulary.values()) + 1), bool)
    for token, k in vocabulary.items():  # byte-level vocabularies write a space as Ġ and a line end as Ċ
        stop[k] = token.rstrip("\"')]").endswith((".", "!", "?", "ãĢĤ"))
        space[k] = token.startswith(("Ġ", "Ċ"))
        line[k] = "Ċ" in token
    return stop, space, line


def sentence_ends(ids: np.ndarray, tokenizer: str) -> np.ndarray:
    """Places in ``ids`` before which a sentence or line has ended."""
    stop, space, line = marks(tokenizer)
    return np.flatnonzero(line[ids[:-1]] | (stop[ids[:-1]] & space[ids[1:]])) + 1


def cut_places(ends: np.ndarray, sentences: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) where a window may start or end; ``ends`` are the document ends.

    Where no document or sentence ends for an eighth of a window, cuts inside the sentence are allowed at every
    thirty-second part of a window.
    """
    places = np.unique(np.concatenate([[0], ends, sentences]))
    gaps, step = np.diff(places), max(1, capacity // 32)
    long = np.flatnonzero(gaps > max(1, capacity // 8))
    inside = [np.arange(places[k] + step, places[k + 1], step) for k in long]
    every = np.unique(np.concatenate([places, *inside])).astype(np.int64)
    penalties = np.full(len(every), INSIDE, np.int64)
    penalties[np.searchsorted(every, sentences)] = SENTENCE
    penalties[np.searchsorted(every, ends)] = 0
    return every, penalties


def padding(length: int, capacity: int) -> int:
    """Padding of a window: none at a power of two, otherwise up to ``capacity``."""
    return 0 if length & (length - 1) == 0 else capacity - length


def windows(places: np.ndarray, penalties: np.ndarray, capacity: int) -> list[int]:
    """Indexes into ``places`` of the cuts with the least padding plus penalties, first and last place included."""
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(len(places))
    pairs = []  # (end, start) of windows of a power of two
    for k in range(capacity.bit_length()):
        if 1 << k <= capacity:
            end = np.flatnonzero(places >= 1 << k)
            start = index[places[end] - (1 << k)]
            pairs.append(np.stack([end, start])[:, start >= 0])
    end, start = np.concatenate(pairs, axis=1)
    order = np.argsort(end, kind="stable")
    first, exact = np.searchsorted(end[order], np.arange(len(places) + 1)).tolist(), start[order].tolist()
    at, penalties = places.tolist(), penalties.tolist()
    cost, level, back = [0] * len(at), [0] * len(at), [0] * len(at)  # level: cost plus place, which the queue orders
    queue, head = [0], 0
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[head]] < here - capacity:
            head += 1
        best, best_start = level[queue[head]] + capacity - here, queue[head]
        for i in exact[first[j] : first[j + 1]]:
            if cost[i] < best:
                best, best_start = cost[i], i
        best += penalties[j]
        cost[j], back[j] = best, best_start
        level[j] = mine = best + here
        while len(queue) > head and level[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def pack_block(ids: np.ndarray, ends: np.ndarray, tokenizer: str, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of one block in order: doc (its number in the block), start, length, doc_tokens, window, offset, place."""
    places, penalties = cut_places(ends, sentence_ends(ids, tokenizer), capacity)
    cuts = places[windows(places, penalties, capacity)]
    bounds = np.concatenate([[0], ends])
    edges = np.union1d(cuts, bounds)
    place = edges[:-1]
    doc, window = np.searchsorted(bounds, place, "right") - 1, np.searchsorted(cuts, place, "right") - 1
    return {
        "doc": doc, "start": place - bounds[doc], "length": np.diff(edges), "doc_tokens": np.diff(bounds)[doc],
        "window": window, "offset": place - cuts[window], "place": place,
    }


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in windows of at most ``capacity`` tokens.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of a document, ``END`` last, is in
    exactly one piece; pieces of a document and documents of an input split keep their order, and sequence ids
    ascend with it. A null text is empty and has ``END`` alone; repeated rows are documents of their own; an empty
    table gives no rows. Other columns are not carried on.
    """
    kind = docs.schema[id_col].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(n, T.LongType()) for n in names]])
    end = np.array([END], "<u4").tobytes()

    def solve(keys: list, parts: list[bytes], first: int, type_) -> tuple[pa.RecordBatch, int]:
        data = b"".join(parts)
        found = pack_block(np.frombuffer(data, "<u4"), np.cumsum([len(p) // 4 for p in parts]), tokenizer, capacity)
        spans = zip((4 * found["place"]).tolist(), (4 * (found["place"] + found["length"])).tolist())
        view = memoryview(data)
        columns = found | {"ids_crc32": np.array([zlib.crc32(view[a:b]) for a, b in spans]), "sequence_id": first + found["window"]}
        ids = pa.array(keys, type_).take(pa.array(found["doc"]))
        batch = pa.RecordBatch.from_arrays([ids, *[pa.array(columns[n], pa.int64()) for n in names]], names=schema.names)
        return batch, first + int(found["window"][-1]) + 1

    def pack(batches):
        from pyspark import TaskContext

        encode, first = encoder(tokenizer), TaskContext.get().partitionId() << 40
        keys, parts, total, type_ = [], [], 0, None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for low in range(0, len(batch), 512):
                some = batch.slice(low, 512)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    parts.append(encode(text or "") + end)
                    keys.append(key)
                    total += len(parts[-1]) // 4
                    if total >= BLOCK:
                        out, first = solve(keys, parts, first, type_)
                        yield out
                        keys, parts, total = [], [], 0
        if parts:
            yield solve(keys, parts, first, type_)[0]

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pack, schema)
