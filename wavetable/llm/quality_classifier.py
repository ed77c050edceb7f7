"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, gated attention (tanh times sigmoid) weighs the
passages, and the weighted representation gives the score; labels are known for documents only. The network
is small and learns on a bounded sample; scoring covers all passages of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.quality_rules import labelled, smallest

#: Labelled documents to learn from at most, and passages of each (evenly spaced) at most; scoring has no such bounds.
SAMPLE, SAMPLE_PASSAGES = 8_000, 64
PASSAGE = 64
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 40, 64, 0.01, 1e-4


def byte_kinds() -> np.ndarray:
    """Kind of each byte: blanks, line ends, digits, lower case, upper case, other bytes, and each mark by itself."""
    kinds = np.full(256, 5)
    kinds[[9, 11, 12, 13, 32]], kinds[10], kinds[48:58], kinds[97:123], kinds[65:91] = 0, 1, 2, 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kinds[marks] = 6 + np.arange(len(marks))
    return kinds


KINDS = byte_kinds()
N_KINDS = int(KINDS.max()) + 1
#: Shares of the byte kinds, word length, distinct words, passage length, and the share of words known from earlier passages.
WIDTH = N_KINDS + 4


def passages(text: str | None) -> np.ndarray:
    """Features of all passages of PASSAGE words, passages x WIDTH; an empty or null text is one passage of zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH))
    raw = np.frombuffer(data, np.uint8)
    kinds = KINDS[raw]
    blank = kinds < 2
    begins = ~blank
    begins[1:] &= blank[:-1]
    word = np.cumsum(begins) - 1
    passage = np.maximum(word, 0) // PASSAGE
    n = len(words)
    count = -(-n // PASSAGE)
    shares = np.bincount(passage * N_KINDS + kinds, minlength=count * N_KINDS).reshape(count, N_KINDS).astype(float)
    sizes = np.minimum(PASSAGE, n - PASSAGE * np.arange(count))
    visible = shares[:, 2:].sum(axis=1)
    shares /= shares.sum(axis=1, keepdims=True)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    where = np.arange(n) // PASSAGE
    distinct = np.bincount(np.unique(where * n + ids) // n, minlength=count)
    first = np.zeros(n, bool)
    first[np.unique(ids, return_index=True)[1]] = True
    new = np.bincount(where, first, minlength=count)
    more = np.stack([visible / sizes / 10, distinct / sizes, sizes / PASSAGE, 1 - new / sizes], axis=1)
    return np.concatenate([shares, more], axis=1)


@dataclass
class Network:
    """Weights; ``mean`` and ``scale`` standardise the passage features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, s = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * s) @ w["attend"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"])))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "bag": bag}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["p"]

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, v = self.weights, self.forward(x, starts)
        d = (v["p"] - y) / len(y)
        dz = np.outer(d, w["out"])[v["bag"]]
        da = (dz * v["h"]).sum(axis=1)
        de = v["a"] * (da - np.add.reduceat(v["a"] * da, starts)[v["bag"]])
        dt = np.outer(de, w["attend"])
        dg, ds = dt * v["s"] * (1 - v["t"] ** 2), dt * v["t"] * v["s"] * (1 - v["s"])
        dh = v["a"][:, None] * dz + dg @ w["tanh"].T + ds @ w["gate"].T
        du = dh * (1 - v["h"] ** 2)
        return {
            "encode": v["x"].T @ du, "encode_bias": du.sum(axis=0), "tanh": v["h"].T @ dg, "gate": v["h"].T @ ds,
            "attend": (v["t"] * v["s"]).T @ de, "out": v["z"].T @ d, "out_bias": d.sum(),
        }


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss of whole bags; without examples every score is near one half."""
    rng = np.random.default_rng(seed)
    shapes = {"encode": (WIDTH, HIDDEN), "encode_bias": (HIDDEN,), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,), "out_bias": ()}
    weights = {k: np.asarray(rng.normal(size=s) / np.sqrt(s[0] if s else 1) * ("bias" not in k)) for k, s in shapes.items()}
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    network = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, weights)
    first, second, step = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            chosen = [bags[i] for i in rows]
            found = network.gradient(np.concatenate(chosen), np.cumsum([0, *map(len, chosen[:-1])]), y[rows])
            step += 1
            for k, g in found.items():
                g = g + DECAY * weights[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return network


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES
) -> Network:
    """A network from at most ``sample`` labelled documents. Texts are its only input; null ones are empty.

    Null labels and ids don't count; repeated rows and rows of a repeated id count each, up to ``sample`` in all.
    """

    def encode(batches):
        for batch in batches:
            bags = []
            for text in batch.column(2).to_pylist():
                bag = passages(text)
                if len(bag) > sample_passages:
                    bag = bag[np.linspace(0, len(bag) - 1, sample_passages).astype(int)]
                bags.append(bag.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.float64()))], names=["label", "key", "bag"])

    found = labelled(docs, labels, id_col, text_col, label_col, sample).mapInArrow(encode, "label double, key long, bag array<double>")
    rows = smallest(found, sample).toPandas()
    # in an order that doesn't depend on how Spark split the table
    found = sorted(((np.asarray(b, float).tobytes(), y) for b, y in zip(rows["bag"], rows["label"])))
    return train([np.frombuffer(b).reshape(-1, WIDTH) for b, _ in found], np.array([y for _, y in found]))


def classify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from all passages of its text. Null and empty texts get a score too. Other columns are not carried on."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(network.score([passages(t) for t in part.column(1).to_pylist()]))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
