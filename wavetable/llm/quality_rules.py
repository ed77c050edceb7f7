"""Quality rules as gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled documents, with monotonic constraints: more symbols, repeated
lines or repeated words can never raise a score. They are flattened into node arrays, which score whole
batches at once. Beside them stand the fixed rules (``base_failed``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.common import fresh
from wavetable.llm.minhash import mixed

#: Labelled documents that the trees learn from, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, PENALTY = 60, 3, 0.2, 64, 10, 1.0
#: A document is rejected below 0.5, and never so that more than this share of good training documents go.
GOOD_LOST = 0.005
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their constraint: -1 never rises with the feature, 0 free.
FEATURES = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "distinct_share": 0, "word_length": 0, "upper_share": 0,
    "digit_share": 0, "mark_share": 0, "words_a_line": 0, "log_words": 0,
}
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first one included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + mixed(ids[k : k + n])
    _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(counts[back] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """COUNTS and FEATURES of a whole text; a null text is an empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, seen = data.split(), {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    share = lambda k, of: k / of if of else 0.0
    cut = lambda kind: share(len(data) - len(data.translate(None, kind)), len(data))
    top = int(np.bincount(ids.astype(np.int64)).max()) if n else 0
    features = [
        share(symbols, chars), share(dup, len(lines)), share(repeats, n), share(top, n), share(len(seen), n), share(chars, n), cut(UPPER),
        cut(DIGITS), cut(MARKS), share(n, len(lines)), float(np.log1p(n)),
    ]
    return (n, chars, symbols, dup, repeats), features


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


@dataclass
class Forest:
    """Trees as node arrays; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    cut: float
    depth: int = DEPTH

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.feature[node]
                node = np.where(x[rows, inner] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, signs: np.ndarray) -> list[list]:
    """One tree as nodes [feature, threshold, left, right, value]; values keep the order that ``signs`` ask for."""
    nodes: list[list] = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + PENALTY), low, high))

    def gain(g, h, value):
        return -(g * value + 0.5 * (h + PENALTY) * value**2)

    def add(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value, at = leaf(g, h, low, high), len(nodes)
        nodes.append([-1, np.inf, at, at, value])
        best = (1e-6, None)
        for f, e in enumerate(edges if depth else []):
            if not len(e):
                continue
            b, size = bins[rows, f], len(e) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (gradient[rows], hessian[rows], None))
            vl, vr = np.clip(-gl / (hl + PENALTY), low, high), np.clip(-(g - gl) / (h - hl + PENALTY), low, high)
            ok = (nl >= LEAST_LEAF) & (len(rows) - nl >= LEAST_LEAF) & ((vr - vl) * signs[f] >= 0)
            won = np.where(ok, gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, value), -np.inf)
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (won[k], (f, k, vl[k], vr[k]))
        if best[1]:
            f, k, vl, vr = best[1]
            middle, goes = (vl + vr) / 2, bins[rows, f] <= k
            (la, lb), (ra, rb) = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
            left = add(rows[goes], depth - 1, la, lb)
            right = add(rows[~goes], depth - 1, ra, rb)
            nodes[at][:4] = [f, float(edges[f][k]), left, right]
        return at

    add(np.arange(len(bins)), DEPTH, -np.inf, np.inf)
    return nodes


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic boosting on statistics ``x`` with labels 0 and 1; without both labels every score is the labels' mean."""
    signs, edges = np.array(list(FEATURES.values())), []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) < BINS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])))
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(x) else x
    rate = np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99)
    margin = np.full(len(x), np.log(rate / (1 - rate)))
    flat, roots = [[-1, np.inf, 0, 0, float(np.log(rate / (1 - rate)))]], [0]
    for _ in range(TREES if len(set(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(bins, edges, p - y, p * (1 - p), signs)
        start = len(flat)
        roots.append(start)
        flat += [[f, t, a + start, b + start, v * RATE] for f, t, a, b, v in tree]
        columns = [np.array(c) for c in zip(*tree)]
        margin += Forest(columns[0], columns[1], columns[2], columns[3], columns[4] * RATE, np.array([0]), 0).margin(x)
    feature, threshold, left, right, value = (np.array(c) for c in zip(*flat))
    forest = Forest(feature, threshold, left, right, value, np.array(roots), 0.5)
    good = forest.score(x[y == 1]) if (y == 1).any() else np.array([1.0])
    forest.cut = float(min(0.5, np.quantile(good, GOOD_LOST)))
    return forest


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(label, key, text) of the documents of ``sample`` labels, those with the smallest hash of their id.

    An id may be on any number of documents: pass what is measured of these rows through ``smallest``.
    """
    chosen = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    text = F.col(text_col).cast("string")
    # bounded: ``sample`` ids
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("label", "key", "text")


def smallest(measured: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows, those with the smallest key (a hash of id and text)."""
    return measured.orderBy("key", "label").limit(sample).drop("key")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees from at most ``sample`` labelled documents.

    Null labels and null ids don't count; repeated rows and rows of a repeated id count each, up to ``sample`` in all.
    Null texts are empty. Without any labelled document every score is 1.
    """

    def measure(batches):
        for batch in batches:
            rows = [statistics(t)[1] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["label", "key", "x"])

    found = labelled(docs, labels, id_col, text_col, label_col, sample).mapInArrow(measure, "label double, key long, x array<double>")
    rows = smallest(found, sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return boost(x, rows["label"].to_numpy(float))


def judged(texts: list[str | None], forest: Forest) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, score and kept of whole texts."""
    measured = [statistics(t) for t in texts]
    failed = np.array([base_failed(c) for c, _ in measured], bool)
    score = forest.score(np.array([f for _, f in measured], float).reshape(len(texts), len(FEATURES)))
    return [c for c, _ in measured], failed, score, ~failed & (score >= forest.cut)


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, score, kept) of every row; null and empty texts fail the fixed rules. Other columns are not carried on."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                counts, failed, score, kept = judged(part.column(1).to_pylist(), forest)
                columns = [pa.array(c, pa.int64()) for c in np.array(counts, np.int64).reshape(-1, len(COUNTS)).T]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(failed), pa.array(score), pa.array(kept)], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all columns. Null and empty texts go; repeated rows go or stay together; no rows give none."""
    name = fresh(*docs.columns, base="rule_text")
    at = len(docs.columns)

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                kept = judged(part.column(at).to_pylist(), forest)[3]
                part = part.filter(pa.array(kept, pa.bool_()))
                yield pa.RecordBatch.from_arrays(part.columns[:at], names=part.schema.names[:at])

    return docs.withColumn(name, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
