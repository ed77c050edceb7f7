"""Regression trees on byte-binned spectra: the growth that forests and boosters share.

Every channel is cut into at most 256 bins, so a spectrum is a short byte string and a split is a channel and
a bin. All draws (rows of a tree, channels of a node) are hashes of the row, the tree and the path to the node.
Nothing depends on the order of work, so one growth serves many settings: fewer trees are a prefix, a smaller
depth or a larger ``min_split`` cuts the same trees nearer to the root.

Tables of up to ``LOCAL_BYTES`` are broadcast and every task grows whole trees. Larger ones are grown level by
level: one pass over the binned table makes the histograms of all open nodes of all trees, and nodes of at most
``SMALL`` rows are finished together, each in a task of its own. Both ways take the same splits.
"""

from __future__ import annotations

import base64
import heapq
import io
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.arrow import to_block
from wavetable.operators.compiled import columns_of, grown_in_jvm, jvm_table
from wavetable.session import durable

BINS = 256
#: Rows, and values, of the sample that bin edges are taken from; tables of no more rows are used whole.
SAMPLE_ROWS, SAMPLE_VALUES = 8192, 1 << 24
#: Binned tables up to this size are broadcast.
LOCAL_BYTES = 1 << 26
#: Nodes of at most this many rows are finished in one task.
SMALL = 20_000
#: Histograms of one pass and task.
HISTOGRAM_BYTES = 1 << 26
#: Nodes of at most FEW rows are sorted many at once, larger ones counted into bins; so many rows and channels at a time.
FEW, ROWS_AT_ONCE, CHANNELS_AT_ONCE = 256, 2048, 64
#: Gains below this share of the label's variance are rounding.
NOISE = 1e-9


# --- draws


def mix(*parts) -> np.ndarray:
    """64 well mixed bits of unsigned integers, element by element."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            x = np.asarray(part).astype(np.uint64) + out + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = x ^ (x >> np.uint64(31))
    return out


def uniform(*parts) -> np.ndarray:
    return (mix(*parts) >> np.uint64(11)) * 2.0**-53


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(16)])


def tree_key(seed: int, tree: int) -> np.uint64:
    return mix(seed, tree)[()]


def row_weights(keys: np.ndarray, tree: np.uint64, share: float | None) -> np.ndarray:
    """How often a tree sees each row: Poisson with mean one (None), every row (1) or a share of them."""
    if share is not None and share >= 1:
        return np.ones(len(keys))
    drawn = uniform(keys.view(np.uint64), tree, 11)
    return np.searchsorted(_POISSON, drawn, "right").astype(float) if share is None else (drawn < share).astype(float)


def drawn_channels(keys: np.ndarray, channels: int, count: int) -> np.ndarray:
    """(keys, channels): True for the ``count`` channels that each key may use."""
    order = np.argsort(mix(keys[:, None], np.arange(channels), 7), axis=1, kind="stable")
    allowed = np.zeros((len(keys), channels), bool)
    np.put_along_axis(allowed, order[:, :count], True, axis=1)
    return allowed


# --- binned tables


@dataclass(frozen=True)
class Binned:
    """(key, fold, label, bins) written to the checkpoint folder, with the edges of the bins."""

    table: DataFrame
    edges: list
    rows: int
    mean: float
    variance: float

    @property
    def channels(self) -> int:
        return len(self.edges)

    @property
    def local(self) -> bool:
        return self.rows * (self.channels + 24) <= LOCAL_BYTES

    @property
    def ordered(self) -> DataFrame:
        return self.table.orderBy("key", "label", "bins")

    @cached_property
    def compiled(self):
        """The whole table in the JVM of every executor; only for tables that are ``local``."""
        return jvm_table(self)

    @cached_property
    def labels(self):
        """Folds and labels around their mean on every executor."""
        part = self.ordered.select("fold", "label").toArrow()
        return self.table.sparkSession.sparkContext.broadcast((part.column("fold").to_numpy(), part.column("label").to_numpy() - self.mean))

    @cached_property
    def shared(self):
        """The whole table as arrays on every executor; only for tables that are ``local``."""
        part = self.ordered.toArrow()
        x = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, self.channels)
        arrays = (part.column("key").to_numpy(), part.column("fold").to_numpy(), part.column("label").to_numpy() - self.mean, x)
        return self.table.sparkSession.sparkContext.broadcast(arrays)


def edges_of(sample: np.ndarray) -> list[np.ndarray]:
    """For every channel the upper bounds of its bins but the last, between values of the sample."""
    out = []
    for values in sample.T:
        distinct = np.unique(values)
        if len(distinct) > BINS:
            distinct = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
        out.append((distinct[:-1] + distinct[1:]) / 2)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def binned(df: DataFrame, spectrum: str = "spectrum", label: str = "label", row_id: str | None = "row_id", fold: str | None = None) -> Binned:
    """Bin the rows that have a spectrum and a label. Rows with equal ids (or without one, equal spectra) share their draws."""
    ids = F.col(row_id) if row_id in df.columns else F.col(spectrum)
    rows = df.filter(F.col(label).isNotNull() & F.col(spectrum).isNotNull()).select(
        F.xxhash64(ids).alias("key"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
        F.col(label).cast("double").alias("label"), F.col(spectrum).cast("array<double>").alias("spectrum"),
    )
    first = rows.select("spectrum").first()
    if first is None:
        raise ValueError("no row has a spectrum and a label")
    most = max(BINS, min(SAMPLE_ROWS, SAMPLE_VALUES // len(first[0])))
    edges = edges_of(to_block(rows.orderBy("key").limit(most).select("spectrum").toArrow().column(0)))

    def bin_rows(batches):
        for batch in batches:
            data = to_bins(to_block(batch.column(3)), edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in data], pa.binary())],
                names=["key", "fold", "label", "bins"],
            )

    table = durable(rows.mapInArrow(bin_rows, "key long, fold int, label double, bins binary"))
    level = table.agg(F.count("*"), F.avg("label"), F.var_pop("label")).first()
    return Binned(table, edges, level[0], level[1], level[2])


# --- one tree


@dataclass(frozen=True)
class Rule:
    """When and how a node is split."""

    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    min_weight: float = 0.0
    smoothing: float = 0.0
    min_gain: float = 0.0
    max_leaves: int | None = None
    node_channels: int | None = None
    tree_channels: int | None = None


FIELDS = {"feature": np.int32, "bin": np.int16, "left": np.int32, "value": float, "rows": np.int64, "weight": float, "gain": float, "depth": np.int32}


class Builder:
    """A tree that grows as its open nodes are offered their best splits; children are ``left`` and ``left + 1``."""

    def __init__(self, rule: Rule, key: np.uint64, channels: int, rows: int, weight: float, total: float, depth: int = 0, tree: np.uint64 | None = None):
        self.rule, self.channels = rule, channels
        self.columns = {name: [] for name in FIELDS}
        self.keys, self.sums, self.offers, self.frontier, self.leaves = [], [], [], [], 1
        self.only = None if rule.tree_channels is None else drawn_channels(np.array([key if tree is None else tree]), channels, rule.tree_channels)[0]
        self._add(key, rows, weight, total, depth)
        self.frontier = [0]

    def _add(self, key, rows, weight, total, depth):
        values = (-1, 0, -1, total / (weight + self.rule.smoothing) if weight else 0.0, rows, weight, 0.0, depth)
        for name, value in zip(FIELDS, values):
            self.columns[name].append(value)
        self.keys.append(key)
        self.sums.append(total)

    def wanted(self) -> list[int]:
        """Open nodes that may be split."""
        rule, c = self.rule, self.columns
        least = max(rule.min_split, 2 * rule.min_leaf, 2)
        return [k for k in self.frontier if c["rows"][k] >= least and (rule.max_depth is None or c["depth"][k] < rule.max_depth)]

    def allowed(self, nodes: list[int]) -> np.ndarray | None:
        """(nodes, channels) that may be used; None for all."""
        if self.rule.node_channels is not None:
            return drawn_channels(np.array([self.keys[k] for k in nodes], np.uint64), self.channels, self.rule.node_channels)
        return None if self.only is None else np.repeat(self.only[None], len(nodes), axis=0)

    def offer(self, node: int, gain: float, feature: int, at: int, rows: int, weight: float, total: float, least: float) -> None:
        """The node's best split, with rows, weight and sum of its left side."""
        if gain > least and gain > 2 * self.rule.min_gain:
            heapq.heappush(self.offers, (-gain, node, feature, at, rows, weight, total))

    def advance(self) -> list[int]:
        """Split what the rule allows: every offered node, or the best one while leaves are left."""
        taken = []
        while self.offers and (self.rule.max_leaves is None or (self.leaves < self.rule.max_leaves and not taken)):
            taken.append(heapq.heappop(self.offers))
        self.frontier = []
        c = self.columns
        for gain, node, feature, at, rows, weight, total in sorted(taken, key=lambda t: t[1]):
            left = len(self.keys)
            c["feature"][node], c["bin"][node], c["left"][node], c["gain"][node] = feature, at, left, -gain
            self._add(mix(self.keys[node], 1)[()], rows, weight, total, c["depth"][node] + 1)
            self._add(mix(self.keys[node], 2)[()], c["rows"][node] - rows, c["weight"][node] - weight, self.sums[node] - total, c["depth"][node] + 1)
            self.frontier += [left, left + 1]
            self.leaves += 1
        return [t[1] for t in taken]

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: np.array(self.columns[name], kind) for name, kind in FIELDS.items()}

    def graft(self, node: int, part: dict[str, np.ndarray]) -> None:
        """Put a tree grown elsewhere in the place of a leaf; its first node is that leaf."""
        shift = len(self.keys) - 1
        for name in FIELDS:
            new = np.where(part["left"] >= 0, part["left"] + shift, -1) if name == "left" else part[name]
            self.columns[name][node] = new[0].item()
            self.columns[name] += new[1:].tolist()
        self.keys += [np.uint64(0)] * (len(part["left"]) - 1)


def gains(left_weight, left_sum, weight, total, smoothing):
    """Gain of every split in single precision, so that equal gains stay equal whatever the order of their sums."""
    with np.errstate(divide="ignore", invalid="ignore"):
        right = total - left_sum
        gain = left_sum**2 / (left_weight + smoothing) + right**2 / (weight - left_weight + smoothing) - total**2 / (weight + smoothing)
        return gain.astype(np.float32)


def best_of_sorted(x, order, node, starts, t, w, rule: Rule, allowed):
    """Best split of each node, one by one; ``x`` is (channels, rows), ``order`` has the rows of all nodes for each channel."""
    rows = order[0][np.argsort(node[order[0]], kind="stable")]
    found = best_splits(np.ascontiguousarray(x.T), rows, starts, t, w, rule, allowed)
    for k, split in enumerate(zip(*(column.tolist() for column in found))):
        yield k, *split


def best_splits(x, rows, starts, t, w, rule: Rule, allowed):
    """(gain, feature, bin, rows, weight, sum) of the best split of each node, as arrays; the last three are its left side's.

    ``x`` is (rows, channels), ``rows`` lists the rows of one node after another, ``starts`` where each begins. Blocks of
    rows and channels bound the memory, however many rows there are.
    """
    counts = np.diff(np.append(starts, len(rows)))
    best = [np.full(len(starts), -np.inf), *(np.zeros(len(starts), kind) for kind in (np.int64, np.int64, np.int64, float, float))]
    small = np.flatnonzero(counts <= FEW)
    ends, groups, low = np.cumsum(counts[small]), [], 0
    while low < len(small):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ROWS_AT_ONCE, "right"))
        groups.append(small[low:high])
        low = high
    for first in range(0, x.shape[1], CHANNELS_AT_ONCE):
        part = slice(first, first + CHANNELS_AT_ONCE)
        mask = None if allowed is None else allowed[:, part]
        for k in np.flatnonzero(counts > FEW).tolist():
            table = histogram_of(x, part, rows[starts[k] : starts[k] + counts[k]], t, w)
            keep(best, np.array([k]), first, [np.array([v]) for v in best_of_histogram(table, rule, None if mask is None else mask[k])])
        for nodes in groups:
            sizes = counts[nodes]
            begin = np.cumsum(sizes) - sizes
            some = rows[np.arange(sizes.sum()) + np.repeat(starts[nodes] - begin, sizes)]
            keep(best, nodes, first, best_of_rows(x[some, part], begin, sizes, t[some], w[some], rule, None if mask is None else mask[nodes]))
    return best


def keep(best, nodes, first, found) -> None:
    """Put what beats the best split so far in its place; equal gains leave the lower channel."""
    won = found[0] > best[0][nodes]
    for i, values in enumerate(found):
        best[i][nodes[won]] = values[won] + first if i == 1 else values[won]


def histogram_of(x, part: slice, rows, t, w) -> np.ndarray:
    """(3, channels, bins): rows, weights and sums of one node."""
    channels = x[:1, part].shape[1]
    table, plain = np.zeros((3, channels * BINS)), bool((w[rows] == 1).all())
    for low in range(0, len(rows), ROWS_AT_ONCE):
        some = rows[low : low + ROWS_AT_ONCE]
        index = (x[some, part] + np.arange(channels) * BINS).ravel()
        table[0] += np.bincount(index, minlength=table.shape[1])
        if not plain:
            table[1] += np.bincount(index, np.repeat(w[some], channels), table.shape[1])
        table[2] += np.bincount(index, np.repeat(w[some] * t[some], channels), table.shape[1])
    if plain:
        table[1] = table[0]
    return table.reshape(3, channels, BINS)


def best_of_rows(x, begin, sizes, t, w, rule: Rule, allowed):
    """The same for many small nodes; all arrays hold their rows one node after another, at most 4,096 rows."""
    count, nodes = len(x), np.arange(len(begin))
    slot, place = np.repeat(nodes, sizes), np.arange(count)
    # one sort by node, bin and row: twelve, eight and twelve bits
    head = ((slot << 20) | place).astype(np.uint32)
    order = (np.ascontiguousarray(x.T).astype(np.uint32) << np.uint32(12)) | head
    order.sort(axis=1)
    row = (order & np.uint32(4095)).astype(np.intp)
    weight, total = (np.add.reduceat(v, begin) for v in (w, w * t))

    def sums(values, of_node):
        """Running sums within nodes: every node's first value takes back the sum of the node before."""
        out = values[row]
        out[:, begin[1:]] -= of_node[:-1]
        return np.cumsum(out, axis=1, out=out)

    left_n = place - begin[slot] + 1
    at = np.flatnonzero((left_n >= rule.min_leaf) & (sizes[slot] - left_n >= max(1, rule.min_leaf)))
    left_n, slot = left_n[at], slot[at]
    left_t = sums(w * t, total)[:, at]
    left_w = np.broadcast_to(left_n.astype(float), left_t.shape) if (w == 1).all() else sums(w, weight)[:, at]
    gain = gains(left_w, left_t, weight[slot], total[slot], rule.smoothing)
    bins = order >> np.uint32(12)
    wrong = bins[:, at] == bins[:, at + 1]
    if rule.min_weight:
        wrong |= (left_w < rule.min_weight) | (weight[slot] - left_w < rule.min_weight)
    if allowed is not None:
        wrong |= ~allowed[slot].T
    gain[wrong] = -np.inf
    most = np.maximum.reduceat(gain, np.searchsorted(slot, nodes), axis=1)
    f = most.argmax(axis=0)
    top = most[f, nodes]
    hits = np.flatnonzero(gain[f[slot], np.arange(len(slot))] == top[slot])
    first = hits[np.unique(slot[hits], return_index=True)[1]]
    return top.astype(float), f, (bins[f, at[first]] & np.uint32(255)).astype(np.int64), left_n[first], left_w[f, first], left_t[f, first]


def grow_tree(x, t, w, rule: Rule, key, least: float, depth: int = 0, tree=None) -> dict[str, np.ndarray]:
    """A whole tree of the rows with a weight; ``x`` is (rows, channels)."""
    return grow_siblings(x, t, w, [rule], key, least, depth, tree)[0]


def grow_siblings(x, t, w, rules: list[Rule], key, least: float, depth: int = 0, tree=None) -> list[dict[str, np.ndarray]]:
    """A whole tree for each of ``rules``, which differ in an ascending ``min_leaf`` alone.

    The best split of a node is that of every rule whose leaves its sides can hold. So the trees are searched as one
    where they agree, and a node is searched again only for rules that the first split is too small for.
    """
    rule, leaves = rules[0], np.array([r.min_leaf for r in rules])
    if rule.max_leaves is not None:
        return [grow_leafwise(x, t, w, one, key, least, depth, tree) for one in rules]
    enough = np.maximum(2 * leaves, max(rule.min_split, 2))
    rows = np.flatnonzero(w > 0)
    keys, sizes, mine = np.array([key], np.uint64), np.array([len(rows)]), np.ones((1, len(rules)), bool)
    weight, total = np.array([w[rows].sum()]), np.array([(w[rows] * t[rows]).sum()])
    only = None if rule.tree_channels is None else drawn_channels(np.array([key if tree is None else tree]), x.shape[1], rule.tree_channels)
    levels = []
    while True:
        starts = np.cumsum(sizes) - sizes

        def of(nodes):
            begin = np.cumsum(sizes[nodes]) - sizes[nodes]  # noqa: B023
            return rows[np.arange(sizes[nodes].sum()) + np.repeat(starts[nodes] - begin, sizes[nodes])], begin  # noqa: B023

        wanted = mine & (sizes[:, None] >= enough)
        if rule.max_depth is not None and depth >= rule.max_depth:
            wanted[:] = False
        nodes = np.flatnonzero(wanted.any(axis=1))
        if len(nodes):
            part, begin = of(nodes)
            label = t[part]
            mixed = np.maximum.reduceat(label, begin) > np.minimum.reduceat(label, begin)  # equal labels have nothing to gain
            wanted[nodes[~mixed]] = False
        left_over, found = mine.copy(), []
        for r, one in enumerate(rules):
            nodes = np.flatnonzero(wanted[:, r])
            if not len(nodes):
                continue
            if one.node_channels is not None:
                allowed = drawn_channels(keys[nodes], x.shape[1], one.node_channels)
            else:
                allowed = None if only is None else np.repeat(only, len(nodes), axis=0)
            part, begin = of(nodes)
            split = best_splits(x, part, begin, t, w, one, allowed)
            good = (split[0] > least) & (split[0] > 2 * one.min_gain)
            wanted[nodes[~good]] = False  # no larger leaf has more to gain
            nodes, split = nodes[good], [c[good] for c in split]
            takes = wanted[nodes] & (leaves <= np.minimum(split[3], sizes[nodes] - split[3])[:, None])
            wanted[nodes] &= ~takes
            left_over[nodes] &= ~takes
            found.append((nodes, takes, *split))
        ends = np.flatnonzero(left_over.any(axis=1))
        at = np.concatenate([*(f[0] for f in found), ends])
        order = np.argsort(at, kind="stable")
        at, splits = at[order], order < len(order) - len(ends)
        gain, feature, bound, left_n, left_w, left_t = (
            np.concatenate([*(f[i] for f in found), np.full(len(ends), empty)])[order] for i, empty in zip(range(2, 8), (0.0, -1, 0, 0, 0.0, 0.0))
        )
        mine = np.concatenate([*(f[1] for f in found), left_over[ends]])[order]
        value = np.divide(total, weight + rule.smoothing, out=np.zeros(len(sizes)), where=weight > 0)
        levels.append((mine, splits, {"feature": feature, "bin": bound, "value": value[at], "rows": sizes[at], "weight": weight[at], "gain": gain,
                                      "depth": np.full(len(at), depth)}))
        if not splits.any():
            break
        at, mine, feature, bound, left_n, left_w, left_t = (c[splits] for c in (at, mine, feature, bound, left_n, left_w, left_t))
        rows, _ = of(at)
        size, weight, total, keys = sizes[at], weight[at], total[at], keys[at]
        right = x[rows, np.repeat(feature, size)] > np.repeat(bound, size)
        pairs = lambda a, b: np.stack([a, b], axis=1).ravel()
        sizes = pairs(left_n, size - left_n)
        goes = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
        moved = np.empty_like(rows)
        moved[~goes], moved[goes] = rows[~right], rows[right]
        rows, mine = moved, np.repeat(mine, 2, axis=0)
        keys = pairs(mix(keys, 1), mix(keys, 2))
        weight, total = pairs(left_w, weight - left_w), pairs(left_t, total - left_t)
        depth += 1
    return [one_of(levels, r) for r in range(len(rules))]


def one_of(levels, r: int) -> dict[str, np.ndarray]:
    """The tree of one rule out of levels of ``(rules of each node, whether it is split, columns)``."""
    out, before = [], 0
    for mine, splits, columns in levels:
        keep, left = mine[:, r], np.full(len(splits), -1)
        before += int(keep.sum())
        inner = np.flatnonzero(keep & splits)
        left[inner] = before + 2 * np.arange(len(inner))
        out.append({name: c[keep] for name, c in (*columns.items(), ("left", left))})
    return {name: np.concatenate([level[name] for level in out]).astype(kind) for name, kind in FIELDS.items()}


def grow_leafwise(x, t, w, rule: Rule, key, least: float, depth: int = 0, tree=None) -> dict[str, np.ndarray]:
    """A tree whose best leaf is split first, until it has its leaves."""
    rows = np.flatnonzero(w > 0)
    builder = Builder(rule, key, x.shape[1], len(rows), float(w[rows].sum()), float((w[rows] * t[rows]).sum()), depth, tree)
    rows_of = {0: rows}
    while builder.leaves < rule.max_leaves:
        nodes = builder.wanted()
        if nodes:
            parts = [rows_of[k] for k in nodes]
            starts = np.cumsum([0, *map(len, parts[:-1])])
            found = best_splits(x, np.concatenate(parts), starts, t, w, rule, builder.allowed(nodes))
            for k, *split in zip(nodes, *(column.tolist() for column in found)):
                builder.offer(k, *split, least)
        taken = builder.advance()
        if not taken:
            break
        c = builder.columns
        for k in taken:
            mine = rows_of.pop(k)
            right = x[mine, c["feature"][k]] > c["bin"][k]
            rows_of[c["left"][k]], rows_of[c["left"][k] + 1] = mine[~right], mine[right]
    return builder.arrays()


def sorted_by_bin(x: np.ndarray) -> np.ndarray:
    return np.argsort(x, axis=1, kind="stable")


# --- forests of arrays


@dataclass
class Forest:
    """Trees as flat arrays; ``roots`` holds the first node of each and the number of nodes."""

    roots: np.ndarray
    nodes: dict[str, np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def of(cls, trees: list[dict[str, np.ndarray]]) -> "Forest":
        roots = np.concatenate([[0], np.cumsum([len(t["left"]) for t in trees])]).astype(np.int64)
        nodes = {name: np.concatenate([t[name] for t in trees]) if trees else np.empty(0, kind) for name, kind in FIELDS.items()}
        shift = np.repeat(roots[:-1], np.diff(roots))
        nodes["left"] = np.where(nodes["left"] >= 0, nodes["left"] + shift, -1)
        return cls(roots, nodes)

    def __len__(self):
        return len(self.roots) - 1

    def predict(self, x: np.ndarray, max_depth: int | None = None, min_split: int = 2) -> np.ndarray:
        """(rows, trees): values of binned rows, with trees cut at a depth and where fewer rows remain."""
        n = self.nodes
        final = (n["left"] < 0) | (n["rows"] < min_split)
        if max_depth is not None:
            final |= n["depth"] >= max_depth
        at = np.repeat(self.roots[None, :-1], len(x), axis=0).ravel()
        row = np.repeat(np.arange(len(x)), len(self))
        moving = np.flatnonzero(~final[at])
        while len(moving):
            here = at[moving]
            at[moving] = here = n["left"][here] + (x[row[moving], n["feature"][here]] > n["bin"][here])
            moving = moving[~final[here]]
        return n["value"][at].reshape(len(x), len(self))

    def predict_depths(self, x: np.ndarray, depths: list, min_split: int = 2) -> dict:
        """What ``predict`` gives for each of several depths, from one walk."""
        n, out, step = self.nodes, {}, 0
        final = (n["left"] < 0) | (n["rows"] < min_split)
        at = np.repeat(self.roots[None, :-1], len(x), axis=0).ravel()
        row = np.repeat(np.arange(len(x)), len(self))
        moving = np.flatnonzero(~final[at])
        while len(moving):
            if step in depths:
                out[step] = n["value"][at].reshape(len(x), len(self))
            here = at[moving]
            at[moving] = here = n["left"][here] + (x[row[moving], n["feature"][here]] > n["bin"][here])
            moving = moving[~final[here]]
            step += 1
        last = n["value"][at].reshape(len(x), len(self))
        return {depth: out.get(depth, last) for depth in depths}

    def packed(self, channels: int) -> "PackedForest":
        """The forest as a model keeps it."""
        shift = lambda left, low: np.where(left >= 0, left - low, -1)
        parts = [{name: c[a:b] for name, c in self.nodes.items()} for a, b in zip(self.roots[:-1], self.roots[1:])]
        return PackedForest([packed_tree({**part, "left": shift(part["left"], low)}, channels) for part, low in zip(parts, self.roots)])


def packed_tree(arrays: dict[str, np.ndarray], channels: int) -> bytes:
    """What predictions and importances need of a tree, compressed. Nodes stand breadth first, so no node has to name its children."""
    left, order, at = arrays["left"], [], np.zeros(1, int)
    while len(at):
        order.append(at)
        inner = left[at][left[at] >= 0]
        at = np.stack([inner, inner + 1], axis=1).ravel()
    order = np.concatenate(order)
    splits = left[order] >= 0
    inner, leaves = order[splits], order[~splits]
    gain = np.bincount(arrays["feature"][inner], arrays["gain"][inner], channels)
    buffer = io.BytesIO()
    np.savez_compressed(
        buffer, nodes=len(order), splits=np.packbits(splits), feature=arrays["feature"][inner].astype(np.min_scalar_type(channels)),
        bin=arrays["bin"][inner].astype(np.uint8), value=arrays["value"][leaves], gain=gain,
    )
    return buffer.getvalue()


#: Trees up to this size together stay unpacked in a worker; those of larger forests are unpacked for every batch of rows.
UNPACKED_BYTES = 1 << 27


@dataclass
class PackedForest:
    """Packed trees: what a fitted model holds, saves and sends to its tasks."""

    trees: list[bytes]

    def __len__(self):
        return len(self.trees)

    def unpacked(self):
        """(splits, how many of them up to a node, channel, bin, leaf values) of one tree after another."""
        if "kept" in self.__dict__:
            yield from self.kept
            return
        kept, size = [], 0
        for data in self.trees:
            with np.load(io.BytesIO(data)) as found:
                splits = np.unpackbits(found["splits"], count=int(found["nodes"])).astype(bool)
                tree = splits, np.cumsum(splits, dtype=np.int32), found["feature"], found["bin"], found["value"]
            size += sum(a.nbytes for a in tree)
            kept = [*kept, tree] if size <= UNPACKED_BYTES else []
            yield tree
        if size <= UNPACKED_BYTES:
            self.kept = kept

    def total(self, x: np.ndarray) -> np.ndarray:
        """What all trees say to binned rows, added up."""
        out = np.zeros(len(x))
        for splits, rank, feature, bound, value in self.unpacked():
            at = np.zeros(len(x), np.int64)
            moving = np.arange(len(x) if splits[0] else 0)
            while len(moving):
                inner = rank[at[moving]] - 1
                at[moving] = here = 2 * inner + 1 + (x[moving, feature[inner]] > bound[inner])
                moving = moving[splits[here]]
            out += value[at - rank[at]]
        return out

    def importances(self, channels: int) -> np.ndarray:
        """Gains of each channel as a share of its tree's gains, averaged over the trees that split at all."""
        total, count = np.zeros(channels), 0
        for data in self.trees:
            with np.load(io.BytesIO(data)) as found:
                gain = found["gain"]
            if gain.sum() > 0:
                total, count = total + gain / gain.sum(), count + 1
        return total / max(count, 1)

    def encoded(self) -> str:
        sizes = np.array([len(self.trees), *map(len, self.trees)], np.int64)
        return base64.b64encode(sizes.tobytes() + b"".join(self.trees)).decode()

    @classmethod
    def decoded(cls, text: str) -> "PackedForest":
        data = base64.b64decode(text)
        count = int(np.frombuffer(data, np.int64, 1)[0])
        ends = 8 * (count + 1) + np.cumsum([0, *np.frombuffer(data, np.int64, count, 8)])
        return cls([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])


TREE = "model int, tree int, arrays binary"


def tree_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def tree_arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {name: found[name] for name in FIELDS}


def spread(spark, tasks: list[tuple], schema: str) -> DataFrame:
    """Tasks of local work, one partition each."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(tasks)], f"task int, {schema}").repartitionByRange(max(1, len(tasks)), "task").drop("task")


# --- many forests


@dataclass(frozen=True)
class Growth:
    """One forest: the held-out fold (None: all rows), its trees and their rule."""

    fold: int | None
    trees: int
    rule: Rule
    bootstrap: bool = True
    seed: int = 42


def train_part(shared, fold):
    """(keys, labels, bins) of the rows outside ``fold``."""
    keys, folds, t, x = shared
    part = slice(None) if fold is None else np.flatnonzero(folds != fold)
    return keys[part], t[part], x[part]


def tree_blocks(growths: list[Growth], size: int) -> list[tuple[int, int, int]]:
    return [(g, low, min(low + size, growth.trees)) for g, growth in enumerate(growths) for low in range(0, growth.trees, size)]


def siblings(growths: list[Growth]) -> list[list[int]]:
    """Places of the growths that differ in ``min_leaf`` alone, the smallest first."""
    found: dict[Growth, list[int]] = {}
    for g in sorted(range(len(growths)), key=lambda g: growths[g].rule.min_leaf):
        found.setdefault(replace(growths[g], rule=replace(growths[g].rule, min_leaf=1)), []).append(g)
    return list(found.values())


def sibling_trees(growths: list[Growth], part, tree: int, least: float) -> list[dict[str, np.ndarray]]:
    keys, t, x = part
    key = tree_key(growths[0].seed, tree)
    w = row_weights(keys, key, None if growths[0].bootstrap else 1.0)
    return grow_siblings(x, t, w, [g.rule for g in growths], key, least)


def grow_forests(data: Binned, growths: list[Growth], block: int = 1) -> list[Forest]:
    """One forest for each growth, with all that is known of its nodes, on the driver."""
    if not data.local:
        return grow_by_levels(data, growths)
    return [Forest.of([tree_arrays(t) for t in trees]) for trees in grown_blocks(data, growths, tree_bytes, block)]


def fit_forests(data: Binned, growths: list[Growth], block: int = 1) -> list[PackedForest]:
    """The same forests as models: the driver gets packed trees alone."""
    if not data.local:
        return [forest.packed(data.channels) for forest in grow_by_levels(data, growths)]
    channels = data.channels
    return [PackedForest(trees) for trees in grown_blocks(data, growths, lambda tree: packed_tree(tree, channels), block)]


def plain(growths: list[Growth]) -> list[Growth]:
    """The growths, if they are such as the JVM grows."""
    for g in growths:
        if replace(g.rule, max_depth=None, min_split=2, min_leaf=1, node_channels=None) != Rule():
            raise ValueError(f"not a rule of a forest: {g.rule}")
    return growths


def grown_blocks(data: Binned, growths: list[Growth], write, block: int) -> list[list[bytes]]:
    """Every growth's trees as ``write`` gives them; a task grows a block of whole trees."""

    def written(batches):
        for batch in batches:
            for g, tree, arrays in zip(*(c.to_pylist() for c in batch.columns)):
                made = [write(columns_of(arrays))]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([tree], pa.int32()), pa.array(made, pa.binary())], names=["model", "tree", "arrays"])

    tasks = spread(data.table.sparkSession, tree_blocks(growths, block), "family int, low int, high int")
    found = grown_in_jvm(data, [[(g, growth)] for g, growth in enumerate(plain(growths))], tasks, _POISSON, NOISE * data.variance)
    trees = [{} for _ in growths]
    for r in found.mapInArrow(written, TREE).collect():
        trees[r["model"]][r["tree"]] = bytes(r["arrays"])
    return [[t[i] for i in sorted(t)] for t in trees]


@dataclass(frozen=True)
class Cut:
    """A setting read out of a grown forest: its first trees, cut at a depth and where few rows remain."""

    trees: int
    max_depth: int | None
    min_split: int


def score_forests(data: Binned, growths: list[Growth], cuts: list[list[Cut]], block: int = 10) -> list[list[float]]:
    """Root mean squared error on the held-out fold, for every growth and each of its cuts."""
    if not data.local:
        return score_by_broadcast(data, growths, cuts, grow_by_levels(data, growths))
    labels, families = data.labels, siblings(plain(growths))

    def errors(rows):
        folds, t = labels.value
        g, depth, split = (rows.column(c)[0].as_py() for c in ("model", "depth", "split"))
        held = t[folds == growths[g].fold]
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("low", "stop", "sums"))))
        whole = {}
        for low, stop, sums in parts:  # the last stop of a block holds all its trees
            whole[low] = np.frombuffer(sums, float)
        out = []
        for n in sorted({c.trees for c in cuts[g] if (c.max_depth or -1, c.min_split) == (depth, split)}):
            before = sum((v for low, v in whole.items() if low + block < n), np.zeros(len(held)))
            last = next(np.frombuffer(sums, float) for low, stop, sums in parts if low < n <= low + block and stop == n)
            out.append((n, float(np.sqrt(np.mean((held - (before + last) / n) ** 2))) if len(held) else float("nan")))
        count = len(out)
        return pa.Table.from_arrays(
            [pa.array([v] * count, pa.int32()) for v in (g, depth, split)] + [pa.array([n for n, _ in out], pa.int32()), pa.array([e for _, e in out], pa.float64())],
            names=["model", "depth", "split", "trees", "rmse"],
        )

    tasks = spread(data.table.sparkSession, tree_blocks([growths[f[0]] for f in families], block), "family int, low int, high int")
    stops = [[(c.trees, c.max_depth or -1, c.min_split) for c in mine] for mine in cuts]
    sums = grown_in_jvm(data, [[(g, growths[g]) for g in f] for f in families], tasks, _POISSON, NOISE * data.variance, stops)
    found = sums.groupBy("model", "depth", "split").applyInArrow(errors, "model int, depth int, split int, trees int, rmse double").collect()
    known = {(r["model"], r["depth"], r["split"], r["trees"]): r["rmse"] for r in found}
    return [[known[g, c.max_depth or -1, c.min_split, c.trees] for c in mine] for g, mine in enumerate(cuts)]


def score_by_broadcast(data: Binned, growths, cuts, forests) -> list[list[float]]:
    """The same errors for grown forests, a growth at a time: its nodes go to the tasks that read its fold."""
    out, mean, channels = [], data.mean, data.channels
    for growth, mine, forest in zip(growths, cuts, forests):

        def work(batches):
            totals, rows = np.zeros(len(mine)), 0
            for batch in batches:
                for part in batches_of(batch, channels):
                    x, t = part[1], part[2] - mean
                    for i, c in enumerate(mine):
                        first = Forest(forest.roots[: c.trees + 1], forest.nodes)
                        totals[i] += ((first.predict(x, c.max_depth, c.min_split).mean(axis=1) - t) ** 2).sum()
                    rows += len(t)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mine)), pa.int32()), pa.array(totals), pa.array([rows] * len(mine))], names=["cut", "error", "rows"])

        held = data.table.filter(F.col("fold") == growth.fold)
        found = held.mapInArrow(work, "cut int, error double, rows long").groupBy("cut").agg(F.sum("error").alias("error"), F.sum("rows").alias("rows")).collect()
        level = {r["cut"]: float(np.sqrt(r["error"] / r["rows"])) if r["rows"] else float("nan") for r in found}
        out.append([level[i] for i in range(len(mine))])
    return out


# --- large tables, level by level


def batches_of(batch, channels: int, rows: int = 4096):
    """(keys, bins, labels, folds, scores) of an Arrow batch in blocks; scores only where the table has them."""
    for low in range(0, len(batch), rows):
        part = batch.slice(low, rows)
        names = part.schema.names
        x = np.frombuffer(b"".join(part.column(names.index("bins")).to_pylist()), np.uint8).reshape(-1, channels)
        scores = None
        if "scores" in names:
            scores = np.frombuffer(b"".join(part.column(names.index("scores")).to_pylist()), float).reshape(len(part), -1)
        yield part.column(names.index("key")).to_numpy(), x, part.column(names.index("label")).to_numpy(), part.column(names.index("fold")).to_numpy(), scores


def route(x: np.ndarray, arrays: dict[str, np.ndarray]) -> np.ndarray:
    """The node of a growing tree that each binned row has reached."""
    at = np.zeros(len(x), np.int64)
    moving = np.flatnonzero(arrays["left"][at] >= 0)
    while len(moving):
        here = at[moving]
        at[moving] = here = arrays["left"][here] + (x[moving, arrays["feature"][here]] > arrays["bin"][here])
        moving = moving[arrays["left"][here] >= 0]
    return at


def best_of_histogram(table: np.ndarray, rule: Rule, allowed):
    """(gain, feature, bin, rows, weight, sum) of the best split; ``table`` is (3, channels, bins) of rows, weights, sums."""
    left = np.cumsum(table, axis=2)
    n, w, s = left[:, :, -1:]
    gain = gains(left[1], left[2], w, s, rule.smoothing)
    valid = (left[0] >= max(1, rule.min_leaf)) & (n - left[0] >= max(1, rule.min_leaf))
    if rule.min_weight:
        valid &= (left[1] >= rule.min_weight) & (w - left[1] >= rule.min_weight)
    if allowed is not None:
        valid &= allowed[:, None]
    gain = np.where(valid, gain, -np.inf)
    f, at = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, at]), f, at, int(left[0, f, at]), float(left[1, f, at]), float(left[2, f, at])


CHANNEL_BLOCK = 16


def histogram_splits(data: Binned, targets, weights, folds: list, builders: dict[int, Builder], wanted: dict[int, list[int]]) -> None:
    """Offer all ``wanted`` nodes their best splits, from one pass for as many nodes as fit a task's histograms.

    ``targets(part of a batch, model)`` and ``weights(keys, model)`` are computed in the tasks. Tasks add up their
    histograms before the shuffle; a reducer has one node and a few channels of all tasks.
    """
    channels, cell = data.channels, 3 * 8 * BINS
    every = [(m, k) for m, nodes in wanted.items() for k in nodes]
    step = max(1, HISTOGRAM_BYTES // (channels * cell))
    for low in range(0, len(every), step):
        some = every[low : low + step]
        slots: dict[int, dict[int, int]] = {}
        for slot, (m, k) in enumerate(some):
            slots.setdefault(m, {})[k] = slot
        trees = {m: {c: a for c, a in builders[m].arrays().items() if c in ("feature", "bin", "left")} for m in slots}

        count = len(some)

        def partial(batches):
            table = np.zeros((3, count * channels * BINS))
            seen = np.zeros(count, bool)
            for batch in batches:
                for part in batches_of(batch, channels):
                    keys, x, _, fold, _ = part
                    for m, nodes in slots.items():
                        w = np.where(fold == (-1 if folds[m] is None else folds[m]), 0.0, weights(keys, m))
                        place = np.full(len(trees[m]["left"]), -1)
                        place[list(nodes)] = list(nodes.values())
                        slot = place[route(x, trees[m])]
                        use = np.flatnonzero((slot >= 0) & (w > 0))
                        if len(use):
                            t = targets(part, m)[use] * w[use]
                            index = ((slot[use, None] * channels + np.arange(channels)) * BINS + x[use]).ravel()
                            for k, values in enumerate((np.ones(len(use)), w[use], t)):
                                table[k] += np.bincount(index, np.repeat(values, channels), table.shape[1])
                            seen[slot[use]] = True
            table = table.reshape(3, count, channels, BINS)
            rows = [(s, b, table[:, s, b : b + CHANNEL_BLOCK].tobytes()) for s in np.flatnonzero(seen).tolist() for b in range(0, channels, CHANNEL_BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                names=["slot", "first", "part"],
            )

        allowed = {m: builders[m].allowed(list(nodes)) for m, nodes in slots.items()}
        masks = {slot: None if allowed[m] is None else allowed[m][i] for m, nodes in slots.items() for i, slot in enumerate(nodes.values())}
        rules = {slot: builders[m].rule for m, nodes in slots.items() for slot in nodes.values()}

        def best(rows):
            slot, first = rows.column("slot")[0].as_py(), rows.column("first")[0].as_py()
            total = sum(np.frombuffer(p, float) for p in rows.column("part").to_pylist()).reshape(3, -1, BINS)
            mask = masks[slot]
            found = best_of_histogram(total, rules[slot], None if mask is None else mask[first : first + CHANNEL_BLOCK])
            values = (slot, found[0], found[1] + first, *found[2:])
            return pa.Table.from_arrays([pa.array([v]) for v in values], names=["slot", "gain", "feature", "at", "rows", "weight", "total"])

        parts = data.table.mapInArrow(partial, "slot int, first int, part binary").groupBy("slot", "first")
        found = parts.applyInArrow(best, "slot long, gain double, feature long, at long, rows long, weight double, total double").collect()
        chosen = {}
        for r in found:
            rank = (-r["gain"], r["feature"])
            if r["slot"] not in chosen or rank < chosen[r["slot"]][0]:
                chosen[r["slot"]] = (rank, r)
        for slot, (_, r) in chosen.items():
            m, k = some[slot]
            builders[m].offer(k, r["gain"], r["feature"], r["at"], r["rows"], r["weight"], r["total"], NOISE * data.variance)


def start_builders(data: Binned, targets, weights, folds: list, rules: list[Rule], keys: list) -> dict[int, Builder]:
    """A builder for each model with the rows, weight and sum of its root, counted in one pass."""
    channels, count = data.channels, len(rules)

    def partial(batches):
        table = np.zeros((3, count))
        for batch in batches:
            for part in batches_of(batch, channels):
                for m in range(count):
                    w = np.where(part[3] == (-1 if folds[m] is None else folds[m]), 0.0, weights(part[0], m))
                    table[:, m] += (w > 0).sum(), w.sum(), (w * targets(part, m)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), *map(pa.array, table)], names=["model", "n", "w", "s"])

    found = data.table.mapInArrow(partial, "model int, n double, w double, s double").groupBy("model").agg(*[F.sum(c).alias(c) for c in "nws"]).collect()
    return {r["model"]: Builder(rules[r["model"]], keys[r["model"]], channels, int(r["n"]), r["w"], r["s"]) for r in found}


def grow_by_levels(data: Binned, growths: list[Growth]) -> list[Forest]:
    """Forests of a table that no task can hold."""
    models = [(g, tree) for g, growth in enumerate(growths) for tree in range(growth.trees)]
    keys = [tree_key(growths[g].seed, tree) for g, tree in models]
    folds, rules = [growths[g].fold for g, _ in models], [growths[g].rule for g, _ in models]
    shares, mean = [None if growths[g].bootstrap else 1.0 for g, _ in models], data.mean
    targets = lambda part, m: part[2] - mean
    weights = lambda row_keys, m: row_weights(row_keys, keys[m], shares[m])
    builders = start_builders(data, targets, weights, folds, rules, keys)
    pending = {m: [] for m in builders}
    while True:
        wanted = {}
        for m, b in builders.items():
            nodes = b.wanted()
            pending[m] += [k for k in nodes if b.columns["rows"][k] <= SMALL]
            wanted[m] = [k for k in nodes if b.columns["rows"][k] > SMALL]
        wanted = {m: nodes for m, nodes in wanted.items() if nodes}
        if not wanted:
            break
        histogram_splits(data, targets, weights, folds, builders, wanted)
        for m in wanted:
            builders[m].advance()
        for m in set(builders) - set(wanted):
            builders[m].frontier = []
    finish_small(data, targets, weights, folds, builders, {m: nodes for m, nodes in pending.items() if nodes})
    return [Forest.of([builders[m].arrays() for m, (mine, _) in enumerate(models) if mine == g]) for g in range(len(growths))]


def finish_small(data: Binned, targets, weights, folds, builders: dict[int, Builder], pending: dict[int, list[int]]) -> None:
    """Grow what is left below small nodes: each node's rows meet in one task."""
    if not pending:
        return
    channels, least = data.channels, NOISE * data.variance
    trees = {m: {c: a for c, a in builders[m].arrays().items() if c in ("feature", "bin", "left")} for m in pending}
    starts = {(m, k): (builders[m].rule, builders[m].keys[k], builders[m].columns["depth"][k], builders[m].keys[0]) for m, nodes in pending.items() for k in nodes}

    def deal(batches):
        for batch in batches:
            for part in batches_of(batch, channels):
                keys, x, _, fold, _ = part
                out = [[] for _ in range(5)]
                for m, nodes in pending.items():
                    w = np.where(fold == (-1 if folds[m] is None else folds[m]), 0.0, weights(keys, m))
                    at, t = np.where(w > 0, route(x, trees[m]), -1), targets(part, m)
                    for k in nodes:
                        rows = np.flatnonzero(at == k)
                        if len(rows):
                            for column, value in zip(out, (m, k, x[rows].tobytes(), t[rows].tobytes(), w[rows].tobytes())):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.binary()) for c in out[2:]]],
                    names=["model", "node", "bins", "target", "weight"],
                )

    def grow(rows):
        m, k = rows.column("model")[0].as_py(), rows.column("node")[0].as_py()
        whole = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        x = whole("bins", np.uint8).reshape(-1, channels)
        rule, key, depth, tree = starts[m, k]
        part = grow_tree(x, whole("target", float), whole("weight", float), rule, key, least, depth, tree)
        return pa.Table.from_arrays([pa.array([m], pa.int32()), pa.array([k], pa.int32()), pa.array([tree_bytes(part)], pa.binary())], names=["model", "tree", "arrays"])

    dealt = data.table.mapInArrow(deal, "model int, node int, bins binary, target binary, weight binary")
    for r in dealt.groupBy("model", "node").applyInArrow(grow, TREE).collect():
        builders[r["model"]].graft(r["tree"], tree_arrays(r["arrays"]))
