"""Trees of a random forest, each grown by one task over the binned table.

The rules are those of Spark's forest: at most ``bins`` bins for a feature, of equal
frequency where it has more values; Poisson(1) weights; a new subset of features for
each node; gini gain; sibling leaves of the same class merged; the mean of the leaves'
shares is the forest's. Spark's passes over all rows for each group of nodes go: a
task reads the bins (2 bytes for each value) once, keeps its rows in the order of their
nodes and finds all splits of a level with one sort for each feature of the subsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import _RandomForestClassifierParams
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import staged

#: Rows of a block of bins, and bins that two bytes number; the last number marks leaves.
BLOCK_ROWS, MOST_BINS = 1 << 16, (1 << 16) - 1
#: Values of the table (rows times features) up to which it is grown by a task for each tree, at about 5 bytes each.
TASK_VALUES = 40_000_000


def _gathered(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Tables of ``most`` rows, the last one smaller; none is empty."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between all values if they fit ``bins``, else those nearest to equal frequency."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    stride = target = counts.sum() / bins
    below, kept = np.cumsum(counts).tolist(), []
    for k in range(1, len(values)):
        if abs(below[k - 1] - target) < abs(below[k] - target):
            kept.append(k - 1)
            target += stride
    return middle[kept]


def thresholds(df: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Thresholds of each input, from all rows; at most ``bins - 1`` each."""

    def counted(batches):
        for table in _gathered(batches):
            for at, name in enumerate(inputs):
                values, counts = np.unique(table[name].to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), at, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))], ["at", "value", "n"])

    def cut(table):
        order = np.argsort(values := table["value"].to_numpy())
        found = _thresholds(values[order], table["n"].to_numpy()[order], bins)
        return pa.table({"at": table["at"][:1], "edges": pa.array([found], pa.list_(pa.float64()))})

    counts = df.select(*(f"`{c}`" for c in inputs)).mapInArrow(counted, "at int, value double, n long").groupBy("at", "value").agg(F.sum("n").alias("n"))
    found = {r["at"]: np.array(r["edges"], float) for r in counts.groupBy("at").applyInArrow(cut, "at int, edges array<double>").collect()}
    return [found.get(at, np.empty(0)) for at in range(len(inputs))]


def blocks(df: DataFrame, inputs: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(n, bins, rest): blocks of rows, their bins row by row, and their other columns as an Arrow stream."""

    def packed(batches):
        for table in _gathered(batches):
            bins = np.empty((table.num_rows, len(inputs)), np.uint16)
            for at, name in enumerate(inputs):
                bins[:, at] = np.searchsorted(edges[at], table[name].to_numpy())
            rest = table.drop_columns(inputs).combine_chunks()
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rest.schema) as stream:
                stream.write_table(rest)
            yield pa.RecordBatch.from_arrays([pa.array([len(bins)], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n", "bins", "rest"])

    return df.mapInArrow(packed, "n int, bins binary, rest binary")


def _best(x: np.ndarray, node: np.ndarray, code: np.ndarray, n: np.ndarray, p: np.ndarray, subsets: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each node: its feature (-1: none gains) and cut, and what goes left of ``n`` and ``p``.

    A key is a row's node, its bin and its code (weight and label); sorted keys give each
    node's rows in the order of their bins, and running sums of both at the end of each bin.
    """
    found = {"feature": np.full(len(n), -1, np.int16), "cut": np.full(len(n), MOST_BINS, np.uint16), "n": np.zeros(len(n)), "p": np.zeros(len(n))}
    score = p * p / n * (1 + 1e-13)
    before_n, before_p = np.cumsum(n) - n, np.cumsum(p) - p
    low, high = int(code.max()).bit_length(), int(x.max()).bit_length()
    wide = np.uint32 if low + high + len(n).bit_length() <= 32 else np.int64
    base = node.astype(wide) << wide(low + high) | code.astype(wide)
    codes = np.arange(1 << low)
    sums = codes >> 1 << 32 | (codes >> 1) * (codes & 1)  # both sums in one number
    place, flat = np.arange(len(x)) * x.shape[1], x.reshape(-1)
    for chosen in subsets:
        at = chosen.take(node)
        at += place
        key = flat.take(at).astype(wide)
        key <<= wide(low)
        key |= base
        key.sort()
        run = key >> wide(low)
        ends = np.flatnonzero(run[1:] != run[:-1])
        at = run[ends] >> wide(high)
        inside = at == run[ends + 1] >> wide(high)
        ends, at = ends[inside], at[inside].astype(np.int64)
        if not len(ends):
            continue
        key &= wide((1 << low) - 1)
        both = np.cumsum(sums.take(key))[ends]
        left_n, left_p = (both >> 32) - before_n[at], (both & 0xFFFFFFFF) - before_p[at]
        scores = left_p * left_p / left_n + (p[at] - left_p) ** 2 / (n[at] - left_n)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        most = np.maximum.reduceat(scores, starts)
        hits = np.flatnonzero(scores == np.repeat(most, np.diff(np.r_[starts, len(at)])))
        first = hits[np.r_[True, at[hits][1:] != at[hits][:-1]]]
        own = at[starts]
        better = most > score[own]
        own, first = own[better], first[better]
        score[own], found["feature"][own], found["n"][own], found["p"][own] = most[better], chosen[own], left_n[first], left_p[first]
        found["cut"][own] = run[ends[first]] & wide((1 << high) - 1)
    return found


def grow(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, depth: int, subset: int, random: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree: feature (-1: a leaf), cut (greater bins go right), left (the right child follows it), share of label 1.

    Weights are whole and at most 127; each node tries ``subset`` features.
    """
    rows, features = np.flatnonzero(weights), bins.shape[1]
    x, code, node = bins[rows], weights[rows] << 1 | labels[rows], np.zeros(len(rows), np.int64)
    n = np.array([float(weights.sum())])
    p = np.array([float(weights[labels == 1].sum())])
    levels = []
    for level in range(depth + 1):
        tree = {"feature": np.full(len(n), -1, np.int16), "cut": np.full(len(n), MOST_BINS, np.uint16), "left": np.zeros(len(n), np.int32), "n": n, "p": p}
        levels.append(tree)
        active = np.flatnonzero((p > 0) & (p < n))  # the rows' nodes are numbered by their place in it
        if level == depth or not len(active) or not features:
            break
        subsets = np.argpartition(random.random((len(active), features), np.float32), subset - 1, axis=1)[:, :subset].T if subset < features else np.repeat(np.arange(features)[:, None], len(active), axis=1)
        found = _best(x, node, code, n[active], p[active], np.ascontiguousarray(subsets))
        parents = np.flatnonzero(found["feature"] >= 0)
        if not len(parents):
            break
        at = active[parents]
        tree["feature"][at], tree["cut"][at], tree["left"][at] = found["feature"][parents], found["cut"][parents], 2 * np.arange(len(parents))
        n, p = (np.stack([found[k][parents], total[at] - found[k][parents]], axis=1).reshape(-1) for k, total in (("n", n), ("p", p)))
        mixed = (p > 0) & (p < n)
        following = np.full(2 * len(found["n"]), -1, np.int64)
        following[(2 * parents[:, None] + [0, 1]).reshape(-1)] = np.where(mixed, np.cumsum(mixed) - 1, -1)
        right = x.reshape(-1).take(np.arange(len(x)) * features + np.maximum(found["feature"], 0).astype(np.int64).take(node)) > found["cut"].take(node)
        node = following.take(2 * node + right)
        going = np.flatnonzero(node >= 0)
        if len(going) < len(node):
            x, code, node = x[going], code[going], node[going]
    return _compact(levels)


def _compact(levels: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One numbering for all levels, sibling leaves of the same class merged first."""
    for above, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        split = np.flatnonzero(above["feature"] >= 0)
        left = above["left"][split]
        leaf, one = below["feature"] < 0, 2 * below["p"] > below["n"]
        same = leaf[left] & leaf[left + 1] & (one[left] == one[left + 1])
        above["feature"][split[same]], above["cut"][split[same]] = -1, MOST_BINS
    out, kept, start = {"feature": [], "cut": [], "left": [], "share": []}, np.array([0]), 0
    for tree in levels:
        inner = tree["feature"][kept] >= 0
        left = np.arange(start, start + len(kept))  # a leaf's own number: no row leaves it
        left[inner] = start + len(kept) + 2 * np.arange(inner.sum())
        out["feature"].append(tree["feature"][kept])
        out["cut"].append(tree["cut"][kept])
        out["left"].append(left.astype(np.int32))
        out["share"].append(tree["p"][kept] / tree["n"][kept])
        start += len(kept)
        children = tree["left"][kept[inner]]
        kept = np.stack([children, children + 1], axis=1).reshape(-1)
    return {k: np.concatenate(v) for k, v in out.items()} | {"root": np.zeros(1, np.int32)}


def shares(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The share of label 1 in each row's leaf, summed over the trees that begin at ``root``."""
    inner = tree["feature"] >= 0
    entry = np.where(inner, tree["left"].astype(np.int64) << 32 | tree["feature"].astype(np.int64) << 16 | tree["cut"], -1)
    flat, every, out = bins.reshape(-1), np.arange(len(bins)), np.zeros(len(bins))
    for root in tree["root"]:
        rows, place, node = every, every * bins.shape[1], np.full(len(bins), root, np.int64)
        while len(rows):
            own = entry.take(node)
            if own.min() < 0:
                leaf = own < 0
                out[rows[leaf]] += tree["share"][node[leaf]]
                rows, place, own = rows[~leaf], place[~leaf], own[~leaf]
            node = (own >> 32) + (flat.take(place + (own >> 16 & 0xFFFF)) > (own & 0xFFFF))
    return out


def _joined(trees: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Several trees under one numbering."""
    starts = np.cumsum([0, *(len(t["left"]) for t in trees)])
    out = {k: np.concatenate([t[k] for t in trees]) for k in ("feature", "cut", "share")}
    for k in ("left", "root"):
        out[k] = np.concatenate([t[k] + start for t, start in zip(trees, starts, strict=False)]).astype(np.int32)
    return out


_TREE = {"feature": np.int16, "cut": np.uint16, "left": np.int32, "share": np.float64, "root": np.int32}


class GrownForest(Model, _RandomForestClassifierParams):
    """Trees as a staged table, several in a row, and the thresholds of their inputs."""

    def __init__(self, trees: DataFrame, inputs: list[str], edges: list[np.ndarray], **params: int) -> None:
        super().__init__()
        self.trees, self.inputs, self.edges = trees, inputs, edges
        self._set(**params)

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as Spark's model has it
        return self.getOrDefault("numTrees")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` without the inputs, with probability (of labels 0 and 1) and prediction."""
        features, trees, fields = len(self.inputs), self.getNumTrees, list(_TREE.items())

        def voted(batches):
            votes, seen = None, 0
            for batch in batches:
                for n, bins, rest, *tree in zip(*(batch[c] for c in ("n", "bins", "rest", *_TREE)), strict=True):
                    x = np.frombuffer(bins.as_buffer(), np.uint16).reshape(n.as_py(), features)
                    group = {name: np.frombuffer(value.as_buffer(), kind) for (name, kind), value in zip(fields, tree, strict=True)}
                    own = shares(group, x)
                    votes, seen = own if votes is None else votes + own, seen + len(group["root"])
                    if seen == trees:
                        table = pa.ipc.open_stream(rest.as_buffer()).read_all()
                        one = votes / trees
                        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(one) + 1, 2, dtype=np.int32)), pa.array(np.stack([1 - one, one], axis=1).reshape(-1)))
                        yield from table.append_column("probability", pairs).append_column("prediction", pa.array((2 * votes > trees).astype(float))).combine_chunks().to_batches()
                        votes, seen = None, 0

        kept = StructType([f for f in dataset.schema.fields if f.name not in self.inputs])
        out = StructType([*kept.fields, StructField("probability", ArrayType(DoubleType())), StructField("prediction", DoubleType())])
        paired = blocks(dataset, self.inputs, self.edges).crossJoin(self.trees.coalesce(1).hint("shuffle_replicate_nl"))
        return paired.mapInArrow(voted, out)


def grown(train: DataFrame, inputs: list[str], *, trees: int, depth: int, bins: int, seed: int) -> GrownForest:
    """A forest for a table of finite doubles ``inputs`` and a label of 0.0 or 1.0; it has a row at least."""
    spark: SparkSession = train.sparkSession
    edges = thresholds(train, inputs, bins)
    table = staged(blocks(train.select("label", *(f"`{c}`" for c in inputs)), inputs, edges))
    rows, features = table.agg(F.sum("n")).first()[0], len(inputs)

    groups = min(trees, 3 * spark.sparkContext.defaultParallelism)  # a task reads the table once for all its trees

    def some_trees(batches):
        group, x, y, at = None, np.empty((rows, features), np.uint16), np.empty(rows, np.uint8), 0
        for batch in batches:
            for number, n, bins, rest in zip(*(batch[c] for c in ("group", "n", "bins", "rest")), strict=True):
                group, part = number.as_py(), slice(at, at + n.as_py())
                x[part] = np.frombuffer(bins.as_buffer(), np.uint16).reshape(-1, features)
                y[part] = pa.ipc.open_stream(rest.as_buffer()).read_all()["label"].to_numpy()
                at = part.stop
            del batch, bins, rest  # else the last ones stay while trees grow
        if group is not None:
            if at != rows:
                raise ValueError(f"{at} rows of {rows}")
            pa.default_memory_pool().release_unused()
            found = []
            for tree in range(group, trees, groups):
                random = np.random.default_rng([seed, tree])
                weights = np.minimum(random.poisson(1.0, rows), 127).astype(np.uint8)
                found.append(grow(x, y, weights if weights.any() else np.ones_like(weights), depth, math.ceil(math.sqrt(features)), random))
            found = _joined(found)
            yield pa.RecordBatch.from_arrays([pa.array([found[name].tobytes()], pa.binary()) for name in _TREE], list(_TREE))

    fitted = spark.range(0, groups, 1, groups).withColumnRenamed("id", "group").crossJoin(table.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(some_trees, ", ".join(f"{name} binary" for name in _TREE))
    return GrownForest(staged(fitted), inputs, edges, numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed)
