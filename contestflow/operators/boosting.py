"""Boosted trees of the second order: splits chosen from sums of gradient and curvature by bin.

A pass over the rows gives, for each node of the growing level, feature and bin, the two sums; they
are added up inside tasks, then between tasks (where these are more than ``FEW``), and what reaches the
driver has at most ``FEW * 2**(depth - 1) * features * bins`` rows whatever the table's size. Sums are of whole numbers
(units of 2**-24), so the trees do not depend on how rows are partitioned or on which task ran twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop, written

#: Gradients are counted in this fraction of one: a sum of 2**39 rows still fits in a long.
UNIT = float(2**24)
#: Rounds after which the rows' margins are written anew, so a pass adds up at most as many trees.
REWRITE = 20
#: Rows of a task, at most, and at least as long as there are cores.
TASK_ROWS, LEAST_ROWS = 250_000, 8192
#: Parts whose sums are added up by the driver; those of more parts are added between tasks first.
FEW = 16
ROWS = "key long, y double, bins array<smallint>, margin double"


@dataclass
class Tree:
    """Nodes in heap order: the children of n are 2n + 1 and 2n + 2; a feature of -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at, rows = np.zeros(len(bins), dtype=int), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]), at)
        return at


def grown(trees: list[Tree], bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.nodes(bins)]
    return margin


def chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def draw(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per key, the same in every run: the finalizer of splitmix64."""
    z = key.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, y, bins, margin = batch.columns
    return key.to_numpy(), y.to_numpy(), bins.flatten().to_numpy().reshape(len(key), -1), margin.to_numpy()


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Per row and feature, how many edges are below the value."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def _bins(column, edges: list[list[float]]):
    @F.pandas_udf("array<smallint>")
    def find(x):
        import pandas as pd

        return pd.Series(list(binned(np.stack(x.to_numpy()), edges).astype(np.int16)) if len(x) else [], dtype=object)

    return find(column)


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble; bin edges and trees are parameters, so it is stored as any model is."""

    edges = Param(Params._dummy(), "edges", "bin edges of each feature")
    trees = Param(Params._dummy(), "trees", "feature, cut and value of each tree's nodes")
    base = Param(Params._dummy(), "base", "log-odds before the first tree")
    gains = Param(Params._dummy(), "gains", "mean gain of each feature's splits, of sum 1")

    @classmethod
    def of(cls, edges: list[list[float]], trees: list[Tree], base: float, gains: np.ndarray) -> BoostedTrees:
        out = cls()
        out._set(edges=edges, trees=[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees], base=base, gains=gains.tolist())
        return out

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 - the name that the library's models have
        return np.array(self.getOrDefault("gains"))

    def forest(self) -> list[Tree]:
        return [Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in self.getOrDefault("trees")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, trees, base = self.getOrDefault("edges"), self.forest(), self.getOrDefault("base")

        @F.pandas_udf("double")
        def probability(x):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(chance(grown(trees, binned(np.stack(x.to_numpy()), edges), np.full(len(x), base))))

        p = probability(vector_to_array("_features"))
        return dataset.withColumn("_p", p).withColumn("_probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))).drop("_p")


@dataclass(frozen=True)
class Boosting:
    """Logistic loss; per round a share of the rows and of the columns, per child a least curvature.

    Whether a round uses a row hangs on ``key`` (or on the row's place in the written table) and
    the seed, so ask for a key if runs over other files must agree. Rows without a target are left
    out; no row at all is a ValueError. With one class alone every tree is a leaf near it.
    """

    rounds: int = 400
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    child_weight: float = 3.0
    ridge: float = 1.0
    bins: int = 64
    key: str | None = None
    seed: int = 42

    def fit(self, train: DataFrame) -> BoostedTrees:
        """Fit on ``_features`` and ``target``; a driver action of at most ``depth`` small jobs a round."""
        x = train.filter("target is not null").select(
            (F.xxhash64(self.key) if self.key else F.monotonically_increasing_id()).alias("key"), F.col("target").cast("double").alias("y"), vector_to_array("_features").alias("x"))
        x = written(x, "boosting")
        first = x.select(F.count("*"), F.avg("y"), F.max(F.size("x"))).first()
        if not first[0]:
            raise ValueError("no rows with a target")
        n, mean, k = first
        at = [j / self.bins for j in range(1, self.bins)]
        found = x.select(*[F.percentile_approx(F.col("x")[j], at, 10_000).alias(f"e{j}") for j in range(k)]).first()
        edges = [sorted(set(e)) for e in found]
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        base = math.log(mean / (1 - mean))
        state = _Rows(x.select("key", "y", _bins("x", edges).alias("bins"), F.lit(base).alias("margin")), n)
        drop(x)
        gain, used, trees = np.zeros(k), np.zeros(k), []
        for r in range(self.rounds):
            picked = np.sort(np.random.default_rng([self.seed, r]).permutation(k)[: max(1, int(self.columns * k))])
            trees.append(self._tree(state, picked, r, gain, used))
            state.add(trees[-1])
        state.close()
        gains = np.divide(gain, used, out=np.zeros(k), where=used > 0)
        return BoostedTrees.of(edges, trees, base, gains / (gains.sum() or 1.0))

    def _tree(self, state: _Rows, picked: np.ndarray, r: int, gain: np.ndarray, used: np.ndarray) -> Tree:
        tree = Tree.empty(self.depth)
        for level in range(self.depth):
            g, h = state.sums(tree, level, picked, self.bins, self.rows, (self.seed << 32) + r)
            whole_g, whole_h = g[:, 0].sum(1), h[:, 0].sum(1)
            if level == 0:
                tree.value[0] = self._leaf(whole_g[0], whole_h[0])
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gr, hr = whole_g[:, None, None] - gl, whole_h[:, None, None] - hl
            better = self._score(gl, hl) + self._score(gr, hr) - self._score(whole_g, whole_h)[:, None, None]
            better = np.where((hl >= self.child_weight) & (hr >= self.child_weight), better, 0.0).reshape(len(g), -1)
            best = better.argmax(1)  # of equal gains the first column and lowest cut
            split = np.flatnonzero(better[np.arange(len(g)), best] > 1e-6)
            for i in split:
                j, cut = divmod(int(best[i]), self.bins - 1)
                node = 2**level - 1 + int(i)
                tree.feature[node], tree.cut[node] = picked[j], cut
                tree.value[2 * node + 1], tree.value[2 * node + 2] = self._leaf(gl[i, j, cut], hl[i, j, cut]), self._leaf(gr[i, j, cut], hr[i, j, cut])
                gain[picked[j]] += better[i, best[i]]
                used[picked[j]] += 1
            if not len(split):
                break
        return tree

    def _score(self, g, h):
        return g * g / (h + self.ridge)

    def _leaf(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.ridge)


class _Rows:
    """The training rows as bins and margins: a written table, kept in memory while it is current."""

    def __init__(self, rows: DataFrame, n: int):
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.parts, self.trees = max(-(-n // TASK_ROWS), min(cores, -(-n // LEAST_ROWS))), []
        self._keep(written(rows.repartition(self.parts), "boosting"))

    def _keep(self, table: DataFrame) -> None:
        self.table, self.rows = table, table.coalesce(self.parts).persist()

    def sums(self, tree: Tree, level: int, picked: np.ndarray, bins: int, share: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the level's nodes, by node, picked column and bin."""
        before, start, shape = self.trees, 2**level - 1, (2**level, len(picked), bins)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, math.prod(shape)), dtype=np.int64)
            for batch in batches:
                key, y, x, margin = _unpack(batch)
                p, node = chance(grown(before, x, margin)), tree.nodes(x) - start
                use = (node >= 0) & (draw(key, salt) < share)
                cell = ((node[use, None] * shape[1] + np.arange(shape[1])) * bins + x[use][:, picked]).ravel()
                for i, what in enumerate((p - y, p * (1 - p))):
                    units = np.repeat(np.rint(what[use] * UNIT), shape[1])
                    total[i] += np.bincount(cell, units, total.shape[1]).astype(np.int64)
            some = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["cell", "g", "h"])

        found = self.rows.mapInArrow(add, "cell long, g long, h long")
        if self.parts > FEW:
            found = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found, total = found.toArrow(), np.zeros((2, math.prod(shape)), dtype=np.int64)
        for i, c in enumerate(("g", "h")):
            np.add.at(total[i], found["cell"].to_numpy(), found[c].to_numpy())
        out = total / UNIT
        return out[0].reshape(shape), out[1].reshape(shape)

    def add(self, tree: Tree) -> None:
        self.trees = [*self.trees, tree]
        if len(self.trees) < REWRITE:
            return
        trees = self.trees

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, x, margin = _unpack(batch)
                yield batch.set_column(3, "margin", pa.array(grown(trees, x, margin)))

        old, kept, self.trees = self.table, self.rows, []
        self._keep(written(kept.mapInArrow(move, ROWS), "boosting"))
        kept.unpersist()
        drop(old)

    def close(self) -> None:
        self.rows.unpersist()
        drop(self.table)
