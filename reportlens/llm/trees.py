"""Quality rules as gradient-boosted trees over document statistics.

Trees of bounded depth are grown on histograms, with monotonic constraints on chosen features: a document never scores
better for more repeated lines, repeated windows or symbols. The trees are flattened into node arrays that numpy walks
for all rows of a batch at once.

Defined cases: null and empty texts have no words, so the base rule fails them; a null id is treated like any other; repeated
rows are judged each; very long texts are measured whole; of splits of equal gain the first feature and place win, and a value equal to a split goes left;
other columns are not read, whatever their names; an empty table gives no rows; without labelled rows the verdict of the trees is to keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlens.llm.docstats import COUNTS, FEATURES, measured, training_rows

TRAINING_ROWS = 20_000
#: Sign of the effect on the score.
MONOTONE = {"dup_lines": -1, "repeats": -1, "symbols": -1}


@dataclass
class Forest:
    """Nodes of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z, row = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            z += self.value[node]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, depth: int = 3, bins: int = 48, rate: float = 0.15, least: float = 2.0, reg: float = 1.0) -> Forest:
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    bias = 0.0
    if len(y):
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
        z = np.full(len(y), bias)

    def leaf(v: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        """low, high: what the values below may be, so that constrained splits above stay in order."""
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(gs / (hs + reg), low, high))
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                bf = b[rows, f]
                gl = np.cumsum(np.bincount(bf, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bf, h[rows], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(gl / (hl + reg), low, high), np.clip(gr / (hr + reg), low, high)
                gain = gl * vl - 0.5 * (hl + reg) * vl**2 + gr * vr - 0.5 * (hr + reg) * vr**2 - (gs * own - 0.5 * (hs + reg) * own**2)
                gain[(hl < least / 4) | (hr < least / 4) | (signs[f] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return leaf(own * rate)
        me = leaf(0.0)
        goes_left = b[rows, f] <= k
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
        nodes[me][:2] = [f, float(edges[f][k])]
        nodes[me][2] = grow(rows[goes_left], g, h, level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
        own = Forest(*_arrays(nodes), np.array(roots[-1:]), depth, 0.0)
        s = np.clip(own.score(x), 1e-12, 1 - 1e-12)
        z += np.log(s / (1 - s))
    return Forest(*_arrays(nodes), np.array(roots, np.int64), depth, bias)


def _arrays(nodes: list[list]) -> list[np.ndarray]:
    columns = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    return [np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> Forest:
    return fit(*training_rows(docs, labels, label, bound), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdicts(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the score of every row."""
    out = measured(docs, {**dict.fromkeys(COUNTS, "long"), "score": "double"}, lambda c, x: [*(pa.array(v) for v in c.T), pa.array(forest.score(x))])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).select(
        "doc_id", *COUNTS, "base_failed", "kept", "score")
