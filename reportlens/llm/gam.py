"""Quality as a generalised additive model with pairwise interactions.

Each feature is cut into bins of equal counts. Cyclic boosting fits shallow trees to one feature at a time and adds them to the
feature's lookup table; then pairs of features that explain what is left get tables of two dimensions. A score is the logistic of a sum of table entries.

Fitted on a bounded, documented number of labelled rows on the driver; scoring is a pass over the whole table.
Defined cases: null and empty texts are scored like any other (all statistics 0); a null id is scored and never held out;
repeated rows are scored each; very long texts are measured whole; statistics equal to a cut go to the lower bin, and of cuts or pairs of equal gain
the first wins; other columns pass through `accepted`, whatever their names, and are not read; an empty table gives no rows; without
labelled rows every score is 0.5. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlens.llm.arrays import pieces
from reportlens.llm.docstats import FEATURES, held_out, measure, measured, training_rows

#: Labelled rows used at most.
TRAINING_ROWS = 20_000


@dataclass
class Gam:
    edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            z += table[b[:, k]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, least: float, reg: float) -> tuple[int, float]:
    """The best cut of a histogram along its only axis, and its gain; 0 if there is none."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (0, 0.0)


def _shallow(g: np.ndarray, h: np.ndarray, least: float, reg: float) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    cuts = [0, len(g)]
    for _ in range(2):
        found = [(gain, a + k) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for k, gain in [_cut(g[a:b], h[a:b], least, reg)] if k]
        if not found:
            break
        cuts = sorted([*cuts, max(found)[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float, reg: float) -> tuple[np.ndarray, float]:
    """A tree of depth two over both axes of a grid, and what it gains over none."""
    best, value = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        k, _ = _cut(gg.sum(1), hh.sum(1), least, reg)
        for cut in {k, gg.shape[0] // 2} - {0}:
            out, gain = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gp, hp = gg[part].sum(0), hh[part].sum(0)
                j, _ = _cut(gp, hp, least, reg)
                for side in (slice(0, j), slice(j, None)):
                    if hp[side].sum() > 0:
                        v = gp[side].sum() / (hp[side].sum() + reg)
                        out[part, side] = v
                        gain += v * gp[side].sum()
            if gain > best:
                best, value = gain, out if axis == 0 else out.T
    return value, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8, rate: float = 0.1, least: float = 4.0, reg: float = 1.0) -> Gam:
    """Cyclic boosting of the logistic loss; single features first, then pairs on what they leave."""
    if not len(y):
        return Gam([np.zeros(0)] * x.shape[1], 0.0, [np.zeros(1)] * x.shape[1])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Gam(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    b, z = model.bins(x), np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), least / 4, reg)
            table += step
            z += step[b[:, k]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        wide = len(model.tables[j])
        return np.bincount(b[:, i] * wide + b[:, j], values, len(model.tables[i]) * wide).reshape(-1, wide)

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), least / 4, reg)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(rounds // 5):
        for (i, j), table in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), least / 4, reg)[0]
            table += step
            z += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> Gam:
    return fit(*training_rows(docs, labels, label, bound))


def scores(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    assert len(model.tables) == len(FEATURES)
    scored = measured(docs, {"score": "double"}, lambda _, x: [pa.array(model.score(x))])
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose score is `least` or more. Only texts and scores pass through Python."""
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(measure(w)[1]) for _, _, w in pieces(texts, fold=None)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(F.arrow_udf(score, "double")(docs["text"].cast("string")) >= least)
