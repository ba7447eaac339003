"""Exact threshold join of questions with stored vectors by metric pruning.

Angles between unit vectors obey the triangle inequality. Each chunk belongs to a cell: its nearest pivot and a ring of angles about it.
The pivot table holds, for each cell and each pivot, the least and the largest angle of the cell's members. If a question's angle to some pivot
is further from that interval than the angle of the threshold, no member can reach the threshold and the cell is not read. What is read is scored as
in `query_chunk_similarity`, so rows are the same whatever the pivots.

Pivots are picked from a bounded sample, each the farthest from those before; the pivot table is bounded by pivots * pivots * RINGS.
Vectors that are null, zero or of another dimension are in no cell; they have no similarity. An empty table has no cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import SCORE_DECIMALS, _blocks, _unit_rows, dimension, score

PIVOTS, RINGS = 24, 16
SAMPLE = 1 << 13
#: Angles carry rounding of arc cosines near 0 and pi.
SLACK = 1e-6


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles by half chords, which keep small angles exact."""
    return 2 * np.arcsin(np.clip(np.sqrt(np.maximum(((unit[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0)) / 2, 0, 1))


def choose_pivots(chunks: DataFrame, n: int = PIVOTS, sample: int = SAMPLE, dim: int | None = None) -> np.ndarray:
    """Farthest-first from the at most `sample` vectors whose ids hash lowest."""
    usable = chunks.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    dim = dim or dimension(usable.select("embedding"))
    some = usable.where(F.size("embedding") == dim).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").collect()  # `sample` rows
    unit = _unit_rows(np.array([r.embedding for r in some], dtype=np.float64).reshape(len(some), dim))
    picked, far = [], np.full(len(unit), np.inf)
    while len(unit) and len(picked) < n and far.max() > SLACK:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _angles(unit, unit[picked[-1:]])[:, 0])
    return unit[picked]


def assign_cells(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds list_id, the cell, and angles, those to all pivots."""
    dim = pivots.shape[1]
    usable = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
                angle = _angles(_unit_rows(x), pivots)
                own = angle.argmin(axis=1)
                ring = np.minimum((angle[np.arange(len(own)), own] * (2 * RINGS / np.pi)).astype(np.int64), RINGS - 1)
                yield batch.append_column("list_id", pa.array((own * RINGS + ring).astype(np.int32))).append_column(
                    "angles", pa.array(list(angle), pa.list_(pa.float64())))

    return usable.mapInArrow(run, T.StructType([
        *usable.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("angles", T.ArrayType(T.DoubleType()))]))


@dataclass
class PivotTable:
    pivots: np.ndarray
    cells: np.ndarray  # list_id
    sizes: np.ndarray
    low: np.ndarray  # cells x pivots
    high: np.ndarray

    @classmethod
    def of(cls, celled: DataFrame, pivots: np.ndarray) -> PivotTable:
        """From the rows of `assign_cells`: an aggregate per cell."""
        n = len(pivots)
        rows = celled.groupBy("list_id").agg(F.count("*").alias("n"), *(f(F.get("angles", F.lit(k))).alias(f"{a}{k}") for k in range(n) for a, f in (("lo", F.min), ("hi", F.max)))).collect()
        low, high = (np.array([[r[f"{a}{k}"] for k in range(n)] for r in rows]).reshape(len(rows), n) for a in ("lo", "hi"))
        return cls(pivots, np.array([r.list_id for r in rows], np.int64), np.array([r.n for r in rows], np.int64), low, high)

    def met(self, questions: np.ndarray, threshold: float) -> np.ndarray:
        """Questions x cells: where a member can reach the threshold."""
        angle = _angles(questions, self.pivots)[:, None, :]
        reach = np.arccos(np.clip(threshold - 10.0 ** -SCORE_DECIMALS, -1, 1)) + SLACK
        off = np.maximum(np.maximum(angle - self.high[None], self.low[None] - angle), 0).max(axis=2, initial=0)
        return off <= reach


def probes(table: PivotTable, queries: DataFrame, threshold: float, dim: int) -> dict:
    """Cells to read for each question."""
    out = {}
    for block in _blocks(queries, dim):
        unit = _unit_rows(np.array([r.embedding for r in block], dtype=np.float64))
        met = table.met(np.nan_to_num(unit), threshold)
        for r, row in zip(block, met, strict=True):
            out[r.query_id] = set(table.cells[row].tolist())
    return out


def pruned_similarity(stored: DataFrame, table: PivotTable, queries: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """query_id, similarity, chunk_id of all pairs over the threshold. `stored` is partitioned by list_id, so cells out of reach are not read."""
    dim = table.pivots.shape[1]
    dimension(queries, dim)
    return score(stored, queries, threshold, strict, None, probes(table, queries, threshold, dim), dim)
