"""Approximate search over product-quantised vectors, with exact scores for the few that are returned.

A unit vector is cut into `parts` pieces; each piece is stored as the number of its nearest of 256 centres, one byte. A question
makes a table of its products with all centres, so the score of a stored vector is a sum of `parts` table entries and no vector is read.
The best `rerank` chunks of each question by that score are looked up and scored exactly.

The codebook is fitted on at most `sample` vectors, those whose ids hash lowest, on the driver; all vectors are coded. With 64 dimensions and 28 parts
codes are 11 % of the bytes of the vectors. Recall grows with `parts` and `rerank` (README has measured figures).

Vectors that are null, zero or of another dimension have no code and are no hits; ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_similarity
from .search import DEFAULT_K, DEFAULT_THRESHOLD, SCORE_DECIMALS, _blocks, _Scorer, _unit_rows, dimension, rank_hits, similarity_threshold, with_content

CENTRES = 256
SAMPLE = 1 << 14
PARTS = 28


@dataclass
class Codebook:
    """Centres of each piece; pieces are runs of dimensions whose lengths differ by one at most."""

    dim: int
    centres: list[np.ndarray]

    def pieces(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.dim), len(self.centres))

    def encode(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), len(self.centres)), np.uint8)
        for k, (at, c) in enumerate(zip(self.pieces(), self.centres, strict=True)):
            out[:, k] = _nearest(unit[:, at], c)
        return out

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """Parts x centres x questions."""
        out = np.zeros((len(self.centres), CENTRES, len(questions)), np.float32)
        for k, (at, c) in enumerate(zip(self.pieces(), self.centres, strict=True)):
            out[k, : len(c)] = c @ questions[:, at].T
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _cluster(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = np.unique(x, axis=0)
    centres = centres[np.sort(rng.permutation(len(centres))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(own, x[:, j], len(centres))
            centres[n > 0, j] = total[n > 0] / n[n > 0]
    return centres


def fit_codebook(chunks: DataFrame, parts: int = PARTS, sample: int = SAMPLE, rounds: int = 10, seed: int = 7, dim: int | None = None) -> Codebook:
    """Centres of each piece by Lloyd's rounds on a bounded sample."""
    usable = chunks.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    dim = dim or dimension(usable.select("embedding"))
    some = usable.where(F.size("embedding") == dim).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").collect()  # `sample` rows
    unit = _unit_rows(np.array([r.embedding for r in some], dtype=np.float64).reshape(len(some), dim))
    rng = np.random.default_rng(seed)
    return Codebook(dim, [_cluster(unit[:, at], CENTRES, rounds, rng) if len(some) else np.zeros((1, len(at))) for at in np.array_split(np.arange(dim), min(parts, dim))])


def encode(chunks: DataFrame, book: Codebook) -> DataFrame:
    """The code table: chunk_id, company, year, code. Written once and kept beside the vectors."""
    keep = [c for c in ("chunk_id", "company", "year") if c in chunks.columns]
    usable = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == book.dim) & F.exists("embedding", lambda x: x != 0)).select(*keep, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, book.dim).astype(np.float64)
            code = book.encode(_unit_rows(x))
            yield batch.select(keep).append_column("code", pa.array([c.tobytes() for c in code], pa.binary()))

    return usable.mapInArrow(run, T.StructType([*(usable.schema[c] for c in keep), T.StructField("code", T.BinaryType())]))


class _TableScorer(_Scorer):
    """Scores codes by table entries."""

    def __init__(self, block: list, book: Codebook, k: int):
        super().__init__(block, book.dim, -np.inf, False, k, None)
        self.tables = book.tables(np.nan_to_num(self.matrix))

    def similarities(self, batch: pa.RecordBatch) -> np.ndarray:
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(self.tables))
        return sum(table[code[:, k]] for k, table in enumerate(self.tables)).T.astype(np.float64)


def approximate(codes: DataFrame, queries: DataFrame, book: Codebook, rerank: int) -> DataFrame:
    """query_id, similarity (by table), chunk_id: the best `rerank` codes of each question that pass its filters."""
    out = T.StructType([queries.schema["query_id"], T.StructField("similarity", T.DoubleType()), codes.schema["chunk_id"]])
    dimension(queries, book.dim)

    def one_pass(block: list) -> DataFrame:
        scorer = _TableScorer(block, book, rerank)
        filters = [c for c in ("company", "year") if any(getattr(r, c) is not None for r in block)]
        return codes.select("chunk_id", *filters, "code").mapInArrow(lambda it: scorer(it), out)

    passes = [one_pass(block) for block in _blocks(queries, book.dim)]
    hits = reduce(DataFrame.unionByName, passes) if passes else codes.sparkSession.createDataFrame([], out)
    return rank_hits(hits, rerank)


def vector_topk_quantised(chunks: DataFrame, codes: DataFrame, book: Codebook, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                          k: int = DEFAULT_K, rerank: int = 20, strict: bool = True) -> DataFrame:
    """Best `k` chunks per question among the `rerank` best by code, with exact similarities over the threshold."""
    few = approximate(codes, queries, book, rerank).select("query_id", "chunk_id")
    met = few.join(chunks.select("chunk_id", F.col("embedding").alias("_vector")), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("_asked")), "query_id")
    exact = met.select("query_id", F.round(cosine_similarity(F.col("_asked"), F.col("_vector")), SCORE_DECIMALS).alias("similarity"), "chunk_id")
    return with_content(rank_hits(exact.where(similarity_threshold(F.col("similarity"), threshold, strict)), k), chunks)
