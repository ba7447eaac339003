"""Nearest neighbours by a block matrix join of int8 product tiles.

1. Rows with equal vectors are one class; of its ids only the smallest k + 1 can be among anybody's nearest k, so a vector that
   is stored a million times is compared once.
2. Queries and classes are dealt into blocks of about `BLOCK_BYTES`; each pair of blocks is one tile, a group of bounded size.
3. A tile codes unit vectors in int8 and multiplies codes. Products of codes are whole numbers that single precision holds
   exactly, so the only error of scale * scale * product against the cosine is quantisation: at most |code of q| * err(c) + err(q),
   where err is the length of what rounding took from the vector. A candidate whose upper bound is below the k-th best lower bound cannot be a result.
4. Surviving pairs are recomputed in double precision on the original vectors and kept in one heap of k per query.
5. The tiles' heaps meet in a ranking whose limit stands in front of the shuffle: k rows per query and tile.

Nothing is left out: the result equals exact search. Work is that of all queries times all classes in any case; the bounds save the recomputation.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries take no part, nor do rows with a null id; vectors of different
dimension are not compared; ties go to the smaller id; rows that repeat an id are rows of their own: a query's repeats
are candidates like any other, and a repeated query row is answered as often. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlens.session import materialize

#: Bytes of vectors in a block in single precision; cells of a product, its queries, and pairs recomputed at once.
BLOCK_BYTES, CELLS, ROWS, STEP = 16 << 20, 1 << 20, 256, 1 << 14
#: Fewest vectors of a block, where there are more tasks than full blocks.
LEAST = 1024
#: Slack of a bound: single-precision rounding of scales and lengths, far above it.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the lengths of what coding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(unit - scale[:, None] * code, axis=1)


def in_turn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scalar products of rows, added up from the first entry on, so that any plain loop gives the same bits."""
    return np.ascontiguousarray((x * y).T).sum(axis=0)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled by a power of two to keep squares in range, their lengths, and unit vectors."""
    x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1))))[:, None]
    length = np.sqrt(in_turn(x, x))
    return x, length, x / length[:, None]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of codes: 1,000 terms of at most 127 * 127 fit the 24 bits of a float."""
    out = np.zeros((len(q), len(c)), np.float32)
    for k in range(0, q.shape[1], 1000):
        out += q[:, k: k + 1000].astype(np.float32) @ c[:, k: k + 1000].astype(np.float32).T
    return out


@dataclass
class Side:
    """Vectors of one side of a tile, and their codes."""

    x: np.ndarray
    length: np.ndarray
    code: np.ndarray
    scale: np.ndarray
    lost: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Side:
        x, length, unit = unit_rows(vectors)
        return cls(x, length, *codes(unit))


def tile(vectors: np.ndarray, asks: list[int], stored: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[list[tuple[float, int]]], int]:
    """Per query its heap of (score, -id), at most k, and how many pairs were recomputed. `ids` are those of each stored vector."""
    q, c = Side.of(vectors), Side.of(stored)
    place = {v.tobytes(): n for n, v in enumerate(stored)}
    own = [place.get(v.tobytes(), -1) for v in vectors]
    heaps: list[list[tuple[float, int]]] = [[] for _ in asks]
    edge = np.full(len(asks), -np.inf, np.float32)
    exact, wide = 0, CELLS // ROWS
    for a in range(0, len(asks), ROWS):
        rows = slice(a, a + ROWS)
        high = np.float32(1 + q.lost[rows].max())  # no scaled code is longer
        for b in range(0, len(ids), wide):
            cols = slice(b, b + wide)
            about = products(q.code[rows], c.code[cols]) * q.scale[rows, None].astype(np.float32) * c.scale[None, cols].astype(np.float32)
            off, slack = high * c.lost[cols].astype(np.float32), q.lost[rows].astype(np.float32) + np.float32(SLACK)
            if b == 0 and about.shape[1] > k:  # k vectors besides the query's own; later the heaps give the edge
                edge[rows] = np.partition(about - off, -k - 1, axis=1)[:, -k - 1] - slack
            about += off
            i, j = np.nonzero(about >= (edge[rows] - slack)[:, None])
            i, j = i + a, j + b
            exact += len(i)
            for s in range(0, len(i), STEP):
                x, y = i[s: s + STEP], j[s: s + STEP]
                score = in_turn(q.x[x], c.x[y]) / (q.length[x] * c.length[y])
                for r, col, v in zip(x.tolist(), y.tolist(), score.tolist(), strict=True):
                    heap, them = heaps[r], ids[col]
                    if len(heap) == k and v < heap[0][0]:
                        continue
                    if col == own[r] and asks[r] in them:  # the row itself, once
                        them = them.copy()
                        them.remove(asks[r])
                    for n in them:
                        if len(heap) < k:
                            heapq.heappush(heap, (v, -n))
                        elif (v, -n) > heap[0]:
                            heapq.heapreplace(heap, (v, -n))
            for r in range(a, min(a + ROWS, len(asks))):
                if len(heaps[r]) == k:
                    edge[r] = max(edge[r], np.float32(heaps[r][0][0] - SLACK))
    return heaps, exact


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """h, embedding and the k + 1 smallest ids of each distinct vector."""
    same = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = vectors.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= k + 1)
    return few.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, query: Column, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that satisfies `query` its k nearest others. `vectors` has vec_id and embedding."""
    kind = "double" if "array<float>" not in dict(vectors.dtypes)["embedding"] else "float"
    of = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), query.alias("asks"))
    of = of.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    of = of.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))  # -0.0
    h = F.xxhash64("embedding")
    of = of.withColumn("h", h)
    stored = materialize(classes(of.drop("asks"), k), "nearest-classes")
    # A query row that repeats with the same vector is searched once.
    asked = materialize(of.where("asks").groupBy("vec_id", "h", "embedding").agg(F.count("*").alias("times")), "nearest-queries")
    dims = stored.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    fit, tasks = max(LEAST, block_bytes // (4 * (dims["d"] or 1))), vectors.sparkSession.sparkContext.defaultParallelism
    across = max(1, math.ceil(asked.count() / fit))
    down = max(1, math.ceil(dims["n"] / fit), min(tasks, dims["n"] // LEAST))
    n = F.size("embedding").alias("d")
    left = asked.select(n, F.pmod(F.xxhash64("vec_id", "h"), F.lit(across)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"), "vec_id", "h", "embedding")
    right = stored.select(n, F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), F.pmod("h", F.lit(down)).cast("int").alias("j"), "h", "embedding", "ids")

    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if queries.num_rows and cands.num_rows:
            asks, hs = queries.column("vec_id").to_pylist(), queries.column("h").to_pylist()
            heaps, _ = tile(_matrix(queries.column("embedding")), asks, _matrix(cands.column("embedding")), cands.column("ids").to_pylist(), k)
            for ask, own, heap in zip(asks, hs, heaps, strict=True):
                for score, least in heap:
                    for column, v in zip(out, (ask, own, -least, score), strict=True):
                        column.append(v)
        return pa.table([pa.array(v, pa.float64() if n == 3 else pa.int64()) for n, v in enumerate(out)], ["query_id", "h", "vec_id", "score"])

    hits = left.groupBy("d", "i", "j").cogroup(right.groupBy("d", "i", "j")).applyInArrow(run, "query_id long, h long, vec_id long, score double")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    often = asked.where("times > 1").select(F.col("vec_id").alias("query_id"), "h", "times")
    return best.join(often, ["query_id", "h"], "left").withColumn("turn", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).astype(np.float64).reshape(len(column), -1)
