"""Cosine search of many questions over stored vectors.

The vectors stay where they are: a block of questions of bounded size goes to every task, which
scores Arrow batches with one matrix product and keeps its best hits per question. Only ids and
vectors are scored; company, year, page and text are joined to the few winners. More questions than fit a block take
further passes, which are parts of one lazy plan, so there is no limit on their number and no join of questions with chunks.

Vectors have a stated dimension. Questions of another one are refused before anything runs; chunks of another one
are no hits of any question and are returned by `other_dimension`, to be sent to the error table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import NOTHING_FOUND
from ..functions.vectors import cosine_similarity, unit

BLOCK_BYTES = 16 << 20
MATRIX_CELLS = 2 << 20
#: Candidates that a task holds before it keeps the best of each question.
PENDING = 1 << 18
DEFAULT_THRESHOLD = 0.4
DEFAULT_K = 5
# Scores are ordered at this many decimals: the last bits depend on how a product is blocked.
SCORE_DECIMALS = 12


def company_filter(company: Column, wanted: Column | str | None) -> Column:
    """Case-insensitive "contains"; no filter keeps all. Wildcards have no meaning."""
    if wanted is None:
        return F.lit(True)
    w = F.lit(wanted) if isinstance(wanted, str) else wanted
    return w.isNull() | F.contains(F.lower(company), F.lower(w))


def year_filter(year: Column, wanted: int | None) -> Column:
    """Plain equality, so a table partitioned by year is pruned."""
    return F.lit(True) if wanted is None else year == F.lit(wanted)


def similarity_threshold(similarity: Column, threshold: float = DEFAULT_THRESHOLD, strict: bool = True) -> Column:
    return similarity > threshold if strict else similarity >= threshold


def other_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks whose vector is there but not of `dim` numbers, in the shape of the error table's input."""
    size = F.size("embedding")
    return chunks.where(F.col("embedding").isNotNull() & (size != dim)).withColumn(
        "error", F.concat(F.lit("vector of "), size.cast("string"), F.lit(f" dimensions instead of {dim}")))


def dimension(queries: DataFrame, dim: int | None = None) -> int:
    """The stated dimension, or the one that all questions share; a question of another one is an error before anything runs."""
    found = {r.n for r in queries.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).distinct().take(3)}
    if len(found | ({dim} - {None})) > 1:
        raise ValueError(f"questions have vectors of {sorted(found)} dimensions" + (f" instead of {dim}" if dim else ""))
    return dim or next(iter(found), 0)


def _blocks(queries: DataFrame, dim: int) -> Iterator[list]:
    """Questions in lists of at most `BLOCK_BYTES` of vector data."""
    rows = queries.where(F.col("embedding").isNotNull()).select(
        "query_id", "embedding", "company", "year").toLocalIterator(prefetchPartitions=False)
    while block := list(islice(rows, max(1, BLOCK_BYTES // (8 * max(1, dim))))):
        yield block


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; nan for a row of zeros, which is similar to nothing."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, np.nan, length)


class _Scorer:
    """Scores Arrow batches of (chunk_id, company, year, list_id, embedding) against one block of questions."""

    def __init__(self, block: list, dim: int, threshold: float, strict: bool, k: int | None, probes: np.ndarray | None):
        self.ids = np.array([r.query_id for r in block])
        self.dim, self.threshold, self.strict, self.k, self.probes = dim, threshold, strict, k, probes
        self.matrix = _unit_rows(np.array([r.embedding for r in block], dtype=np.float64))
        self.companies = [None if r.company is None else r.company.lower() for r in block]
        self.years = [r.year for r in block]

    def similarities(self, batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        return np.round(self.matrix @ _unit_rows(flat.reshape(batch.num_rows, self.dim).astype(np.float64)).T, SCORE_DECIMALS)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        sims = self.similarities(batch)
        ok = sims > self.threshold if self.strict else sims >= self.threshold
        wanted = sorted(set(self.companies) - {None})
        if wanted:
            names = pc.utf8_lower(batch.column("company"))
            masks = {c: pc.fill_null(pc.match_substring(names, c), False).to_numpy(zero_copy_only=False) for c in wanted}
            ok &= np.stack([np.ones(batch.num_rows, bool) if c is None else masks[c] for c in self.companies])
        if any(y is not None for y in self.years):
            years = batch.column("year").to_numpy(zero_copy_only=False)
            ok &= np.stack([np.ones(batch.num_rows, bool) if y is None else years == y for y in self.years])
        if self.probes is not None:
            ok &= self.probes[:, batch.column("list_id").to_numpy(zero_copy_only=False)]
        return np.where(ok, sims, -np.inf)

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices whose score matrix stays within `MATRIX_CELLS`, however many questions there are."""
        step = max(1, MATRIX_CELLS // len(self.ids))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    def best(self, held: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The best k of each question among what is held: similarity descending, then chunk_id."""
        q, sim = (np.concatenate([h[j] for h in held]) for j in (0, 1))
        ids = pa.concat_arrays([h[2] for h in held])
        rank = np.empty(len(ids), np.int64)
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort([rank, -sim, q])
        q, sim = q[order], sim[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        return q[keep], sim[keep], ids.take(pa.array(order[keep]))

    def emit(self, q: np.ndarray, sim: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(sim), ids], ["query_id", "similarity", "chunk_id"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        # The score a row must reach to matter for a question; most are passed over once it is known.
        floor = np.full(len(self.ids), np.finfo(np.float64).min)
        for piece in self.pieces(batches):
            sims = self.scores(piece)
            q, row = np.nonzero(sims >= floor[:, None])
            if not len(q):
                continue
            found = (q, sims[q, row], piece.column("chunk_id").take(pa.array(row)))
            if self.k is None:
                yield self.emit(*found)
                continue
            held.append(found)
            size += len(q)
            if size > PENDING:
                held = [self.best(held)]
                size = len(held[0][0])
                full = np.flatnonzero(np.bincount(held[0][0], minlength=len(self.ids)) == self.k)
                floor[full] = held[0][1][np.searchsorted(held[0][0], full, side="right") - 1]
        if held:
            yield self.emit(*self.best(held))


def score(chunks: DataFrame, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD, strict: bool = True,
          k: int | None = DEFAULT_K, probes: dict | None = None, dim: int | None = None) -> DataFrame:
    """Hits per task: `query_id, similarity, chunk_id`.

    With `k`, each task emits at most `k` rows per question; without, every row over the threshold.
    """
    out = T.StructType([queries.schema["query_id"], T.StructField("similarity", T.DoubleType()), chunks.schema["chunk_id"]])
    dim = dimension(queries, dim)
    lists = [] if probes is None else ["list_id"]
    right = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))

    def one_pass(block: list) -> DataFrame:
        usable, mask = right, None
        if all(r.year is not None for r in block):
            usable = usable.where(F.col("year").isin(sorted({r.year for r in block})))
        if probes is not None:
            near = [probes[r.query_id] for r in block]
            usable = usable.where(F.col("list_id").isin(sorted(set().union(*near))))
            mask = np.zeros((len(block), max(set().union(*near), default=0) + 1), bool)
            for i, n in enumerate(near):
                mask[i, sorted(n)] = True
        scorer = _Scorer(block, dim, threshold, strict, k, mask)
        filters = [c for c in ("company", "year") if any(getattr(r, c) is not None for r in block)]
        return usable.select("chunk_id", *filters, *lists, "embedding").mapInArrow(lambda it: scorer(it), out)

    passes = [one_pass(block) for block in _blocks(queries, dim)]
    return reduce(DataFrame.unionByName, passes) if passes else chunks.sparkSession.createDataFrame([], out)


def with_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document, company, year, page and text of the hits, looked up by chunk_id."""
    rest = [c for c in ("document_id", "company", "year", "page", "content") if c in chunks.columns]
    return hits.join(chunks.select("chunk_id", *rest), "chunk_id")


def rank_hits(hits: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Best `k` hits per question over all tasks; adds `rank`."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_chunk_similarity(chunks: DataFrame, queries: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """(question, chunk) pairs that pass the filters and the threshold; the threshold is what bounds them."""
    return score(chunks, queries, threshold, strict, k=None)


def vector_topk(chunks: DataFrame, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                k: int = DEFAULT_K, strict: bool = True) -> DataFrame:
    """Best `k` chunks per question by cosine over the threshold, with company and year filters."""
    return with_content(rank_hits(score(chunks, queries, threshold, strict, k), k), chunks)


def vector_topk_capped(chunks: DataFrame, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                       k: int = DEFAULT_K, candidates: int = 100) -> DataFrame:
    """Fallback search: the first `candidates` eligible chunks per question (the cap is its meaning, and counts chunks without
    a vector too), `>=` threshold, best `k`.

    The distinct filters of the questions are few and become one array in the plan; one scan finds the first candidates of each, limited before
    the shuffle, and questions meet them on their filter.
    """
    filters = sorted({(r.company, r.year) for r in queries.select("company", "year").distinct().toLocalIterator()}, key=str)
    if not filters:
        return with_content(rank_hits(score(chunks, queries, threshold, k=k), k), chunks)
    eligible = F.array(*(F.when(company_filter(F.col("company"), c) & year_filter(F.col("year"), y), F.lit(i)) for i, (c, y) in enumerate(filters)))
    met = chunks.select("chunk_id", F.col("embedding").alias("_vector"), F.explode(F.array_compact(eligible)).alias("_filter"))
    order = Window.partitionBy("_filter").orderBy("chunk_id")
    first = met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= candidates)
    number = F.lit(None).cast("int")
    for i, (c, y) in enumerate(filters):
        number = F.when(F.col("company").eqNullSafe(F.lit(c)) & F.col("year").eqNullSafe(F.lit(y)), F.lit(i)).otherwise(number)
    asked = queries.select("query_id", F.col("embedding").alias("_asked"), number.alias("_filter"))
    similarity = F.round(cosine_similarity(F.col("_asked"), F.col("_vector")), SCORE_DECIMALS)
    hits = first.join(asked, "_filter").where(F.size("_asked") == F.size("_vector")).withColumn("similarity", similarity).where(
        similarity_threshold(F.col("similarity"), threshold, strict=False)).select("query_id", "similarity", "chunk_id")
    return with_content(rank_hits(hits, k), chunks)


# ---------------------------------------------------------------- inverted lists


def build_lists(chunks: DataFrame, lists: int = 100, seed: int = 7, sample: int = 1 << 17) -> tuple[DataFrame, np.ndarray]:
    """Assign every chunk to its nearest of `lists` centres; returns (chunks with `list_id`, centres).

    Centres are found by k-means over the at most `sample` vectors whose ids hash lowest.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = chunks.where(F.col("embedding").isNotNull()).withColumn(
        "_features", array_to_vector(unit(F.col("embedding")).cast("array<double>")))
    model = KMeans(k=lists, seed=seed, featuresCol="_features", predictionCol="list_id", maxIter=10).fit(
        ready.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("_features"))
    return model.transform(ready).drop("_features"), np.array(model.clusterCenters())


def label_centres(chunks: DataFrame, label: str = "label") -> np.ndarray:
    """One centre per label, in label order: the mean of its unit vectors. For collections that are sorted by topic already."""
    means = chunks.where(F.col("embedding").isNotNull()).select(label, F.posexplode(unit(F.col("embedding"))).alias("at", "x")).groupBy(label, "at").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy(label)
    return np.array([[p.x for p in r.v] for r in rows.toLocalIterator()])  # a row per label


def assign_lists(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds `list_id`, the most similar of given centres (the first of equals)."""
    near, dim = _unit_rows(centres), centres.shape[1]
    right = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
            sims = np.nan_to_num(np.round(_unit_rows(x) @ near.T, SCORE_DECIMALS))
            yield batch.append_column("list_id", pa.array(sims.argmax(axis=1).astype(np.int32)))

    return right.mapInArrow(run, T.StructType([*right.schema.fields, T.StructField("list_id", T.IntegerType())]))


def write_lists(indexed: DataFrame, path: str) -> None:
    """Store by list; the rebalance hint lets AQE split a list that holds a large share of all rows."""
    indexed.hint("rebalance", F.col("list_id")).write.partitionBy("list_id").parquet(path)


def vector_topk_ivf(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, nprobe: int = 10,
                    threshold: float = DEFAULT_THRESHOLD, k: int = DEFAULT_K) -> DataFrame:
    """Approximate search: each question reads only its `nprobe` most similar lists (partition pruning)."""
    near, probes, dim = _unit_rows(centres), {}, dimension(queries, centres.shape[1])
    for block in _blocks(queries, dim):
        sims = np.nan_to_num(np.round(_unit_rows(np.array([r.embedding for r in block], dtype=np.float64)) @ near.T, SCORE_DECIMALS))
        for r, row in zip(block, np.argsort(-sims, axis=1, kind="stable")[:, :nprobe], strict=True):
            probes[r.query_id] = set(row.tolist())
    return with_content(rank_hits(score(indexed, queries, threshold, True, k, probes, dim), k), indexed)


# ---------------------------------------------------------------- context and response


def source_block() -> Column:
    return F.concat(
        F.lit("[Source: "), F.col("company"), F.lit(" "), F.col("year").cast("string"), F.lit(" Report, Page "),
        F.col("page").cast("string"), F.lit("]\n"), F.col("content"))


def rag_context(hits: DataFrame) -> DataFrame:
    """The hits of each question as one text in rank order; at most k blocks per question."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", source_block().alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def search_response(queries: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Question, answer, citations, confidence and number of sources; questions without hits get a fixed text.

    `answers` holds parsed model answers by `query_id`; without it the hits are the citations.
    """
    cited = hits.groupBy("query_id").agg(
        F.count("*").cast("int").alias("num_sources"),
        F.array_sort(F.collect_list(F.struct("rank", "company", "year", "page"))).alias("_cited"))
    out = queries.select("query_id", "question").join(cited, "query_id", "left")
    none = F.col("num_sources").isNull()
    hit_citations = F.transform("_cited", lambda c: F.struct(
        c["company"].alias("company"), c["year"].alias("year"), c["page"].alias("page")))
    answer, confidence = F.lit(""), F.lit("unknown")
    if answers is not None:
        out = out.join(answers, "query_id", "left")
        answer, confidence = F.coalesce("answer", F.lit("")), F.coalesce("confidence", F.lit("unknown"))
    empty = F.array().cast("array<struct<company:string,year:int,page:int>>")
    return out.select(
        "query_id", "question", F.when(none, NOTHING_FOUND).otherwise(answer).alias("answer"),
        F.coalesce(hit_citations, empty).alias("citations"),
        F.when(none, "none").otherwise(confidence).alias("confidence"),
        F.coalesce("num_sources", F.lit(0)).alias("num_sources"))
