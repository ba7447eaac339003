"""Retrieval quality: hits against judged pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.3, 0.4, 0.5, 0.6)


def pages_hit(hits: DataFrame, judgements: DataFrame) -> DataFrame:
    """Each hit of a judged question with `hit`: is its page among the expected ones?"""
    judged = judgements.where(F.size("expected_pages") > 0)
    return hits.join(judged, "query_id").withColumn("hit", F.array_contains("expected_pages", F.col("page")))


def _scores(k: int) -> list[Column]:
    top = F.col("rank") <= k
    return [
        F.count("rank").cast("int").alias("num_results"),
        F.coalesce(F.try_divide(F.count_if(top & F.col("hit")), F.count_if(top)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(top & F.col("hit")), F.first(F.size("expected_pages"))), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
    ]


def pr_at_k_mrr(hits: DataFrame, judgements: DataFrame, k: int = 5, distinct_pages: bool = False,
                by: tuple[str, ...] = ()) -> DataFrame:
    """Precision and recall at `k` and reciprocal rank per judged question.

    Repeated pages count each time, which can lift recall over 1; `distinct_pages` keeps the best
    place of each page. `by` adds grouping columns that both inputs carry (a threshold grid).
    """
    keys = [*by, "query_id"]
    if distinct_pages:
        best = hits.groupBy(*keys, "page").agg(F.min("rank").alias("rank"))
        hits = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    judged = judgements.where(F.size("expected_pages") > 0)
    joined = judged.join(hits.select(*keys, "rank", "page"), keys, "left").withColumn(
        "hit", F.coalesce(F.array_contains("expected_pages", F.col("page")), F.lit(False)))
    return joined.groupBy(*keys, "category").agg(*_scores(k))


def _means() -> list[Column]:
    return [
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"),
        F.avg("num_results").alias("avg_results"),
    ]


def eval_overall(scores: DataFrame) -> DataFrame:
    return scores.agg(*_means())


def eval_by_category(scores: DataFrame) -> DataFrame:
    return scores.groupBy("category").agg(F.count("*").alias("queries"), *_means())


def threshold_grid(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Every row once per threshold; the grid is a short literal, so nothing is joined."""
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))


def eval_threshold_sweep(hits: DataFrame, judgements: DataFrame, k: int = 5,
                         thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Mean scores per threshold from one search at the lowest one.

    The best `k` over a higher threshold are those of the lower one that pass it, in the same order.
    """
    passing = threshold_grid(hits, thresholds).where(F.col("similarity") > F.col("threshold"))
    scores = pr_at_k_mrr(passing, threshold_grid(judgements, thresholds), k, by=("threshold",))
    return scores.groupBy("threshold").agg(*_means())


def eval_diversity(hits: DataFrame, judgements: DataFrame) -> DataFrame:
    """Number of companies among the hits of each question without expected pages."""
    open_ = judgements.where(F.coalesce(F.size("expected_pages"), F.lit(0)) <= 0).select("query_id", "category")
    return open_.join(hits.select("query_id", "rank", "company"), "query_id", "left").groupBy("query_id", "category").agg(
        F.count("rank").cast("int").alias("num_results"), F.count_distinct("company").alias("companies_found"))
