"""Totals and best claims of each document as keyed state, so that a page is read once however late its document's other pages come.

Per document the state holds six numbers and at most `n` claims as JSON with their rank keys: its size does not grow with the document. Evidence is
not kept; it is read off the contexts of the claims that a document comes out with. A batch
emits one row for each document that it touches. State lives in RocksDB on the executors with its changes in the query's
checkpoint, so a lost executor's documents are restored elsewhere, and a replayed batch starts from the state before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import evidence, evidence_signals, let, with_known
from ..operators.audit import metric_sum, report_metric_dedup
from ..operators.claims import chosen_metrics, page_claims, score_with_metrics

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCOPES = ("scope1", "scope2", "scope3")
TOTALS = "scope1_total double, scope2_total double, scope3_total double, scope1_count int, scope2_count int, scope3_count int"
NAMES = [c.split()[0] for c in TOTALS.split(", ")]
KEPT = ("keyword_ord", "claim", "page", "context", "metrics", "score")
CLAIM = ("keyword_ord", "claim", "page", "target_year", "context", "evidence", "metrics", "score")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside use RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def rank_key(score: Column, page: Column, keyword_ord: Column) -> Column:
    """One number that rises from the best claim to the least: high score, early page (none first), early keyword."""
    place = F.coalesce(page.cast("long") + F.lit((1 << 31) + 1), F.lit(0))
    return ((F.lit(1023) - score).cast("long") * F.lit(1 << 33) + place) * F.lit(1 << 12) + keyword_ord


def scored_claims(x: Column) -> Column:
    """A claim of the row's page as its rank key and JSON, without what the context alone gives again."""
    claim, context = x["hit"]["claim"], x["at"]["context"]

    def packed(m: Column) -> Column:
        return let(score_with_metrics(claim, x["at"]["evidence"], context, m), lambda score: F.struct(
            rank_key(score, F.col("page"), x["hit"]["keyword_ord"]).alias("rank"),
            F.to_json(kept(x["hit"]["keyword_ord"], claim, F.col("page"), context, m, score), {"ignoreNullFields": "false"}).alias("claim")))
    return let(chosen_metrics(claim), packed)


def kept(*values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip(KEPT, values, strict=True)))


def parts(extracted: DataFrame) -> DataFrame:
    """What a page adds to its document, in one row: sums, and its claims with their rank keys. Narrow, so it works on a stream."""
    found = extracted.withColumn("_claims", F.transform(page_claims(evidence_signals, distinct_base=True), scored_claims))
    return report_metric_dedup(found, [*SCOPES]).select(
        "document_id", "company", "year", *(metric_sum(F.col(k)).alias(f"{k}_total") for k in SCOPES), *(F.size(k).alias(f"{k}_count") for k in SCOPES),
        F.col("_claims.rank").alias("ranks"), F.col("_claims.claim").alias("claims"))


class DocumentState(StatefulProcessor):
    """Adds up a document's parts. All that is kept is one value, so a document costs one read and one write of state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", f"{TOTALS}, ranks array<bigint>, claims array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = self.document.get()
        *totals, ranks, claims = [0.0, 0.0, 0.0, 0, 0, 0, [], []] if before is None else before
        best = [*zip(ranks, claims, strict=True)]
        for row in rows:
            totals = [x + row[f] for x, f in zip(totals, NAMES, strict=True)]
            best = heapq.nsmallest(self.n, [*best, *zip(row["ranks"], row["claims"], strict=True)])
        claims = [c for _, c in best]
        self.document.update((*totals, [r for r, _ in best], claims))
        yield Row(document_id=key[0], company=key[1], year=key[2], **dict(zip(NAMES, totals, strict=True)), claims=claims)


def document_states(extracted: DataFrame, n: int = 20) -> DataFrame:
    """A stream of extracted pages -> totals and ranked claims of the documents that a batch touches."""
    claim = extracted.select(F.explode(page_claims(evidence_signals)).alias("x"), "*").select(kept(
        F.col("x.hit.keyword_ord"), F.col("x.hit.claim"), F.col("page"), F.col("x.at.context"), chosen_metrics(F.col("x.hit.claim")), F.lit(0)).alias("c"))
    states = parts(extracted).groupBy("document_id", "company", "year").transformWithState(
        DocumentState(n), f"document_id string, company string, year int, {TOTALS}, claims array<string>", "Update", "None")
    parsed = states.withColumn("claims", F.transform("claims", lambda c: F.from_json(c, claim.schema["c"].dataType.simpleString())))

    def whole(x: Column, found: Column) -> Column:
        given = {**{k: x[k] for k in KEPT}, "evidence": found, "target_year": found["target_year"]}
        return F.struct(*(given[k].alias(k) for k in CLAIM))
    read = with_known(F.col("claims"), lambda c: c["context"], evidence, whole)
    ranked = let(read, lambda cs: F.transform(cs, lambda c, i: F.struct((i + 1).cast("int").alias("claim_rank"), *(c[k].alias(k) for k in CLAIM))))
    return parsed.withColumn("claims", ranked)
