"""Stage tables over the derived pages: what one stage writes and the next reads.

Relational reads go to a stored report table. It is written once per session and data folder,
under the shared checkpoint folder, by the same operators that build it anywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.audit import build_reports
from ..operators.claims import best_claims, claim_metrics_choice, detect_claims, score_claims, top_claims
from ..operators.extract import page_metrics
from ..operators.search import vector_topk
from ..session import materialize
from ..sources.derived import SOURCES, audit_responses, derived, judgements, page_parts, report_pages, table

TIMES = "to_timestamp(concat(year, '-06-01 00:00:00'))"
THRESHOLD = 0.05
#: Pages of a report that one task ranks.
RUN = 64
_stored: dict[tuple, DataFrame] = {}
_schemas: dict[tuple, StructType] = {}


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their figures."""
    return page_metrics(report_pages(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims with figures attached."""
    return claim_metrics_choice(detect_claims(figures(spark, sf_dir)))


def selected(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The claims picked for the audit: one per base keyword and page, best `n` per report."""
    distinct = claim_metrics_choice(detect_claims(figures(spark, sf_dir), distinct_base=True))
    return top_claims(score_claims(distinct), n)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored output of the extraction stage."""
    return stored(spark, sf_dir, "extracted", lambda: make_extracted(spark, sf_dir))


def make_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(spark, sf_dir).select(
        "document_id", "company", "year", "page", "text", "scope1", "scope2", "scope3", "total", "generic")


def extracted_schema(spark: SparkSession, sf_dir: str) -> StructType:
    """Columns of the extraction stage, from its plan alone: nothing is computed or stored."""
    return planned(spark, sf_dir, "extracted", lambda: make_extracted(spark, sf_dir))


def reports_schema(spark: SparkSession, sf_dir: str) -> StructType:
    """Columns of the report table, from its plan alone."""
    return planned(spark, sf_dir, "reports", lambda: make_reports(
        spark, sf_dir, spark.createDataFrame([], extracted_schema(spark, sf_dir))))


def planned(spark: SparkSession, sf_dir: str, name: str, make) -> StructType:
    """The schema of a plan; kept, since analysing these takes seconds."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _written(spark, sf_dir))
    if key not in _schemas:
        _schemas[key] = make().schema
    return _schemas[key]


def select_from(pages: DataFrame, n: int = 20) -> DataFrame:
    return best_claims(pages, n)


def neighbours(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages dealt out in runs of one report, so that few of its claims leave a task and a report of very many pages is still shared out."""
    return pages.repartition(page_parts(spark, sf_dir), "document_id", F.floor(F.col("page") / RUN))


def make_reports(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """The report table of extracted pages, by default the stored ones."""
    pages = extracted(spark, sf_dir) if pages is None else pages
    return build_reports(pages, select_from(neighbours(spark, sf_dir, pages)), audit_responses(spark, sf_dir), F.expr(TIMES))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored report table, by year."""
    return stored(spark, sf_dir, "reports", lambda: make_reports(spark, sf_dir), "year")


def stored(spark: SparkSession, sf_dir: str, name: str, make, *partitions: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, _written(spark, sf_dir))
    if key not in _stored:
        _stored[key] = materialize(make(), name, *partitions)
    return _stored[key]


def _written(spark: SparkSession, sf_dir: str) -> tuple:
    """When the given tables were written: a folder that is rewritten within a session is another one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = [hadoop(f"{sf_dir.rstrip('/')}/{s}.parquet") for s in SOURCES]
    return tuple(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in at)


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "vector_chunks")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "search_queries")


def hits(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD, k: int = 5) -> DataFrame:
    return vector_topk(vector_chunks(spark, sf_dir), search_queries(spark, sf_dir), threshold, k)


__all__ = ["figures", "claims", "selected", "extracted", "reports", "vector_chunks", "search_queries", "hits", "judgements", "table"]
