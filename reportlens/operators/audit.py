"""Report level: figures combined over pages, audit requests and audit answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import (
    AUDIT_FAILED, NO_CANDIDATES, NO_CLAIMS, PARSE_FAILED, RETRIES, audit_struct, fallback_reviews,
    is_valid_audit, parse_audit,
)
from ..functions.text import let
from .extract import no_metrics, first_per_key, metrics_long

REPORT_KINDS = ["scope1", "scope2", "scope3", "generic"]


def report_metric_dedup(page_metrics: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """First figure per (value, page) and kind over a report.

    The key holds the page and a row is a page, so this needs no shuffle however long the report.
    """
    def distinct_values(metrics: Column) -> Column:
        known = F.filter(metrics, lambda m: m["value"].isNotNull() & m["page"].isNotNull())
        return let(known, lambda ms: first_per_key(ms, lambda m: m["value"]))
    return page_metrics.withColumns({k: distinct_values(F.col(k)) for k in kinds or REPORT_KINDS})


def combine_page_metrics(page_metrics: DataFrame) -> DataFrame:
    """All pages' figures of a report as rows in (page, kind, ord) order; lists are never built."""
    return metrics_long(page_metrics, REPORT_KINDS)


def metric_sum(metrics: Column) -> Column:
    return F.aggregate(metrics, F.lit(0.0), lambda s, m: s + F.coalesce(m["value"], F.lit(0.0)))


def scope_totals(page_metrics: DataFrame) -> DataFrame:
    """Sum and count of scope figures per report; each page adds up its own before the shuffle."""
    aggs = []
    for k in ("scope1", "scope2", "scope3"):
        aggs += [F.sum(f"_{k}").alias(f"{k}_total"), F.sum(F.size(k)).cast("int").alias(f"{k}_count")]
    sums = {f"_{k}": metric_sum(F.col(k)) for k in ("scope1", "scope2", "scope3")}
    return page_metrics.withColumns(sums).groupBy("document_id", "company", "year").agg(*aggs)


def metric_counts_by_kind(page_metrics: DataFrame, examples: int = 5) -> DataFrame:
    """Entries per report and kind, with the first few as example rows.

    A page contributes at most `examples` rows per kind to the ranking; counts come from sizes.
    """
    sizes = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.size(k).alias("n")) for k in REPORT_KINDS])
    counts = (
        page_metrics.select("document_id", F.inline(sizes))
        .groupBy("document_id", "kind").agg(F.sum("n").alias("entries")).where("entries > 0")
    )
    short = page_metrics.withColumns({k: F.slice(F.col(k), 1, examples) for k in REPORT_KINDS})
    w = Window.partitionBy("document_id", "kind").orderBy("page", "ord")
    first = (
        metrics_long(short, REPORT_KINDS).withColumn("example", F.row_number().over(w))
        .where(F.col("example") <= examples)
        .select("document_id", "kind", "example", "page", "value", "unit")
    )
    return counts.join(first, ["document_id", "kind"])


def metric_sample(page_metrics: DataFrame, max_samples: int = 50) -> DataFrame:
    """Generic figures per report: all if few, else the first `max_samples div pages` (at least one)
    of each page in page order, `max_samples` at most.

    Every page that counts has a figure, so the first `max_samples` such pages per report always
    hold the result; only those pages, each cut to `max_samples`, are ranked.
    """
    pages = page_metrics.where(F.size("generic") > 0).select(
        "document_id", "page", F.size("generic").alias("_size"),
        F.slice("generic", 1, max_samples).alias("generic"))
    totals = pages.groupBy("document_id").agg(
        F.sum("_size").alias("_entries"), F.count("*").alias("_pages"))
    w = Window.partitionBy("document_id").orderBy("page")
    first = pages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_samples)
    quota = F.when(F.col("_entries") <= max_samples, max_samples).otherwise(
        F.greatest(F.lit(1), F.floor(F.lit(max_samples) / F.col("_pages")))).cast("int")
    taken = first.join(totals, "document_id").select(
        "document_id", "page", F.posexplode(F.slice("generic", F.lit(1), quota)).alias("ord", "_m"))
    rank = Window.partitionBy("document_id").orderBy("page", "ord")
    return (
        taken.withColumn("sample_rank", F.row_number().over(rank))
        .where(F.col("sample_rank") <= max_samples)
        .select("document_id", "sample_rank", "page", "ord", F.col("_m.value").alias("value"),
                F.col("_m.unit").alias("unit"))
    )


def claim_page_metrics(claims: DataFrame, page_metrics: DataFrame) -> DataFrame:
    """Each claim with its page's figures; empty lists where the page is unknown."""
    kinds = ["scope1", "scope2", "generic"]
    side = page_metrics.select("document_id", "page", *kinds)
    return claims.drop(*kinds).join(side, ["document_id", "page"], "left").withColumns(
        {k: F.coalesce(F.col(k), no_metrics()) for k in kinds})


def claims_per_report(selected: DataFrame) -> DataFrame:
    """Selected claims as one ordered array per report; the selection bounds its length."""
    row = F.struct("claim_rank", "keyword_ord", "claim", "page", "target_year", "context", "evidence", "metrics", "score")
    return selected.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("claims"))


def audit_requests(page_metrics: DataFrame, selected: DataFrame, max_samples: int = 50) -> DataFrame:
    """One request per report with claims: figure counts, generic sample and claims.

    Everything in the row is bounded (claims by the selection, figures by the sample); full scope
    lists stay in `combine_page_metrics`, keyed the same way.
    """
    distinct = report_metric_dedup(page_metrics)
    counts = distinct.groupBy("document_id", "company", "year").agg(*[
        F.sum(F.size(k)).cast("int").alias(f"{k}_entries") for k in REPORT_KINDS])
    sample = metric_sample(distinct, max_samples).groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_rank", "page", "value", "unit"))).alias("generic_sample"))
    claims = claims_per_report(selected)
    return (
        counts.join(claims, "document_id").join(sample, "document_id", "left")
        .withColumn("generic_sample", F.coalesce(
            "generic_sample", F.array().cast("array<struct<sample_rank:int,page:int,value:double,unit:string>>")))
        .withColumn("claims_text", F.array_join(F.transform("claims", request_line), "\n"))
    )


def request_line(c: Column) -> Column:
    return F.concat(
        F.lit("Claim "), c["claim_rank"].cast("string"), F.lit(": '"), c["claim"], F.lit("' (Page "),
        c["page"].cast("string"), F.lit(")"),
        F.when(c["target_year"].isNotNull(), F.concat(
            F.lit("\n  Target Year: "), c["target_year"].cast("string"))).otherwise(""))


def request_columns() -> list[Column]:
    return [
        F.to_json("generic_sample").alias("metrics_json"),
        F.to_json(F.transform("claims", lambda c: F.struct(
            c["claim"].alias("claim"), c["page"].alias("page"), c["target_year"].alias("target_year"),
            c["context"].alias("context"), c["evidence"].alias("evidence")))).alias("claims_json")]


def request_json(requests: DataFrame) -> DataFrame:
    """Figures and claims of a request as JSON text."""
    return requests.select("document_id", *request_columns())


def resolve_audits(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """The audit of each report: the answer if valid, else the matching fallback.

    `claims` has one row per report with a (possibly empty) claims array; `responses` at most one.
    """
    joined = claims.join(responses, "document_id", "left").withColumn("_parsed", parse_audit(F.col("raw_text")))
    reviews = fallback_reviews(F.col("claims"))
    no_reviews = F.slice(reviews, 1, 0)

    def failed(reason: Column) -> Column:
        return audit_struct(F.lit(None), F.concat(F.lit(AUDIT_FAILED), reason), reviews)

    status = (
        F.when(F.size("claims") == 0, "no_claims")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("raw_text").isNull(), "missing")
        .when(F.col("_parsed").isNull(), "unparsed")
        .when(is_valid_audit(F.col("_parsed")), "valid").otherwise("invalid")
    )
    s = F.col("audit_status")
    audit = (
        F.when(s == "valid", F.col("_parsed"))
        .when(s == "no_claims", audit_struct(F.lit(None), F.lit(NO_CLAIMS), no_reviews))
        .when(s == "error", failed(F.concat(F.lit("API error: "), F.col("error"))))
        .when(s == "missing", failed(F.lit(NO_CANDIDATES)))
        .when(s == "unparsed", audit_struct(F.lit(None), F.lit(PARSE_FAILED), no_reviews))
        .otherwise(failed(F.lit(RETRIES)))
    )
    return joined.withColumn("audit_status", status).select("document_id", "claims", "audit_status", audit.alias("audit"))


def review_for(reviews: Column, claim: Column, page: Column) -> Column:
    """First review of this claim on this page, or null."""
    return F.get(F.filter(reviews, lambda r: (r["claim"] == claim) & (r["page"] == page)), F.lit(0))


def claim_review_join(selected: DataFrame, audits: DataFrame) -> DataFrame:
    """Each selected claim with its review; both sides are bounded per report by the selection."""
    side = audits.select("document_id", F.col("audit.claim_reviews").alias("_reviews"))
    return selected.join(side, "document_id", "left").withColumn(
        "review", review_for(F.col("_reviews"), F.col("claim"), F.col("page"))).drop("_reviews")


def build_reports(page_metrics: DataFrame, selected: DataFrame, responses: DataFrame,
                  processed_at: Column, source: str = "Sustainability Report") -> DataFrame:
    """The report table: totals, selected claims and audit, one row per document."""
    totals = scope_totals(report_metric_dedup(page_metrics))
    return report_rows(totals.join(claims_per_report(selected), "document_id", "left"), responses, processed_at, source)


def report_rows(with_claims: DataFrame, responses: DataFrame, processed_at: Column, source: str = "Sustainability Report") -> DataFrame:
    """Report rows from totals that carry their selected claims."""
    empty = F.array().cast(with_claims.schema["claims"].dataType)
    with_claims = with_claims.withColumn("claims", F.coalesce("claims", empty))
    audits = resolve_audits(with_claims.select("document_id", "claims"), responses)
    return (
        with_claims.drop("claims").join(audits, "document_id")
        .select(
            "document_id", "company", "year", F.lit(source).alias("source"),
            F.col("audit.overall_score").alias("leaf_rating"), F.col("audit.overall_score").alias("truth_score"),
            F.coalesce("audit.overall_summary", F.lit("")).alias("ai_summary"),
            "claims", F.col("audit.claim_reviews").alias("claim_reviews"), "audit_status",
            "scope1_total", "scope2_total", "scope3_total",
            "scope1_count", "scope2_count", "scope3_count",
            F.size("claims").alias("claims_analyzed_count"), processed_at.alias("processed_at"))
    )
