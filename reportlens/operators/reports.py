"""Relational reads over the report table and statistics over stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE_METRICS = ("leaf_rating", "scope1_total", "scope2_total")


def list_reports(reports: DataFrame) -> DataFrame:
    return reports.select("company", "year", "leaf_rating", "scope1_total", "scope2_total")


def latest_report(reports: DataFrame, year: int | None = None) -> DataFrame:
    """Newest report per company, or the one of a given year; the rank is limited before the shuffle."""
    if year is not None:
        return reports.where(F.col("year") == year)
    w = Window.partitionBy("company").orderBy(F.desc("year"), F.desc("processed_at"), "document_id")
    return reports.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def company_history(reports: DataFrame, company: str | None = None) -> DataFrame:
    """Reports by company and year with the number of years; the count is a partial aggregate, not a window."""
    rows = reports if company is None else reports.where(F.col("company") == company)
    covered = rows.groupBy("company").agg(F.count("*").cast("int").alias("years_covered"))
    return (
        rows.select("company", "year", "leaf_rating", "scope1_total", "scope2_total", "ai_summary")
        .join(covered, "company").orderBy("company", "year")
    )


def requested_companies(requests: DataFrame) -> DataFrame:
    """`request_id, pos, company` for each comma-separated list; order and repeats kept."""
    return requests.select("request_id", F.posexplode(F.split("companies", ",")).alias("pos", "company")).withColumn(
        "company", F.trim("company"))


def company_in_list(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """Reports of the requested companies, one row per place in the list; unknown names drop out."""
    return requested_companies(requests).join(reports, "company")


def compare_companies(reports: DataFrame, requests: DataFrame, metric: str = "leaf_rating") -> DataFrame:
    """Latest report of each requested company ranked by a metric, missing as 0, ties in request order."""
    if metric not in COMPARE_METRICS:
        raise ValueError(f"metric must be one of {COMPARE_METRICS}")
    latest = latest_report(reports.select("company", "year", metric, "processed_at", "document_id"))
    w = Window.partitionBy("request_id").orderBy(F.desc(F.coalesce(F.col(metric), F.lit(0.0))), "pos")
    return company_in_list(latest, requests).withColumn("place", F.row_number().over(w)).select(
        "request_id", "place", "company", "year", metric)


def flatten_claims(reports: DataFrame) -> DataFrame:
    """All claims of all reports with company and year."""
    return reports.select("company", "year", F.inline("claims"))


def status_lookup(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    done = reports.select(F.col("document_id").alias("id"), F.lit(True).alias("_done"))
    return uploads.join(done, "id", "left").select(
        F.col("id").alias("document_id"), F.when(F.col("_done"), "completed").otherwise("processing").alias("status"))


def stage_backlog(uploads: DataFrame, extracted: DataFrame, audited: DataFrame, chunked: DataFrame) -> DataFrame:
    """Documents waiting for each stage: present in the stage before, absent from its own output.

    One aggregate over flags per document replaces three anti joins.
    """
    def seen(df: DataFrame, flag: str, key: str = "document_id") -> DataFrame:
        return df.select(F.col(key).alias("document_id"), F.lit(flag).alias("stage"))
    rows = (
        seen(uploads, "uploaded", "id").unionByName(seen(extracted, "extracted"))
        .unionByName(seen(audited, "audited")).unionByName(seen(chunked, "chunked"))
    )
    def has(s: str) -> Column:
        return F.bool_or(F.col("stage") == s)
    flags = rows.groupBy("document_id").agg(
        has("uploaded").alias("u"), has("extracted").alias("e"), has("audited").alias("a"), has("chunked").alias("c"))
    counts = flags.agg(
        F.count_if(F.col("u") & ~F.col("e")).alias("pdf_queue"),
        F.count_if(F.col("e") & ~F.col("a")).alias("audit_queue"),
        F.count_if(F.col("a") & ~F.col("c")).alias("embeddings_queue"))
    return counts


def system_stats(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Number of reports, chunks and companies, and chunks per report, in one aggregate."""
    rows = reports.select("company", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        chunks.select(F.lit(None).cast("string").alias("company"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    # Companies are reduced to one row each before the count, with partial sums.
    per = rows.groupBy("company").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return per.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("total_reports"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_chunks"),
        F.count("company").alias("unique_companies"),
    ).withColumn("avg_chunks_per_report", F.coalesce(
        F.try_divide(F.col("total_chunks"), F.col("total_reports")), F.lit(0.0)))


def distinct_sketches(rows: DataFrame, column: str, *keys: str, lg: int = 14) -> DataFrame:
    """One sketch of the distinct values per key (a year, a month), to be stored; sketches of new rows are added as rows, none is recomputed."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(lg)).alias("sketch"))


def merged_distinct(sketches: DataFrame, key: str) -> DataFrame:
    """Estimates by `key` and over all (null), from stored sketches alone. The standard error is 1.04 / sqrt(2^lg): 0.8 % with the default."""
    return sketches.cube(F.col(key).alias(f"of_{key}")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def _stat_rows(page_metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """Pages and claims as rows of one additive shape, so that a single shuffle serves both."""
    keys = ["document_id", "company", "year"]
    zero = F.lit(0)
    failed = F.col("text").isNull().cast("int") if "text" in page_metrics.columns else zero
    pages = page_metrics.select(
        *keys, F.lit(1).alias("pages"), failed.alias("text_failures"),
        F.size("scope1").alias("scope1"), F.size("scope2").alias("scope2"), F.size("scope3").alias("scope3"),
        zero.alias("claims"), zero.alias("with_context"), zero.alias("with_evidence"), zero.alias("good_context"))
    length, e = F.length(F.coalesce("context", F.lit(""))), F.col("evidence")
    found = claims.select(
        *keys, zero.alias("pages"), zero.alias("text_failures"), zero.alias("scope1"), zero.alias("scope2"), zero.alias("scope3"),
        F.lit(1).alias("claims"), (length > 50).cast("int").alias("with_context"),
        (e["has_numeric_data"] | e["has_target_year"]).cast("int").alias("with_evidence"),
        (length > 100).cast("int").alias("good_context"))
    return pages.unionByName(found)


def _stat_sums() -> list[Column]:
    names = {
        "pages": "total_pages", "text_failures": "text_extraction_failures", "claims": "claims_found",
        "with_context": "claims_with_context", "with_evidence": "claims_with_evidence",
        "good_context": "claims_with_good_context",
        "scope1": "scope1_found", "scope2": "scope2_found", "scope3": "scope3_found",
    }
    return [F.sum(k).alias(v) for k, v in names.items()]


def extraction_stats(page_metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """Pages, claims and figures found per document."""
    return _stat_rows(page_metrics, claims).groupBy("document_id").agg(*_stat_sums())


def corpus_stats(page_metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """The same by company and year, by company, and over all documents.

    Documents are added up first, so the levels are built from one row per document.
    """
    per = _stat_rows(page_metrics, claims).groupBy("document_id", "company", "year").agg(*_stat_sums())
    names = [c for c in per.columns if c not in ("document_id", "company", "year")]
    return per.rollup("company", "year").agg(
        F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in names])


def stage_outcomes(results: DataFrame) -> DataFrame:
    """Successful and failed counts per stage and document, and per stage over the corpus.

    `results` has one row per attempt: `stage`, `document_id`, `error` (null when it went well).
    """
    per = results.groupBy("stage", "document_id").agg(
        F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return per.rollup("stage", "document_id").agg(
        F.sum("successful").alias("successful"), F.sum("failed").alias("failed")).where(F.col("stage").isNotNull())


#: Entries of a quantile sketch, and the share of all rows by which a bound may be off: four times its error at 99 %.
SKETCH, SLACK = 1024, 0.018


def value_at_share(df: DataFrame, column: str, part: float) -> DataFrame:
    """One row: of n sorted values the one at place floor(n * part) from 0, exactly and lazily, without sorting them in one task.

    A quantile sketch bounds the value from both sides; rows below the bounds are counted, and only distinct values between them are ordered. A sketch that
    missed its bounds, which happens less than once in millions, fails the job and does not give another value.
    """
    v, n = F.col(column), F.col("n")

    def bound(at: float) -> Column:
        return F.when(n > 0, F.kll_sketch_get_quantile_double("s", F.lit(min(max(at, 0.0), 1.0))))
    sketch = df.agg(F.kll_sketch_agg_double(v.cast("double"), F.lit(SKETCH)).alias("s"), F.count(v).alias("n"))
    bounds = sketch.select(F.floor(n * part).alias("k"), bound(part - SLACK).alias("low"), bound(part + SLACK).alias("high"))
    low, high, k = (bounds.select(c).scalar() for c in ("low", "high", "k"))
    below = df.where(v < low).agg(F.count("*")).scalar()
    w = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.where((v >= low) & (v <= high)).groupBy(column).agg(F.count("*").alias("_n")).withColumn("_upto", below + F.sum("_n").over(w))
    found = inside.where(F.col("_upto") > k).agg(F.min(column).alias("value"))
    missed = (below > k) | ((k >= 0) & F.col("value").isNull() & low.isNotNull())
    return found.select(F.when(missed, F.raise_error(F.lit("the sketch missed its bounds"))).otherwise(F.col("value")).alias("value"))


def throughput_stats(timings: DataFrame) -> DataFrame:
    """Mean, least, greatest and upper median of times, and mean time per page (paired by row)."""
    t = timings.where(F.col("total_time").isNotNull())
    median = value_at_share(t, "total_time", 0.5)
    return t.agg(
        F.avg("total_time").alias("mean_time"), F.min("total_time").alias("min_time"), F.max("total_time").alias("max_time"),
        F.avg(F.when(F.col("pages") > 0, F.col("total_time") / F.col("pages"))).alias("mean_time_per_page")).select(
        "mean_time", "min_time", "max_time", median.scalar().cast("double").alias("median_time"), "mean_time_per_page")
