"""Sinks and read-backs. Each write is idempotent, so a retried batch changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_key
from ..operators.audit import metric_sum
from ..operators.chunks import chunk_id
from ..session import materialize

LATEST = ("company", "year")


def extract_json_key(company: Column, year: Column) -> Column:
    return F.concat(safe_key(company), F.lit("_"), year.cast("string"), F.lit(".json"))


def extract_json_sink(rows: DataFrame, path: str, buckets: int = 4) -> None:
    """Stage JSON by year and bucket of companies; rows of a (company, year) written before are replaced.

    One file per company and year would mean millions of tiny files, so a folder holds many companies. The
    folders that this run writes, and those that hold an older version of its rows, are rewritten. Other rows in them stay
    as the lines they were, with all their fields, whatever columns this run has and however many buckets earlier runs used.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("company_key", safe_key(F.col("company")))
    keys = keyed.select("company_key", "year").distinct()
    new = keyed.select(F.to_json(F.struct(*[c for c in keyed.columns if c != "year"])).alias("value"), F.col("year").cast("int").alias("year"),
                       F.pmod(F.xxhash64("company_key"), F.lit(buckets)).cast("int").alias("bucket"))
    merged = new
    if stored_before(spark, path):
        lines = spark.read.schema("value string, year int, bucket int").format("text").load(path).withColumn(
            "company_key", F.get_json_object("value", "$.company_key"))
        replaced = lines.join(keys, ["company_key", "year"], "left_semi").select("year", "bucket")
        touched = replaced.union(new.select("year", "bucket")).distinct()
        kept = lines.join(keys, ["company_key", "year"], "left_anti").join(touched, ["year", "bucket"], "left_semi").where("value <> ''")
        # An empty line stands for each folder, so that one left without rows is emptied too; readers pass over it.
        blank = touched.select(F.lit("").alias("value"), "year", "bucket")
        # The folders are read and replaced in one run, so the merged rows are settled first.
        merged = materialize(kept.select("value", "year", "bucket").union(new).union(blank), "merged-json")
    (
        merged.hint("rebalance", F.col("year"), F.col("bucket"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "bucket").format("text").save(path)
    )


def stored_before(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("year int").json(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def extract_json_scan(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Stage JSON lines with a given schema: readable rows, and the texts of broken ones.

    Parsed from text lines, because a JSON scan refuses queries on the broken rows alone.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.from_json("value", schema + ", _corrupt_record string", options).alias("_row"))
    broken = F.col("_row._corrupt_record").isNotNull()
    good = lines.where(~broken).select("_row.*").drop("_corrupt_record")
    return good, lines.where(broken).select("value")


def reports_upsert(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """The report table after the upsert: the latest `processed_at` per (company, year) stays.

    Ranking to 1 is limited per task before the shuffle, so many rewrites of one key stay cheap.
    """
    rows = new if existing is None else existing.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*LATEST).orderBy(F.desc("processed_at"), "document_id")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def chunks_upsert(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """New chunks to append: distinct by (document, page, content) and not stored yet.

    The key is a digest; equal texts are reduced by a partial aggregate before anything is joined.
    """
    keyed = new.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("page"), F.col("content")))
    distinct = keyed.dropDuplicates(["chunk_id"])
    if existing is None:
        return distinct
    return distinct.join(existing.select("chunk_id"), "chunk_id", "left_anti")


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(error).isNull()), rows.where(F.col(error).isNotNull())


def error_rows(failed: DataFrame, error_type: str, worker: str, at: Column | None = None) -> DataFrame:
    """Failed documents in the error table's shape."""
    return failed.select(
        "document_id", F.lit(error_type).alias("error_type"), F.col("error").alias("message"),
        F.lit(worker).alias("worker"), (at if at is not None else F.current_timestamp()).alias("timestamp"))


def error_sink(failed: DataFrame, path: str, error_type: str, worker: str, run: str) -> None:
    """Each run (a batch id, a job id) owns its folder, so a retry of a run replaces what it wrote."""
    error_rows(failed, error_type, worker).write.mode("overwrite").parquet(f"{path}/run={worker}-{run}")


def report_backfill(processed: DataFrame, page_metrics: DataFrame) -> DataFrame:
    """Report rows from stored results; totals are summed over pages without removing repeats."""
    totals = page_metrics.groupBy("document_id").agg(
        F.sum(metric_sum(F.col("scope1"))).alias("scope1_total"), F.sum(metric_sum(F.col("scope2"))).alias("scope2_total"))
    return (
        processed.join(totals, "document_id", "left")
        .withColumns({t: F.coalesce(t, F.lit(0.0)) for t in ("scope1_total", "scope2_total")})
        .withColumn("source", F.coalesce("source", F.lit("Sustainability Report")))
        .withColumn("truth_score", F.col("leaf_rating"))
    )
