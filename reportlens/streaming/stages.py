"""The three stages as streams. Each reads the table the stage before appends to.

Checkpoints and keyed sinks give effectively-once results: a replayed batch rewrites the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.audit import report_rows
from ..operators.chunks import report_chunks
from ..operators.claims import claim_metrics_choice, detect_claims, score_claims, top_claims
from ..operators.embed import DEFAULT_DIM, embed_chunks
from ..operators.extract import page_metrics
from ..operators.search import other_dimension
from ..session import materialize
from ..sources.pages import page_source, upload_intake
from ..sources.keyed import KeyedTable
from ..sources.store import chunks_upsert, error_sink, stored_before
from ..taxonomy import METRIC_KINDS
from .state import document_states, keyed_state


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.REPORT_PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return page_source(reader.parquet(path))


def extract(pages: DataFrame) -> DataFrame:
    """Figures and claims of each page in one row; stateless, so it runs in batch and as a stream."""
    metrics = page_metrics(pages)
    return metrics.select("document_id", "company", "year", "page", "text", *METRIC_KINDS)


def run_available(df: DataFrame, checkpoint: str, path: str, *partitions: str) -> StreamingQuery:
    """Append everything now available to parquet; exactly once through the file sink's log."""
    return (
        df.writeStream.format("parquet").outputMode("append").partitionBy(*partitions)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_extract(spark: SparkSession, pages_path: str, out_path: str, checkpoint: str,
                   files_per_batch: int | None = None) -> StreamingQuery:
    """New page files -> page figures with the page's text (claims are read off it downstream)."""
    return run_available(extract(page_stream(spark, pages_path, files_per_batch)), checkpoint, out_path, "year")


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages that no later stage can place: without document, year, number or text."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("document_id", "year", "page", "text"))))
    return pages.where(F.size(missing) > 0).withColumn("error", F.concat(F.lit("page without "), F.array_join(missing, ", ")))


def stream_page_errors(spark: SparkSession, pages_path: str, errors_path: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Beside `stream_extract`: bad pages of each batch to the error table. The extraction goes on with the rest."""
    reader = spark.readStream.schema(schemas.REPORT_PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return run_batches(page_errors(reader.parquet(pages_path)), dead_letters(errors_path, "page", "extract"), checkpoint)


def dead_letters(errors_path: str, error_type: str, worker: str) -> Callable[[DataFrame, int], None]:
    """Sends rows with an `error` to the error table; a replayed batch replaces its own folder."""
    def handle(failed: DataFrame, batch_id: int) -> None:
        error_sink(failed, errors_path, error_type, worker, str(batch_id))
    return handle


#: Outcomes of an audit whose answer could not be used, with the text for the error table.
BAD_ANSWERS = {"error": "the model service failed", "missing": "no answer", "unparsed": "the answer is no JSON", "invalid": "the answer fails validation"}


def audit_errors(reports: DataFrame) -> DataFrame:
    text = F.create_map(*(F.lit(x) for pair in BAD_ANSWERS.items() for x in pair))
    return reports.where(F.col("audit_status").isin(*BAD_ANSWERS)).withColumn("error", F.try_element_at(text, F.col("audit_status")))


def select_claims(extracted: DataFrame, max_claims: int = 20) -> DataFrame:
    claims = claim_metrics_choice(detect_claims(extracted, distinct_base=True))
    return top_claims(score_claims(claims), max_claims)


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch to its own folder: a replay of the batch rewrites that folder and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema, before: int | None = None, with_batch: bool = False) -> DataFrame:
    """All batches, or those before one, so that a replayed batch does not see its own output; folded ones come from the base."""
    fields = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    upto = folded_upto(spark, path)
    rows = spark.read.schema(fields + ", batch int").option("basePath", path).parquet(path)
    if upto >= 0:
        rows = rows.where(F.col("batch") > upto).unionByName(spark.read.schema(fields + ", batch int").parquet(f"{path}-base/data/v={upto}"))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows if with_batch else rows.drop("batch")


def folded_upto(spark: SparkSession, path: str) -> int:
    """The last batch in the base; -1 if there is none."""
    done = f"{path}-base/done"
    newest = spark.read.schema("v int").option("basePath", done).json(done).agg(F.max("v")).first()[0] if stored_before(spark, done) else None
    return -1 if newest is None else newest


def fold_batches(spark: SparkSession, path: str, schema, upto: int) -> None:
    """Batches up to `upto` become a base of large files. Readers take the old folders until the marker is there, then the base and newer folders.

    A folded batch that is replayed rewrites a folder that nobody reads any more. The schema must name all columns that are to be kept.
    """
    rows = read_batches(spark, path, schema, before=upto + 1, with_batch=True)
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}-base/data/v={upto}")
    spark.createDataFrame([(upto,)], "upto int").coalesce(1).write.mode("overwrite").json(f"{path}-base/done/v={upto}")


def drop_folded(spark: SparkSession, path: str) -> int:
    """Deletes folders that the base holds, and older bases; for times when no reader is on them. Returns how many."""
    upto, hadoop, gone = folded_upto(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 0
    for top, pattern in ((path, "batch=*"), (f"{path}-base/data", "v=*"), (f"{path}-base/done", "v=*")):
        root = hadoop(top)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(hadoop(root, pattern)) or []:
            n = int(found.getPath().getName().split("=")[1])
            if n < upto or n == upto and top == path:
                fs.delete(found.getPath(), True)
                gone += 1
    return gone


def stream_audit(spark: SparkSession, extracted_path: str, responses: DataFrame, out_path: str, checkpoint: str,
                 extracted_schema, files_per_batch: int | None = None, errors_path: str | None = None) -> StreamingQuery:
    """Extracted pages -> top claims, totals, audit -> report rows; answers that cannot be used also go to the error table.

    A document's pages may arrive in several batches. What they have added up to is keyed state (`state.py`), so no page is read twice; a
    batch writes new versions of the documents it touches. The last version of a report has all pages, and `reports_upsert` keeps the last.
    """
    reader = spark.readStream.schema(extracted_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        settled = materialize(batch, "document-states")  # the audit reads it twice
        put_batch(report_rows(settled, responses, F.timestamp_seconds(F.lit(1_700_000_000 + batch_id))), out_path, batch_id)
        if errors_path:
            dead_letters(errors_path, "audit", "audit")(audit_errors(spark.read.parquet(f"{out_path}/batch={batch_id}")), batch_id)

    with keyed_state(spark):
        return (
            document_states(reader.parquet(extracted_path)).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_chunks(spark: SparkSession, reports_path: str, reports_schema, out_path: str, checkpoint: str,
                  extracted_path: str | None = None, extracted_schema=None, load=None, dim: int = DEFAULT_DIM, errors_path: str | None = None) -> StreamingQuery:
    """Audited reports -> chunks -> vectors. Each batch writes all chunks of its documents, and which documents it holds.

    A document that is audited again comes in a later batch, which replaces its chunks: `current_chunks` reads the last version. No batch
    reads what earlier ones wrote. With the extracted pages, reports without any text fall back to their figures.
    With `errors_path`, vectors of another dimension than `dim` go to the error table instead.
    A replayed audit batch leaves files under new names; its reports are then taken again, with the same chunks.
    """
    stream = spark.readStream.schema(reports_schema).option("ignoreMissingFiles", "true").parquet(f"{reports_path}/batch=*")

    def handle(batch: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy("document_id").orderBy(F.desc("processed_at"))
        latest = materialize(batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn"), "audited")
        pages = None
        if extracted_path:
            pages = spark.read.schema(extracted_schema).parquet(extracted_path).join(
                latest.select("document_id", "year").distinct(), ["document_id", "year"], "left_semi")
        chunks = embed_chunks(chunks_upsert(None, report_chunks(latest, pages)), load)
        if errors_path:
            chunks = materialize(chunks, "embedded")
            dead_letters(errors_path, "vector", "chunks")(other_dimension(chunks, dim), batch_id)
            chunks = chunks.where(F.size("embedding") == dim)
        put_batch(chunks, f"{out_path}/chunks", batch_id)
        put_batch(latest.select("document_id").distinct(), f"{out_path}/documents", batch_id)
    return run_batches(stream, handle, checkpoint)


def stream_upsert(spark: SparkSession, rows_path: str, table: KeyedTable, checkpoint: str, files_per_batch: int | None = None, writer: str = "stream") -> StreamingQuery:
    """New rows -> keyed table: each batch becomes visible as one version, and only once however often it is replayed."""
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, writer)
    return run_batches(reader.parquet(rows_path), handle, checkpoint)


def current_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The chunks of each document's last batch; `schema` names `document_id`."""
    last = read_batches(spark, f"{path}/documents", "document_id string", with_batch=True).groupBy("document_id").agg(F.max("batch").alias("batch"))
    return read_batches(spark, f"{path}/chunks", schema, with_batch=True).join(last, ["document_id", "batch"], "left_semi").drop("batch")


def stream_dedup_uploads(spark: SparkSession, uploads_path: str, out_path: str, checkpoint: str,
                         files_per_batch: int | None = None, delay: str = "7 days") -> StreamingQuery:
    """Uploads accepted once per id, also when a message is delivered again in a later batch.

    The guard is state that ends: an id is remembered until the newest `uploaded_at` is `delay` past its own, so a redelivery within the delay goes
    and state holds no more ids than arrive in that time. An upload that is itself older than that is late: it is refused, as Spark cannot
    know whether its id was there, and counted by the query's progress (`numRowsDroppedByWatermark`). One without a time is
    taken as of its batch. Files are taken in the order they were written.
    """
    reader = spark.readStream.schema(schemas.UPLOADS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    timed = upload_intake(reader.parquet(uploads_path)).withColumn("uploaded_at", F.coalesce("uploaded_at", F.current_timestamp()))
    fresh = timed.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        put_batch(batch, out_path, batch_id)
    return run_batches(fresh, handle, checkpoint)
