"""Streams give the tables the batch operators give; replays and split documents change nothing."""

from pyspark.sql import functions as F

from reportlens.operators import chunks as ch
from reportlens.plans import tables as t
from reportlens.sources import store as st
from reportlens.sources.derived import audit_responses, report_pages, uploads
from reportlens.sources.pages import upload_intake
from reportlens.streaming import stages as sg


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_in_a_row(spark, sf, tmp_path):
    def at(n): return str(tmp_path / n)
    report_pages(spark, sf).repartition(6).write.parquet(at("pages"))  # a document spans several files
    sg.stream_extract(spark, at("pages"), at("extracted"), at("c1"), files_per_batch=2).awaitTermination()
    batch = t.extracted(spark, sf)
    keep = ["document_id", "page", "scope1", "scope2", "scope3", "total", "generic"]
    assert rows(spark.read.schema(batch.schema).parquet(at("extracted")).select(keep)) == rows(batch.select(keep))

    answers = audit_responses(spark, sf)
    for _ in range(2):  # the second run finds nothing new
        sg.stream_audit(spark, at("extracted"), answers, at("reports"), at("c2"), batch.schema, files_per_batch=40).awaitTermination()
    want = t.reports(spark, sf)
    seen = st.reports_upsert(None, sg.read_batches(spark, at("reports"), want.schema))
    keep = ["document_id", "year", "leaf_rating", "ai_summary", "scope1_total", "scope3_count", "claims_analyzed_count"]
    assert rows(seen.select(keep)) == rows(want.select(keep))

    sg.stream_chunks(spark, at("reports"), want.schema, at("chunks"), at("c3"), at("extracted"), batch.schema).awaitTermination()
    stored = sg.current_chunks(spark, at("chunks"), "chunk_id string, document_id string, page int, content string")
    assert stored.count() == stored.select("chunk_id").distinct().count()
    keep = ["document_id", "page", "content"]
    assert rows(stored.select(keep)) == rows(st.chunks_upsert(None, ch.report_chunks(want, batch)).select(keep))


def test_chunks_of_a_later_audit_replace_the_earlier(spark, tmp_path):
    def at(n): return str(tmp_path / n)
    def report(doc, summary, n): return (doc, "C", 2024, summary, n)
    schema = "document_id string, company string, year int, ai_summary string, n int"
    full = t.reports(spark, "/root/testdata/sf0.001").schema
    kinds = {f.name: f.dataType for f in full}

    def audited(batch_id, *reports):
        given = spark.createDataFrame(list(reports), schema)
        out = given.select(*[F.col(c) if c in ("document_id", "company", "year", "ai_summary") else (
            F.timestamp_seconds(F.col("n")) if c == "processed_at" else F.lit(None)).cast(kinds[c]).alias(c) for c in full.names])
        sg.put_batch(out, at("reports"), batch_id)
    figure = "array<struct<value:double,unit:string,page:int,source:string>>"
    pages = spark.sql(f"""select 'b' as document_id, 'C' as company, 2024 as year, 1 as page, cast(null as string) as text,
        cast(array(struct(2.0, 't', 1, 's')) as {figure}) as scope1, cast(array() as {figure}) as scope2, cast(array() as {figure}) as scope3,
        cast(array() as {figure}) as total, cast(array() as {figure}) as generic""")
    pages.write.parquet(at("extracted"))

    def run():
        sg.stream_chunks(spark, at("reports"), full, at("chunks"), at("c"), at("extracted"), pages.schema).awaitTermination()
        found = sg.current_chunks(spark, at("chunks"), "document_id string, content string")
        return sorted((r.document_id, r.content.split(". ")[-1].split(": ")[-1].strip() if r.document_id == "a" else r.content[:10]) for r in found.collect())
    audited(0, report("a", "first half", 1), report("b", None, 1))
    assert run() == [("a", "first half"), ("b", "Company: C")]  # b has only its figures
    audited(1, report("a", "whole", 2))
    assert run() == [("a", "whole"), ("b", "Company: C")]
    audited(1, report("a", "whole", 2))  # the batch is replayed
    assert run() == [("a", "whole"), ("b", "Company: C")]


def test_uploads_delivered_again(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        uploads(spark, sf).coalesce(1).write.mode("append").parquet(src)
        sg.stream_dedup_uploads(spark, src, out, str(tmp_path / "c"), files_per_batch=1).awaitTermination()
    got = sg.read_batches(spark, out, "id string, filename string, company string, year int, metadata_source string")
    want = upload_intake(uploads(spark, sf)).select("id", "filename", "company", "year", "metadata_source")
    assert rows(got) == rows(want)
