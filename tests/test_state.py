"""Keyed state, watermarks, dead letters, versions: streams that are split, repeated, late or cut short."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlens.operators import audit as au
from reportlens.operators import reports as rp
from reportlens.plans import tables as t
from reportlens.sources import keyed as kt
from reportlens.sources import store as st
from reportlens.sources.derived import audit_responses
from reportlens.streaming import stages as sg
from reportlens.streaming.state import PROVIDER, document_states

REPORT = "company string, year int, document_id string, processed_at timestamp, n int"


def rows(df):
    return sorted(map(str, df.collect()))


# ---------------------------------------------------------------- keyed state


def test_audit_state_equals_batch_for_any_split(spark, sf, tmp_path):
    def at(n): return str(tmp_path / n)
    batch, answers = t.extracted(spark, sf), audit_responses(spark, sf)
    before = spark.conf.get(PROVIDER)
    parts = batch.withColumn("_p", F.pmod(F.xxhash64("document_id", "page"), F.lit(3)))
    want = t.reports(spark, sf)
    keep = [c for c in want.columns if c != "processed_at"]
    for p in range(3):  # pages of each document trickle in, one run at a time
        parts.where(F.col("_p") == p).drop("_p").coalesce(2).write.mode("append").parquet(at("extracted"))
        sg.stream_audit(spark, at("extracted"), answers, at("reports"), at("c"), batch.schema, files_per_batch=1, errors_path=at("errors")).awaitTermination()
    got = st.reports_upsert(None, sg.read_batches(spark, at("reports"), want.schema))
    assert rows(got.select(keep)) == rows(want.select(keep))
    assert spark.conf.get(PROVIDER) == before
    # Answers that could not be used are in the error table, and the stream went on.
    bad = spark.read.schema("document_id string, error_type string, message string").parquet(at("errors"))
    assert {r.document_id for r in bad.select("document_id").distinct().collect()} >= {r.document_id for r in au_errors(want)}


def au_errors(reports):
    return sg.audit_errors(reports).collect()


def test_state_is_bounded_and_ties_keep_their_order(spark, sf, tmp_path):
    batch = t.extracted(spark, sf)
    one = batch.limit(1).select("document_id", "company", "year", *[c for c in batch.columns if c not in ("document_id", "company", "year")]).first()
    many = spark.createDataFrame([one], batch.schema).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("text", F.lit("We aim for net zero. Our oil and renewable energy."))
    many.repartition(7).write.parquet(str(tmp_path / "in"))
    out = []

    def handle(df, _):
        out.extend(df.collect())
    stream = document_states(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), n=5)
    with sg.keyed_state(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2 + 5
    want = sg.select_claims(many, 5).orderBy("claim_rank").collect()
    assert [(c.claim_rank, c.score, c.page, c.claim, c.context) for c in out[-1].claims] == [(c.claim_rank, c.score, c.page, c.claim, c.context) for c in want]


# ---------------------------------------------------------------- watermark


def test_uploads_by_event_time(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = datetime(2024, 1, 1)
    schema = "id string, filename string, company string, year int, uploaded_at timestamp"

    def deliver(*messages):
        spark.createDataFrame([(i, f"{i}.pdf", "C", 2024, None if d is None else start + timedelta(days=d)) for i, d in messages], schema).coalesce(1).write.mode("append").parquet(src)
        q = sg.stream_dedup_uploads(spark, src, out, str(tmp_path / "c"), files_per_batch=1, delay="2 days")
        q.awaitTermination()
        return q

    def ids():
        return sorted(r.id for r in sg.read_batches(spark, out, "id string").collect())
    deliver(("a", 0), ("b", 0), ("a", 0))
    assert ids() == ["a", "b"]
    deliver(("a", 0), ("c", 1))  # again within the delay
    assert ids() == ["a", "b", "c"]
    deliver(("d", 10))
    q = deliver(("e", 10), ("a", 0), ("late", 3))  # the watermark is at day 8
    assert ids() == ["a", "b", "c", "d", "e"]
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 2
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 2  # a, b and c are forgotten
    deliver(("f", None))
    assert ids() == ["a", "b", "c", "d", "e", "f"]


# ---------------------------------------------------------------- dead letters


def test_bad_pages_and_vectors_end_in_the_error_table(spark, tmp_path):
    def at(n): return str(tmp_path / n)
    pages = spark.createDataFrame(
        [("d", "C", 2024, 1, "Scope 1 emissions: 5 tCO2e", None), (None, "C", 2024, 2, "x", None), ("e", "C", None, 1, None, None)], sg.schemas.REPORT_PAGES)
    pages.write.parquet(at("pages"))
    sg.stream_extract(spark, at("pages"), at("extracted"), at("c1")).awaitTermination()
    for _ in range(2):
        sg.stream_page_errors(spark, at("pages"), at("errors"), at("c2")).awaitTermination()
    bad = spark.read.parquet(at("errors")).collect()
    assert sorted((r.document_id or "", r.message, r.worker) for r in bad) == [("", "page without document_id", "extract"), ("e", "page without year, text", "extract")]
    assert spark.read.parquet(at("extracted")).where("document_id = 'd'").count() == 1


def test_vectors_of_other_dimension(spark, sf, tmp_path):
    def at(n): return str(tmp_path / n)
    want = t.reports(spark, sf)
    sg.put_batch(want.limit(3), at("reports"), 0)

    def load():
        import numpy as np
        return lambda texts: np.ones((len(texts), 3))
    sg.stream_chunks(spark, at("reports"), want.schema, at("chunks"), at("c"), load=load, errors_path=at("errors")).awaitTermination()
    bad = spark.read.parquet(at("errors"))
    assert bad.count() > 0 and {r.message for r in bad.collect()} == {"vector of 3 dimensions instead of 64"}
    assert sg.current_chunks(spark, at("chunks"), "document_id string, content string").count() == 0


# ---------------------------------------------------------------- versions


def frame(spark, *given):
    return spark.createDataFrame([(c, y, d, datetime(2024, 1, 1) + timedelta(hours=h), n) for c, y, d, h, n in given], REPORT)


@pytest.fixture
def table(spark, tmp_path):
    return kt.report_table(spark, str(tmp_path / "t"), T._parse_datatype_string(REPORT), buckets=4)


def state(table):
    return sorted((r.company or "", r.year or 0, r.n) for r in table.read().collect())


def test_upserts_make_versions(spark, table):
    assert state(table) == [] and table.manifest()[0] == -1
    assert table.upsert(frame(spark, ("a", 1, "x", 1, 1), ("b", 1, "x", 1, 2), (None, None, "x", 1, 3), ("a", 1, "y", 2, 4)), 0)
    assert state(table) == [("", 0, 3), ("a", 1, 4), ("b", 1, 2)]
    assert not table.upsert(frame(spark, ("a", 1, "z", 9, 9)), 0)  # the batch again
    assert table.upsert(frame(spark, ("a", 1, "z", 0, 9), ("c", 2, "x", 0, 5), (None, None, "x", 2, 6)), 1)
    assert state(table) == [("", 0, 6), ("a", 1, 4), ("b", 1, 2), ("c", 2, 5)]  # older rows do not replace newer ones
    version, held, batches = table.manifest()
    assert version == 1 and batches == {"stream": 1} and min(held.values()) in (0, 1)
    assert table.upsert(frame(spark, ("d", 3, "x", 0, 7)))
    touched = [b for b, v in table.manifest()[1].items() if v == 2]
    assert len(touched) == 1  # the other buckets stay where they are
    before = state(table)
    assert table.vacuum() > 0 and state(table) == before and table.vacuum() == 0
    assert table.upsert(frame(spark)) and state(table) == before


def test_a_run_that_ends_before_its_manifest_changes_nothing(spark, table):
    table.upsert(frame(spark, ("a", 1, "x", 1, 1)), 0)
    version, held, _ = table.manifest()
    table.stage(frame(spark, ("a", 1, "x", 2, 99), ("b", 1, "x", 2, 98)), version + 1, held)  # and then it ends
    assert state(table) == [("a", 1, 1)] and table.manifest()[0] == 0
    table.upsert(frame(spark, ("a", 1, "x", 2, 2)), 1)
    assert state(table) == [("a", 1, 2)]  # nothing of the lost run is left
    assert state(table) == [("a", 1, 2)]


def test_stream_into_table_with_replay(spark, table, tmp_path):
    src = str(tmp_path / "in")
    for h in range(3):
        frame(spark, ("a", 1, "x", h, h), (f"b{h}", 1, "x", h, h)).coalesce(1).write.mode("append").parquet(src)
    sg.stream_upsert(spark, src, table, str(tmp_path / "c1"), files_per_batch=1).awaitTermination()
    once = state(table)
    sg.stream_upsert(spark, src, table, str(tmp_path / "c2"), files_per_batch=1).awaitTermination()  # all batches again
    assert state(table) == once == [("a", 1, 2), ("b0", 1, 0), ("b1", 1, 1), ("b2", 1, 2)] and table.manifest()[0] == 2


def test_lookups_pass_over_row_groups(spark, tmp_path):
    schema = T._parse_datatype_string("chunk_id string, document_id string, page int, chunk_index int, content string")
    chunks = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content"))
    table = kt.chunk_table(spark, str(tmp_path / "t"), schema, buckets=8)
    table.upsert(chunks)
    some = [r.chunk_id for r in chunks.where("page in (5, 77)").collect()]
    found = table.lookup("chunk_id", some)
    assert sorted(r.page for r in found.collect()) == [5, 77]
    assert found.inputFiles() and len({f.split("bucket=")[1][0] for f in found.inputFiles()}) <= 2  # of eight buckets
    # An id that is nowhere: the bloom filters leave out every row group, where minimum and maximum could not.
    scanned = table.lookup("chunk_id", ["5" + "0" * 63])
    scanned.collect()
    metrics = scanned._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.get("numOutputRows").get().value() == 0
    assert table.lookup("page", [5]).count() == 1


def test_folded_batches_read_the_same(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "id string, n int"
    for b in range(6):
        sg.put_batch(spark.createDataFrame([(f"x{b}", b), ("y", b)], schema), path, b)

    def seen(**more):
        return rows(sg.read_batches(spark, path, schema, with_batch=True, **more))
    want, early = seen(), seen(before=3)
    # A fold that ends before its marker changes nothing.
    sg.read_batches(spark, path, schema, 2, True).write.parquet(f"{path}-base/data/v=9")
    assert seen() == want
    for upto in (1, 3, 5):
        sg.fold_batches(spark, path, schema, upto)
        assert sg.folded_upto(spark, path) == upto and seen() == want and seen(before=3) == early
        if upto == 3:
            assert sg.drop_folded(spark, path) > 0 and seen() == want and seen(before=3) == early
            sg.put_batch(spark.createDataFrame([("x2", 2), ("y", 2)], schema), path, 2)  # a replay of a folded batch
            assert seen() == want
    sg.put_batch(spark.createDataFrame([("z", 6)], schema), path, 6)
    assert len(seen()) == len(want) + 1
    assert sg.drop_folded(spark, path) > 0 and len(seen()) == len(want) + 1


# ---------------------------------------------------------------- requests and sketches


def test_request_json_text(spark):
    evidence = "struct<has_target_year:boolean,has_numeric_data:boolean,has_commitment_language:boolean>"
    df = spark.createDataFrame(
        [("d", [(1, 3, 2.5, "t\"CO2")], [("net \"zero\"", 3, 2030, "line one\nline two \\ é", (True, False, True)), ("oil", 4, None, None, None)]), ("e", [], [])],
        f"document_id string, generic_sample array<struct<sample_rank:int,page:int,value:double,unit:string>>, claims array<struct<claim:string,page:int,target_year:int,context:string,evidence:{evidence}>>")
    made = {r.document_id: r for r in au.request_json(df).collect()}
    assert json.loads(made["d"].metrics_json) == [{"sample_rank": 1, "page": 3, "value": 2.5, "unit": "t\"CO2"}]
    assert made["d"].claims_json == (
        '[{"claim":"net \\"zero\\"","page":3,"target_year":2030,"context":"line one\\nline two \\\\ é",'
        '"evidence":{"has_target_year":true,"has_numeric_data":false,"has_commitment_language":true}},{"claim":"oil","page":4}]')
    assert (made["e"].metrics_json, made["e"].claims_json) == ("[]", "[]")


def test_merged_sketches_equal_the_whole(spark):
    df = spark.range(200000).select((F.col("id") % 50000).alias("company"), (F.col("id") % 3).cast("int").alias("year"), (F.col("id") % 7).cast("int").alias("month"))
    parts = rp.distinct_sketches(df, "company", "year", "month")
    whole = rp.distinct_sketches(df, "company", "year")
    merged = {r.of_year: r.estimate for r in rp.merged_distinct(parts, "year").collect()}
    assert merged == {r.of_year: r.estimate for r in rp.merged_distinct(whole, "year").collect()} and set(merged) == {0, 1, 2, None}
    assert abs(merged[None] - 50000) < 0.04 * 50000
    odd = spark.createDataFrame([(None, 1), ("a", None), ("a", 1)], "company string, year int")
    assert {r.of_year: r.estimate for r in rp.merged_distinct(rp.distinct_sketches(odd, "company", "year"), "year").collect() if r.of_year} == {1: 1}
    assert rp.merged_distinct(rp.distinct_sketches(odd.limit(0), "company", "year"), "year").where("of_year is not null").count() == 0
