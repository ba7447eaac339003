"""Work that must not be done twice: lists built once per page, schemas without the tables."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from reportlens import taxonomy as tx
from reportlens.functions.text import claim_context, evidence, evidence_signals, raw_sentences, strip
from reportlens.operators import claims as cl
from reportlens.operators import extract as ex
from reportlens.plans import tables
from reportlens.sources import derived

PAGES = "document_id string, company string, year int, page int, text string"
ROWS = [
    ("a_2020", "a", 2020, 1, "We are committed to net zero by 2030. Water consumption fell 12 % this year! Our goal is renewable energy. "
     "Energy consumption was 7.5 GWh. We invest in people and plants near us. Waste generated stays under 9 tonnes. GRI index."),
    ("a_2020", "a", 2020, 1, "We are committed to net zero by 2030."), ("b_2021", "b", 2021, 2, None), (None, "c", None, None, "carbon neutral by 2040"),
]


def names(t) -> list:
    if isinstance(t, StructType):
        return [(f.name, names(f.dataType)) for f in t]
    if isinstance(t, ArrayType):
        return ["array", names(t.elementType)]
    return ["map", names(t.valueType)] if isinstance(t, MapType) else [t.simpleString()]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark):
    df = ex.page_metrics(spark.createDataFrame(ROWS, PAGES).withColumn("tables", F.lit(None).cast("array<array<array<string>>>")))
    return df.localCheckpoint()


def test_claims_are_built_once_per_page(spark):
    """A filter on the size of a computed list would build the list again, twice."""
    for distinct in (False, True):
        for plan in (cl.detect_claims(pages(spark), distinct_base=distinct), cl.claim_keywords_on_pages(pages(spark), distinct_base=distinct)):
            assert "size(transform" not in optimized(plan)


def test_long_figures_are_built_once_per_page(spark):
    assert "size(flatten" not in optimized(ex.metrics_long(pages(spark)))


def test_shared_evidence_is_that_of_each_context(spark):
    found = cl.detect_claims(pages(spark))
    assert found.count() > 5
    assert found.where(~F.col("evidence").eqNullSafe(evidence(F.col("context")))).count() == 0
    assert found.select("document_id", "page").distinct().count() == 2


def test_evidence_is_read_for_picked_claims(spark):
    """Scores need three signals; before, phrases and counts were built for every claim and sorted with it."""
    picked = cl.best_claims(pages(spark), 3)
    assert "key_phrases" not in optimized(picked).split("Window [")[-1]
    plain = cl.top_claims(cl.score_claims(cl.claim_metrics_choice(cl.detect_claims(pages(spark), distinct_base=True))), 3)
    both = [sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect()) for df in (picked, plain)]
    assert both[0] == both[1] and len(both[0]) > 3


def test_contexts_shared_by_hits(spark):
    """Texts around a sentence are built once per page; a hit in a wide gap, or in a short text, has its own."""
    gap = ROWS + [("d", "d", 2020, 1, "A coal.  " * 9 + "We use oil and coal.   Net zero!\n\n\nGRI." + " water usage" * 60)]
    found = cl.claims_read(spark.createDataFrame(gap, PAGES), evidence_signals).join(
        spark.createDataFrame(gap, PAGES).select("document_id", "page", "text").distinct(), ["document_id", "page"])
    at = F.instr(F.lower("text"), F.lower("claim")) - 1
    wrong = ~F.col("context").eqNullSafe(claim_context(F.col("text"), raw_sentences(F.col("text")), at, F.col("claim")))
    assert found.where("document_id = 'd'").count() > 4 and found.where(wrong & (F.col("document_id") != "a_2020")).count() == 0


def test_strip_trims_every_kind_of_space(spark):
    texts = ["", " ", "a", " a ", "\t a\u2003", "\u00a0 \u3000", "a\n b", " \u0085a", "é \u2028", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [None if r["t"] is None else r["t"].strip() for r in rows]


def test_keywords_are_sought_by_shared_word(spark):
    words = tx.claim_keywords()
    groups = tx.keyword_groups(words)
    assert sorted(i for _, members in groups for i in members) == [*range(len(words))] and len(groups) < len(words) / 2
    assert all(w in words[i].lower() for w, members in groups for i in members)
    text = "; ".join(words[::2]) + "; recent gold and oils, ISO 9001"
    row = spark.createDataFrame([(text,)], "text string").select(cl.page_hits(words).alias("h")).first()
    assert [h["keyword_ord"] for h in row["h"]] == [i for i, k in enumerate(words) if k.lower() in text.lower()]


def test_schemas_need_no_stored_table(spark, sf, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(tables, "materialize", lambda *a: pytest.fail("a table was stored for its schema"))
        early = tables.extracted_schema(spark, sf), tables.reports_schema(spark, sf)
    assert [*map(names, early)] == [names(tables.extracted(spark, sf).schema), names(tables.reports(spark, sf).schema)]


def test_tasks_of_pages_follow_the_input(spark, sf, monkeypatch):
    """Dealt out by bytes, all pages of these tables are one task, and tasks at 1 GB hold hundreds of thousands."""
    size = os.path.getsize(f"{sf}/lineitem.parquet")
    monkeypatch.setattr(derived, "PART_BYTES", size // 7 + 1)
    assert derived.page_parts(spark, sf) == 7
    assert derived.report_pages(spark, sf).rdd.getNumPartitions() == 7


def test_runs_of_a_report_stay_together(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "page_parts", lambda *a: 7)
    rows = spark.range(2000).selectExpr("'a' as document_id", "cast(id as int) as page").union(
        spark.range(50).selectExpr("concat('b', id) as document_id", "cast(null as int) as page"))
    at = tables.neighbours(spark, sf, rows).withColumn("task", F.spark_partition_id())
    assert at.count() == 2050
    per = at.where("document_id = 'a'").groupBy(F.floor(F.col("page") / tables.RUN)).agg(F.count_distinct("task").alias("n"))
    assert per.where("n > 1").count() == 0
    # A report of very many pages is not left to one task.
    assert at.where("document_id = 'a'").select("task").distinct().count() > 1
