"""Registered queries: one per operator, each over whole tables, with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import answers as A
from ..functions import text as X
from ..functions.patterns import ignore_case
from ..functions.vectors import cosine_similarity as cosine
from ..operators import audit as au
from ..operators import chunks as ch
from ..operators import claims as cl
from ..operators import embed as em
from ..operators import evaluate as ev
from ..operators import extract as ex
from ..operators import pivots as pv
from ..operators import quantise as qz
from ..operators import reports as rp
from ..operators import search as se
from ..session import materialize, spread, workspace
from ..sources import keyed as kt
from ..sources import pages as sp
from ..sources import store as st
from ..sources.derived import audit_responses, derived, judgements, report_pages, table, texts, uploads
from ..streaming import stages as sg
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
PAGE = ["document_id", "page"]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def joined(c: Column) -> Column:
    return F.array_join(c, " | ")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- scans, sources, sinks


@query
def page_source(spark, d):
    return sp.page_source(sp.line_pages(texts(spark, d, "documents")))


@query
def upload_intake(spark, d):
    return sp.upload_intake(uploads(spark, d)).select("id", "filename", "company", "year", "metadata_source")


@query
def source_route(spark, d):
    return sp.source_route(table(spark, d, "pages").select("page_id", "url"), "#top")


@query
def link_extract(spark, d):
    return sp.link_extract(texts(spark, d, "pages"), "/th").select("page_id", "href", "link")


def _totals(spark, d):
    return au.scope_totals(au.report_metric_dedup(t.extracted(spark, d)))


@query
def extract_json_sink(spark, d):
    path = workspace(spark, "extract-json")
    st.extract_json_sink(_totals(spark, d), path)
    st.extract_json_sink(_totals(spark, d), path)  # a second run replaces, it does not add
    back = spark.read.schema("document_id string, company string, scope1_total double, company_key string, year int, bucket int").json(path)
    return back.select("document_id", "company_key", "year", st.extract_json_key(F.col("company"), F.col("year")).alias("file_name"), "scope1_total")


@query
def extract_json_scan(spark, d):
    path = workspace(spark, "stage-json")
    _totals(spark, d).write.json(path)
    good, _ = st.extract_json_scan(spark, path, "document_id string, company string, year int, scope2_total double, scope2_count int")
    return good


@query
def reports_upsert(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("company"), F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("processed_at"), F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_totalprice").alias("scope1_total"))
    return st.reports_upsert(None, o).select("company", "year", "document_id", "scope1_total")


@query
def reports_table(spark, d):
    """The same upsert as a stream into a keyed table: three batches, then each of them again."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("company"), F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").cast("timestamp").alias("processed_at"), F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_totalprice").alias("scope1_total"))
    source, at = workspace(spark, "upsert-in"), workspace(spark, "report-table")
    reports = kt.report_table(spark, at, o.schema)
    for part in range(3):
        o.where(F.col("document_id").cast("long") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run is a replay from a new checkpoint under the same writer
        sg.stream_upsert(spark, source, reports, workspace(spark, "ck"), files_per_batch=1).awaitTermination()
    return reports.read().select("company", "year", "document_id", "scope1_total")


@query
def stream_errors(spark, d):
    """Audits whose answer could not be used, sent to the error table by a stream over the stored reports."""
    source, at = workspace(spark, "reports-in"), workspace(spark, "errors")
    t.reports(spark, d).write.parquet(source)
    stream = spark.readStream.schema(t.reports(spark, d).schema).parquet(source)
    sg.run_batches(sg.audit_errors(stream), sg.dead_letters(at, "audit", "audit"), workspace(spark, "ck")).awaitTermination()
    return spark.read.schema("document_id string, error_type string, message string, worker string, run string").parquet(at).drop("run")


@query
def distinct_sketches(spark, d):
    """Customers per year and over all years: exact counts, and whether sketches merged from those of the months agree within 4 %."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    stored = materialize(rp.distinct_sketches(o, "company", "year", "month"), "sketches")
    exact = o.cube("year").agg(F.countDistinct("company").alias("companies"))
    return exact.join(rp.merged_distinct(stored, "year"), F.col("year").eqNullSafe(F.col("of_year"))).select(
        "year", "companies", (F.abs(F.col("estimate") - F.col("companies")) <= 0.04 * F.col("companies")).alias("agrees"))


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("_i", "content"),
    ).select("document_id", (F.col("_i") + 1).alias("page"), "content")


@query
def chunks_upsert(spark, d):
    docs = texts(spark, d, "documents")
    old = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return st.chunks_upsert(st.chunks_upsert(None, _lines(old)), _lines(docs)).select("document_id", "page", "content")


@query
def error_sink(spark, d):
    _, failed = st.split_errors(audit_responses(spark, d))
    path = workspace(spark, "errors")
    for _ in range(2):  # a retry adds nothing
        st.error_sink(failed, path, "audit_error", "auditor", "0")
    return spark.read.schema("document_id string, error_type string, message string, worker string, run string").parquet(path).drop("run")


@query
def report_backfill(spark, d):
    done = t.reports(spark, d).drop("scope1_total", "scope2_total")
    return st.report_backfill(done, t.extracted(spark, d)).select(
        "company", "year", "source", "truth_score", "scope1_total", "scope2_total")


# ---------------------------------------------------------------- filters


@query
def list_reports(spark, d):
    return rp.list_reports(t.reports(spark, d))


@query
def company_filter(spark, d):
    r = t.reports(spark, d)
    return rp.list_reports(r.where(se.company_filter(F.col("company"), "IER#00000001")))


@query
def year_filter(spark, d):
    r = t.reports(spark, d)
    return rp.list_reports(r.where(se.year_filter(F.col("year"), 1997)))


@query
def similarity_threshold(spark, d):
    pairs = se.query_chunk_similarity(t.vector_chunks(spark, d), t.search_queries(spark, d), 0.0)
    return pairs.groupBy("query_id").agg(
        F.count_if(se.similarity_threshold(F.col("similarity"), 0.1)).alias("over"),
        F.count_if(se.similarity_threshold(F.col("similarity"), 0.1, strict=False)).alias("from_"),
        F.count("*").alias("positive"))


@query
def claim_unit_filter(spark, d):
    hits = cl.claim_keywords_on_pages(t.extracted(spark, d))
    kept = hits.withColumn("_kept", cl.claim_unit_filter(F.col("generic"), F.col("claim")))
    return kept.select(*PAGE, "claim", F.size("_kept").alias("n_kept"), r6(au.metric_sum(F.col("_kept"))).alias("sum_kept"))


@query
def min_chunk_filter(spark, d):
    chunks = ch.min_chunk_filter(ch.semantic_chunks(texts(spark, d, "documents").select("doc_id", "text")))
    return chunks.select("doc_id", "chunk_index", F.length("content").alias("chunk_size"))


@query
def valid_audit_filter(spark, d):
    a = audit_responses(spark, d).withColumn("_a", A.parse_audit(F.col("raw_text")))
    return a.where(A.is_valid_audit(F.col("_a"))).select("document_id", F.col("_a.overall_score").alias("overall_score"))


# ---------------------------------------------------------------- joins


@query
def claim_page_metrics(spark, d):
    pages = t.extracted(spark, d)
    found = cl.claim_keywords_on_pages(pages).select(*PAGE, "claim")
    out = au.claim_page_metrics(found, pages)
    return out.select(*PAGE, "claim", *[F.size(k).alias(f"n_{k}") for k in ("scope1", "scope2", "generic")])


@query
def claim_metrics_choice(spark, d):
    found = cl.claim_metrics_choice(cl.claim_keywords_on_pages(t.extracted(spark, d)))
    m = F.col("metrics")
    return found.select(*PAGE, "claim", *[F.size(m[k]).alias(f"n_{k}") for k in ("scope1", "scope2", "scope3", "generic")])


def _audits(spark, d):
    r = t.reports(spark, d)
    return r.select("document_id", F.struct("claim_reviews").alias("audit"))


@query
def claim_review_join(spark, d):
    picked = t.reports(spark, d).select("document_id", F.inline("claims")).select("document_id", "page", "claim", "claim_rank")
    out = au.claim_review_join(picked, _audits(spark, d))
    return out.select("document_id", "page", "claim", F.col("review.score").alias("score"), F.col("review.reason").alias("reason"))


@query
def status_lookup(spark, d):
    return rp.status_lookup(uploads(spark, d), st.reports_upsert(None, _valid_reports(spark, d)))


def _valid_reports(spark, d):
    return t.reports(spark, d).where(F.col("audit_status") == "valid")


@query
def query_chunk_similarity(spark, d):
    pairs = se.query_chunk_similarity(t.vector_chunks(spark, d), t.search_queries(spark, d), t.THRESHOLD)
    return pairs.select("query_id", "chunk_id", r6("similarity").alias("similarity"))


@query
def pages_hit(spark, d):
    return ev.pages_hit(t.hits(spark, d), judgements(spark, d)).select("query_id", "rank", "page", "hit")


@query
def threshold_grid(spark, d):
    grid = ev.threshold_grid(t.hits(spark, d).drop("threshold"))
    return grid.where(F.col("similarity") > F.col("threshold")).select("query_id", "threshold", "rank", "chunk_id")


@query
def stage_backlog(spark, d):
    r = t.reports(spark, d)
    return rp.stage_backlog(
        uploads(spark, d), t.extracted(spark, d).where(F.size("scope3") > 0), r.where(F.col("audit_status") != "missing"),
        _valid_reports(spark, d))


def _requests(spark, d):
    s = table(spark, d, "supplier")
    following = F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0"))
    return s.select(F.col("s_suppkey").alias("request_id"), F.concat(
        F.col("s_name"), F.lit(", "), following, F.lit(",No Such Company ,"), F.col("s_name")).alias("companies"))


@query
def company_in_list(spark, d):
    latest = rp.latest_report(t.reports(spark, d))
    return rp.company_in_list(latest, _requests(spark, d)).select("request_id", "pos", "company", "year")


# ---------------------------------------------------------------- aggregates


def _long(pages: DataFrame, kinds: list[str]) -> DataFrame:
    return ex.metrics_long(pages, kinds).select("document_id", "page", "kind", "ord", "value", "unit")


@query
def page_metric_dedup(spark, d):
    return ex.metrics_long(t.extracted(spark, d)).select("document_id", "page", "kind", "ord", "value", "unit", "source")


@query
def report_metric_dedup(spark, d):
    return _long(au.report_metric_dedup(t.extracted(spark, d)), au.REPORT_KINDS)


@query
def scope_totals(spark, d):
    """Straight from the pages: text and tables to totals per report."""
    return au.scope_totals(au.report_metric_dedup(t.figures(spark, d)))


@query
def extraction_stats(spark, d):
    pages = t.extracted(spark, d)
    return rp.extraction_stats(pages, cl.detect_claims(pages))


@query
def corpus_stats(spark, d):
    pages = t.extracted(spark, d)
    return rp.corpus_stats(pages, cl.detect_claims(pages))


@query
def system_stats(spark, d):
    return rp.system_stats(t.reports(spark, d), ch.report_chunks(spread(t.reports(spark, d))))


@query
def priority_mix(spark, d):
    return cl.priority_mix(t.reports(spark, d).select("document_id", F.inline("claims")))


@query
def metric_counts_by_kind(spark, d):
    return au.metric_counts_by_kind(au.report_metric_dedup(t.extracted(spark, d))).select(
        "document_id", "kind", "entries", "example", "page", "value")


@query
def throughput_stats(spark, d):
    out = rp.throughput_stats(derived(spark, d, "timings"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def _scores(spark, d):
    return ev.pr_at_k_mrr(t.hits(spark, d), judgements(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes])


@query
def eval_overall(spark, d):
    return _rounded(ev.eval_overall(_scores(spark, d)))


@query
def eval_by_category(spark, d):
    return _rounded(ev.eval_by_category(_scores(spark, d)))


@query
def eval_threshold_sweep(spark, d):
    return _rounded(ev.eval_threshold_sweep(t.hits(spark, d), judgements(spark, d)))


@query
def eval_diversity(spark, d):
    return ev.eval_diversity(t.hits(spark, d), judgements(spark, d))


@query
def page_emission_sums(spark, d):
    return ch.page_emission_sums(t.extracted(spark, d))


@query
def stage_outcomes(spark, d):
    r = t.reports(spark, d)
    audit = r.select(F.lit("audit").alias("stage"), "document_id", F.when(
        F.col("audit_status") != "valid", F.col("audit_status")).alias("error"))
    pages = t.extracted(spark, d).select(F.lit("extract").alias("stage"), "document_id", F.when(
        F.col("text").isNull(), "no text").alias("error"))
    return rp.stage_outcomes(audit.unionByName(pages))


# ---------------------------------------------------------------- windows and top-k


@query
def similar_claim_dedup(spark, d):
    return cl.similar_claim_dedup(cl.claim_keywords_on_pages(t.extracted(spark, d)).drop("base")).select(*PAGE, "claim")


@query
def top_claims(spark, d):
    return t.select_from(t.neighbours(spark, d, t.extracted(spark, d))).select(*PAGE, "claim", "claim_rank", "score")


@query
def simple_top_claims(spark, d):
    return cl.simple_top_claims(cl.claim_keywords_on_pages(t.extracted(spark, d))).select(*PAGE, "claim")


@query
def metric_sample(spark, d):
    distinct = au.report_metric_dedup(t.extracted(spark, d))
    return au.metric_sample(distinct).select("document_id", "sample_rank", "page", "value", "unit")


@query
def latest_report(spark, d):
    return rp.list_reports(rp.latest_report(t.reports(spark, d)))


@query
def company_history(spark, d):
    return rp.company_history(t.reports(spark, d))


@query
def compare_companies(spark, d):
    return rp.compare_companies(t.reports(spark, d), _requests(spark, d), "scope1_total")


def _hit_columns(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", "company", "year", "page", r6("similarity").alias("similarity"))


@query
def vector_topk(spark, d):
    return _hit_columns(t.hits(spark, d))


@query
def vector_topk_capped(spark, d):
    return _hit_columns(se.vector_topk_capped(t.vector_chunks(spark, d), t.search_queries(spark, d), t.THRESHOLD))


@query
def vector_topk_ivf(spark, d):
    """Sublinear search: product-quantised codes, and exact scores for nine chunks per question."""
    chunks = t.vector_chunks(spark, d)
    book = qz.fit_codebook(chunks)
    codes = materialize(qz.encode(chunks, book), "codes")
    return _hit_columns(qz.vector_topk_quantised(chunks, codes, book, t.search_queries(spark, d), t.THRESHOLD, rerank=9))


@query
def query_chunk_similarity_pruned(spark, d):
    """All pairs over 0.35, without reading cells that a pivot rules out."""
    chunks = t.vector_chunks(spark, d)
    pivots = pv.choose_pivots(chunks)
    celled = materialize(pv.assign_cells(chunks, pivots), "cells", "list_id")
    pairs = pv.pruned_similarity(celled, pv.PivotTable.of(celled, pivots), t.search_queries(spark, d), 0.35)
    return pairs.select("query_id", "chunk_id", r6("similarity").alias("similarity"))


# ---------------------------------------------------------------- set operations


@query
def text_table_union(spark, d):
    return _long(ex.text_table_union(report_pages(spark, d)), tx.SCOPE_KINDS)


@query
def combine_page_metrics(spark, d):
    return au.combine_page_metrics(t.extracted(spark, d)).select("document_id", "page", "kind", "ord", "value", "unit")


@query
def taxonomy_build(spark, d):
    """The taxonomy with the number of pages that mention each keyword."""
    found = cl.claim_keywords_on_pages(report_pages(spark, d)).groupBy(F.col("claim").alias("keyword")).agg(
        F.count("*").alias("pages"))
    return tx.taxonomy_table(spark).join(found, "keyword", "left").withColumn("pages", F.coalesce("pages", F.lit(0).cast("long")))


# ---------------------------------------------------------------- scalar functions


@query
def parse_number(spark, d):
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    raw = (
        F.when(n == 1, F.concat(k, F.lit(",000.50"))).when(n == 2, F.concat(F.lit(" "), k, F.lit(" 12.")))
        .when(n == 3, F.concat(k, F.lit("d"))).when(n == 4, F.concat(F.lit("-"), k, F.lit(".25e1")))
        .when(n == 5, F.concat(k, F.lit("\n200"))).when(n == 6, F.concat(F.lit("."), k)).otherwise(F.concat(k, F.lit("_0")))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("number", X.parse_number(F.col("raw")))


@query
def normalize_unit(spark, d):
    raw = F.explode(F.regexp_extract_all("text", F.lit(ignore_case(tx.NUMERIC_PATTERN)), F.lit(2)))
    pages = report_pages(spark, d).select("text").unionByName(texts(spark, d, "documents").select("text"))
    units = pages.select(F.coalesce("text", F.lit("")).alias("text")).select(raw.alias("raw"))
    return units.withColumn("unit", X.normalize_unit(F.col("raw"))).groupBy("raw", "unit").agg(F.count("*").alias("n"))


@query
def target_year(spark, d):
    docs = texts(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    pages = report_pages(spark, d).select(F.concat_ws("-", "document_id", "page").alias("id"), "text")
    return docs.unionByName(pages).select("id", X.target_year(F.col("text")).alias("target_year"))


DOC_WORDS = ["the", "aim", "oil", "des", "sch", "que"]


def _document_hits(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "text").withColumn("_s", X.raw_sentences(F.col("text")))
    return cl.claim_keywords_on_pages(docs, DOC_WORDS)


@query
def sentence_context(spark, d):
    return _document_hits(spark, d).select(
        "doc_id", "claim", X.sentence_context(F.col("text"), F.col("_s"), F.col("at"), F.col("claim")).alias("context"))


@query
def char_context(spark, d):
    return _document_hits(spark, d).select(
        "doc_id", "claim", X.char_context(F.col("text"), F.col("at"), F.col("claim")).alias("context"))


def _evidence_columns(e: Column) -> list[Column]:
    return [
        e["has_target_year"].alias("has_target_year"), e["target_year"].alias("target_year"),
        e["has_numeric_data"].alias("has_numeric_data"), e["numeric_count"].alias("numeric_count"),
        e["has_commitment_language"].alias("has_commitment_language"),
        joined(e["commitment_words"]).alias("commitment_words"), joined(e["key_phrases"]).alias("key_phrases"),
    ]


@query
def evidence(spark, d):
    docs = texts(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    pages = report_pages(spark, d).select(F.concat_ws("-", "document_id", "page").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.unionByName(pages).withColumn("e", X.evidence(F.col("text"))).select("id", *_evidence_columns(F.col("e")))


@query
def key_phrases(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.posexplode(X.key_phrases(F.col("text"))).alias("ord", "phrase"))


@query
def clean_text(spark, d):
    docs = texts(spark, d, "documents")
    marked = F.concat(F.lit("Page 3 of 12\n"), F.col("text"), F.lit("\t PAGE "), F.col("doc_id").cast("string"), F.lit(" OF 9"))
    digits = F.concat(F.col("doc_id").cast("string"), F.lit(" \n"))
    return docs.select("doc_id", X.clean_text(marked).alias("clean"), X.clean_text(digits).alias("digits"))


@query
def split_sentences(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("ord", "sentence"))


@query
def normalize_company(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("raw")).unionByName(table(spark, d, "part").select(
        F.concat(F.lit("3m & "), F.col("p_name"), F.lit("  (Pte.) "), F.col("p_brand")).alias("raw")))
    return s.withColumn("company", X.normalize_company(F.col("raw"))).groupBy("raw", "company").agg(F.count("*").alias("n"))


@query
def company_year_from_filename(spark, d):
    parsed = X.company_year_from_filename(F.col("filename"), 2024)
    return uploads(spark, d).select("filename", parsed.alias("p")).select("filename", "p.company", "p.year")


@query
def company_year_rsplit(spark, d):
    names = uploads(spark, d).select("filename").unionByName(
        t.reports(spark, d).select(F.concat("document_id", F.lit(".pdf")).alias("filename")))
    return names.select("filename", X.company_year_rsplit(F.col("filename")).alias("p")).select("filename", "p.company", "p.year")


@query
def metadata_resolve(spark, d):
    taken = sp.upload_intake(uploads(spark, d))
    return sp.metadata_resolve(taken, 2024).select("id", "company", "year", "metadata_source")


@query
def claim_score(spark, d):
    """Straight from the pages: figures, claims, evidence and score of every claim."""
    return cl.score_claims(t.claims(spark, d)).select(*PAGE, "claim", "target_year", "score")


@query
def parse_audit_json(spark, d):
    a = audit_responses(spark, d).withColumn("_a", A.parse_audit(F.col("raw_text")))
    return a.select(
        "document_id", F.col("_a").isNotNull().alias("parsed"), F.col("_a.overall_score").alias("overall_score"),
        F.col("_a.overall_summary").alias("overall_summary"), F.size("_a.claim_reviews").alias("reviews"))


def _answers(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(
        F.lit('{"answer": "turn '), F.col("turn").cast("string"), F.lit('", "citations": [{"company": "A", "year": 2024, "page": '),
        F.col("turn").cast("string"), F.lit(', "quote": "q"}], "confidence": "High"}'))
    raw = (
        F.when(F.length("text") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.length("text") % 3 == 1, body).otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


@query
def parse_answer_json(spark, d):
    a = _answers(spark, d).withColumn("a", A.parse_answer(F.col("raw")))
    return a.select("conv_id", "turn", "a.answer", "a.confidence", F.size("a.citations").alias("citations"))


@query
def claim_chunk_text(spark, d):
    return ch.claim_chunks(spread(t.reports(spark, d))).select("document_id", "page", "chunk_index", "content")


@query
def summary_chunk_text(spark, d):
    r = t.reports(spark, d)
    return r.select("document_id", ch.summary_chunk_text(F.col("company"), F.col("year"), F.col("ai_summary")).alias("content"))


@query
def emissions_chunk_text(spark, d):
    return ch.emissions_chunks(t.extracted(spark, d)).select("document_id", "page", "chunk_index", "content")


@query
def cosine_similarity(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", r6(cosine(F.col("embedding"), F.reverse("embedding"))).alias("similarity"))


@query
def rating_band(spark, d):
    return t.reports(spark, d).select("document_id", X.rating_band(F.col("leaf_rating")).alias("band"))


@query
def claim_preview(spark, d):
    c = t.reports(spark, d).select("document_id", F.inline("claims"))
    return c.select("document_id", "claim_rank", X.claim_preview(F.col("context")).alias("preview"))


@query
def confidence_band(spark, d):
    a = _answers(spark, d).withColumn("a", A.parse_answer(F.col("raw")))
    return a.select("conv_id", "turn", X.confidence_band(F.col("a.confidence")).alias("band"))


@query
def json_escape_text(spark, d):
    """Request JSON of every report, and whether it reads back as the figures and claims that went in."""
    pages = t.extracted(spark, d)
    requests = au.audit_requests(pages, t.select_from(t.neighbours(spark, d, pages)))
    made = requests.select("document_id", *au.request_columns())
    figure = "array<struct<sample_rank:int,page:int,value:double,unit:string>>"
    claim = "array<struct<claim:string,page:int,target_year:int>>"
    back = F.from_json("claims_json", claim)
    return made.select(
        "document_id", F.size(F.from_json("metrics_json", figure)).alias("figures"), F.size(back).alias("claims"),
        F.array_join(F.transform(back, lambda c: c["claim"]), "; ").alias("named"), F.round(F.aggregate(F.from_json("metrics_json", figure), F.lit(0.0), lambda x, m: x + m["value"]), 4).alias("total"))


# ---------------------------------------------------------------- generators


@query
def scope_metrics_from_text(spark, d):
    return _long(ex.scope_metrics_from_text(report_pages(spark, d)), tx.SCOPE_KINDS)


@query
def scope_metrics_from_tables(spark, d):
    found = ex.scope_metrics_from_tables(report_pages(spark, d))
    return ex.metrics_long(found, tx.SCOPE_KINDS).select("document_id", "page", "kind", "ord", "value", "source")


@query
def generic_metrics(spark, d):
    docs = texts(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("company"),
        F.lit(0).alias("year"), F.lit(1).alias("page"), "text")
    pages = report_pages(spark, d).select("document_id", "company", "year", "page", "text")
    return _long(ex.generic_metrics(docs.unionByName(pages)), ["generic"])


@query
def detect_claims(spark, d):
    return cl.detect_claims(report_pages(spark, d)).select(*PAGE, "keyword_ord", "claim", "target_year", "context")


@query
def semantic_chunks(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))
    return ch.semantic_chunks(docs).select("doc_id", "chunk_index", "content")


@query
def page_chunks(spark, d):
    pages = texts(spark, d, "documents").select("doc_id", "text")
    out = ch.page_chunks(pages, F.lit("documents"))
    return out.select("doc_id", "chunk_index", "content", F.col("metadata")["chunk_size"].cast("long").alias("chunk_size"))


@query
def report_chunks(spark, d):
    out = ch.report_chunks(spread(t.reports(spark, d)), t.extracted(spark, d))
    return out.select("document_id", "page", "chunk_index", "content", F.col("metadata")["type"].alias("type"))


@query
def flatten_claims(spark, d):
    return rp.flatten_claims(t.reports(spark, d)).select("company", "year", "claim", "page", "score")


@query
def audit_fallback(spark, d):
    return t.reports(spark, d).where(F.col("audit_status") != "valid").select(
        "document_id", "audit_status", "ai_summary", "leaf_rating", F.size("claim_reviews").alias("reviews"))


# ---------------------------------------------------------------- vectors and prompts


@query
def embed_chunks(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    vec = em.embed_chunks(docs).select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return vec.where("weight <> 0").select("doc_id", "slot", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query
def embed_queries(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    vec = em.embed_queries(asked).select("conv_id", "turn", F.posexplode("embedding").alias("slot", "weight"))
    return vec.where("weight <> 0").select("conv_id", "turn", "slot", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query
def audit_requests(spark, d):
    pages = t.extracted(spark, d)
    out = au.audit_requests(pages, t.select_from(t.neighbours(spark, d, pages)))
    return out.select(
        "document_id", "company", "year", *[f"{k}_entries" for k in au.REPORT_KINDS],
        F.size("generic_sample").alias("sampled"), F.size("claims").alias("n_claims"), "claims_text")


@query
def rag_context(spark, d):
    return se.rag_context(t.hits(spark, d))


@query
def search_response(spark, d):
    out = se.search_response(t.search_queries(spark, d), t.hits(spark, d, threshold=0.5))
    cited = F.transform("citations", lambda c: F.concat_ws("/", c["company"], c["year"].cast("string"), c["page"].cast("string")))
    return out.select("query_id", "question", "answer", "confidence", "num_sources", joined(cited).alias("citations"))


@query
def pr_at_k_mrr(spark, d):
    return _rounded(_scores(spark, d))


# ---------------------------------------------------------------- streams


def _page_files(spark, d) -> str:
    path = workspace(spark, "pages-in")
    report_pages(spark, d).write.parquet(path)
    return path


def _streamed_extract(spark, d):
    path = workspace(spark, "extracted-out")
    sg.stream_extract(spark, _page_files(spark, d), path, workspace(spark, "ck")).awaitTermination()
    return path


@query
def stream_extract(spark, d):
    out = spark.read.schema(t.extracted_schema(spark, d)).parquet(_streamed_extract(spark, d))
    found = cl.claim_keywords_on_pages(out).groupBy(*PAGE).agg(F.count("*").alias("claims"))
    return out.select(*PAGE, *[F.size(k).alias(f"n_{k}") for k in tx.METRIC_KINDS]).join(found, PAGE)


@query
def stream_audit(spark, d):
    reports = _streamed_reports(spark, d, _streamed_extract(spark, d))[0]
    return rp.list_reports(st.reports_upsert(None, reports))


def _streamed_reports(spark, d, extracted):
    schema = t.extracted_schema(spark, d)
    path = workspace(spark, "reports-out")
    sg.stream_audit(spark, extracted, audit_responses(spark, d), path, workspace(spark, "ck"), schema).awaitTermination()
    return sg.read_batches(spark, path, t.reports_schema(spark, d)), path


@query
def stream_chunks(spark, d):
    schema = t.reports_schema(spark, d)
    extracted = _streamed_extract(spark, d)
    _, reports = _streamed_reports(spark, d, extracted)
    path = workspace(spark, "chunks-out")
    sg.stream_chunks(spark, reports, schema, path, workspace(spark, "ck"), extracted, t.extracted_schema(spark, d)).awaitTermination()
    out = sg.current_chunks(spark, path, "document_id string, page int, chunk_index int, content string, embedding array<float>")
    return out.select("document_id", "page", "chunk_index", "content", F.size("embedding").alias("dim"))


@query
def stream_dedup_uploads(spark, d):
    source = workspace(spark, "uploads-in")
    twice = uploads(spark, d)
    twice.write.mode("append").parquet(source)
    twice.write.mode("append").parquet(source)  # delivered again
    path = workspace(spark, "uploads-out")
    sg.stream_dedup_uploads(spark, source, path, workspace(spark, "ck")).awaitTermination()
    return sg.read_batches(spark, path, "id string, filename string, company string, year int, metadata_source string")
