"""Chunking, search, evaluation, selection and sinks on small tables, and plan checks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlens import taxonomy as tx
from reportlens.functions import text as X
from reportlens.functions.patterns import ignore_case
from reportlens.operators import audit as au
from reportlens.operators import chunks as ch
from reportlens.operators import claims as cl
from reportlens.operators import evaluate as ev
from reportlens.operators import extract as ex
from reportlens.operators import reports as rp
from reportlens.operators import search as se
from reportlens.plans import tables as t
from reportlens.plans.queries import REGISTRY
from reportlens.sources import pages as sp
from reportlens.sources import store as st
from reportlens.sources.derived import report_pages, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fold(sentences, size=500, overlap=100):
    out, open_ = [], []
    for s in sentences:
        if open_ and sum(map(len, open_)) + len(s) > size:
            out.append(" ".join(open_))
            while sum(map(len, open_)) > overlap:
                open_ = open_[1:]
        open_ = open_ + [s]
    return out + ([" ".join(open_)] if open_ else [])


def test_chunks_equal_a_plain_fold(spark):
    rng = random.Random(3)
    docs = [[("w" * rng.randint(1, 260)) + "." for _ in range(rng.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string")
    got = {}
    for r in ch.semantic_chunks(df).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got == {i: fold(d) for i, d in enumerate(docs) if d}


def test_fallback_chunks_only_for_reports_without_chunks(spark):
    claims = "array<struct<claim:string,page:int,target_year:int,context:string>>"
    reviews = "array<struct<claim:string,page:int,score:double,reason:string,citations:array<int>>>"
    reports = spark.createDataFrame(
        [("a", "A", 2024, "", 3.0, [], []), ("b", "B", 2024, "fine", 4.0, [("oil", 1, None, "x")], []),
         ("c", "C", 2024, "", 4.0, [("oil", 2, 2030, "y" * 90)], [("oil", 2, None, "why", [1, 2])])],
        f"document_id string, company string, year int, ai_summary string, leaf_rating double, claims {claims}, claim_reviews {reviews}")
    m = [(1.5, "tCO2e", 1, "s")]
    pages = spark.createDataFrame(
        [(d, d.upper(), 2024, p, m if p != 2 else [], []) for d in "abc" for p in range(1, 8)],
        "document_id string, company string, year int, page int, "
        "scope1 array<struct<value:double,unit:string,page:int,source:string>>, scope2 array<struct<value:double,unit:string,page:int,source:string>>")
    rows = ch.report_chunks(reports, pages).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.page, r.chunk_index) for r in rows] == [
        ("a", 1, 0), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("b", 1, 0), ("c", 2, 1)]
    assert rows[0].content == "Company: A (2024). Scope 1 emissions: 1.50 tCO2e. "
    assert rows[-1].content == ("Company: C (2024) | Sustainability Claim: oil | Target Year: 2030 | Context: " + "y" * 90
                                + " | AI Assessment Score: N/A/5 | Analysis: why | Referenced Pages: 1, 2")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[200:320] = x[7]  # copies: equal scores must be ordered by id
    rows = [(i, f"Company {i % 3}", 2020 + i % 4, i % 9, f"p{i}", x[i].tolist()) for i in range(400)]
    return x, spark.createDataFrame(rows, "chunk_id long, company string, year int, page int, content string, embedding array<float>").repartition(5)


def brute(x, q, keep, k, threshold):
    s = np.round(x.astype(float) @ q / (np.linalg.norm(x.astype(float), axis=1) * np.linalg.norm(q)), 12)
    ids = [i for i in range(len(x)) if keep(i) and s[i] > threshold]
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def test_topk_equals_brute_force(spark, vectors, monkeypatch):
    x, chunks = vectors
    asks = [(j, f"q{j}", c, y, x[7 + j].tolist()) for j, (c, y) in enumerate(
        [(None, None), ("PANY 1", None), (None, 2022), ("company 2", 2021), ("%", None)] * 3)]
    queries = spark.createDataFrame(asks, "query_id long, question string, company string, year int, embedding array<float>")
    want = {}
    for j, _, c, y, e in asks:
        def keep(i): return (c is None or c.lower() in f"company {i % 3}") and (y is None or 2020 + i % 4 == y)
        want[j] = brute(x, np.array(e, dtype=float), keep, 5, 0.1)
    for block, cells in ((16 << 20, 2 << 20), (16 << 20, 150), (16 * 8 * 4, 2 << 20)):
        # one pass; score matrices of ten rows; several passes of four questions
        monkeypatch.setattr(se, "BLOCK_BYTES", block)
        monkeypatch.setattr(se, "MATRIX_CELLS", cells)
        got = {j: [] for j in want}
        for r in se.vector_topk(chunks, queries, 0.1, 5).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.chunk_id)
        assert got == want


def test_capped_search_takes_first_candidates(spark, vectors):
    x, chunks = vectors
    q = spark.createDataFrame([(1, "q", None, None, x[300].tolist())], "query_id long, question string, company string, year int, embedding array<float>")
    got = [r.chunk_id for r in se.vector_topk_capped(chunks, q, 0.0, 5, candidates=100).orderBy("rank").collect()]
    assert got == brute(x[:100], x[300].astype(float), lambda i: True, 5, -1e-9)


def test_lists_find_most_neighbours(spark, sf, tmp_path):
    chunks, queries = t.vector_chunks(spark, sf), t.search_queries(spark, sf)
    exact = {(r.query_id, r.chunk_id) for r in se.vector_topk(chunks, queries, 0.05).collect()}
    indexed, centres = se.build_lists(chunks)
    assert indexed.count() == chunks.count()
    path = str(tmp_path / "lists")
    se.write_lists(indexed, path)
    stored = spark.read.schema(indexed.schema).parquet(path)
    found = se.vector_topk_ivf(stored, centres, queries, nprobe=70, threshold=0.05)
    assert re.search(r"PartitionFilters: \[[^\]]*list_id", plan(found))
    near = {(r.query_id, r.chunk_id) for r in found.collect()}
    assert len(near & exact) / len(exact) >= 0.9
    everything = se.vector_topk_ivf(stored, centres, queries, nprobe=len(centres), threshold=0.05)
    assert {(r.query_id, r.chunk_id) for r in everything.collect()} == exact


JUDGED = [(1, "numeric", [16, 40]), (2, "numeric", [48, 49]), (3, "target", [4, 6, 12]), (4, "target", [21, 23]), (5, "comparative", None)]
FOUND = {1: [16, 16, 16, 15], 2: [49, 49, 48, 48], 3: [6], 4: [21, 4], 5: [1, 2, 3]}


def test_recorded_evaluation(spark):
    judged = spark.createDataFrame(JUDGED, "query_id long, category string, expected_pages array<int>")
    hits = spark.createDataFrame(
        [(q, i + 1, p, f"c{p % 2}") for q, ps in FOUND.items() for i, p in enumerate(ps)],
        "query_id long, rank int, page int, company string")
    s = ev.pr_at_k_mrr(hits, judged)
    rows = {r.query_id: r for r in s.collect()}
    assert [rows[q].precision for q in (1, 2, 3, 4)] == [0.75, 1.0, 1.0, 0.5]
    assert [round(rows[q].recall, 4) for q in (1, 2, 3, 4)] == [1.5, 2.0, 0.3333, 0.5]
    assert all(rows[q].mrr == 1.0 for q in (1, 2, 3, 4))
    o = ev.eval_overall(s).first()
    assert (o.precision, round(o.recall, 4), o.mrr, o.avg_results) == (0.8125, 1.0833, 1.0, 2.75)
    d = ev.eval_diversity(hits, judged).first()
    assert (d.num_results, d.companies_found) == (3, 2)
    distinct = {r.query_id: r.recall for r in ev.pr_at_k_mrr(hits, judged, distinct_pages=True).collect()}
    assert distinct[1] == 0.5 and distinct[2] == 1.0


def test_throughput_upper_median(spark):
    rng = random.Random(5)
    times = [rng.choice([1.0, 1.0, 2.5]) if rng.random() < .4 else round(rng.random() * 50, 3) for _ in range(1000)]
    for n in (0, 1, 2, 7, 1000):
        df = spark.createDataFrame([(v, 4) for v in times[:n]], "total_time double, pages int")
        assert rp.throughput_stats(df).first().median_time == (sorted(times[:n])[n // 2] if n else None)
    for kind in (rng.random, lambda: rng.choice([1.0, 2.0]), lambda: rng.paretovariate(1)):
        many = [kind() for _ in range(40000)]
        df = spark.createDataFrame([(v, 4) for v in many], "total_time double, pages int").repartition(9)
        assert rp.throughput_stats(df).first().median_time == sorted(many)[20000]


def test_metric_sample_is_the_plain_rule(spark):
    rng = random.Random(9)
    docs = {f"d{i}": {p: [float(p * 1000 + j) for j in range(rng.randint(0, 2 * i))] for p in range(1, rng.choice([3, 20, 80]))} for i in range(12)}
    m = "array<struct<value:double,unit:string,page:int,source:string>>"
    df = spark.createDataFrame([(d, p, [(v, "", p, None) for v in vs]) for d, ps in docs.items() for p, vs in ps.items()], f"document_id string, page int, generic {m}")
    got = {}
    for r in au.metric_sample(df).orderBy("document_id", "sample_rank").collect():
        got.setdefault(r.document_id, []).append(r.value)
    for d, ps in docs.items():
        full = {p: vs for p, vs in ps.items() if vs}
        flat = [v for p in sorted(full) for v in full[p]]
        if len(flat) > 50:
            each = max(1, 50 // len(full))
            flat = [v for p in sorted(full) for v in full[p][:each]][:50]
        assert got.get(d, []) == flat


def test_word_boundary_and_unit_options(spark):
    df = spark.createDataFrame([("d", 1, "the soil and direct oil")], "document_id string, page int, text string")
    words = ["oil", "REC"]
    assert [r.claim for r in cl.claim_keywords_on_pages(df, words).collect()] == ["oil", "REC"]
    assert [r.claim for r in cl.claim_keywords_on_pages(df, words, word_boundary=True).collect()] == ["oil"]


def test_json_sink_replaces_only_its_keys(spark, tmp_path):
    path = str(tmp_path / "json")
    def rows(*r): return spark.createDataFrame(list(r), "company string, year int, n int")
    st.extract_json_sink(rows(("A/B C", 2024, 1), ("D", 2024, 2), ("D", 2023, 3)), path)
    st.extract_json_sink(rows(("D", 2024, 9), ("E", 2022, 5)), path)
    back = spark.read.schema("company_key string, year int, n int").json(path).select("company_key", "year", "n")
    assert sorted(map(tuple, back.collect())) == [("A_B_C", 2024, 1), ("D", 2023, 3), ("D", 2024, 9), ("E", 2022, 5)]


def test_json_sink_keeps_columns_and_rows_of_other_runs(spark, tmp_path):
    path = str(tmp_path / "json")
    st.extract_json_sink(spark.createDataFrame([("A", 2024, 1, "note"), ("B", 2024, 2, "b")], "company string, year int, n int, note string"), path, buckets=2)
    for _ in range(2):
        st.extract_json_sink(spark.createDataFrame([("B", 2024, 7)], "company string, year int, n int"), path, buckets=5)
    back = spark.read.schema("company string, year int, n int, note string").json(path).select("company", "year", "n", "note")
    assert sorted(map(tuple, back.collect())) == [("A", 2024, 1, "note"), ("B", 2024, 7, None)]


def test_error_sink_retry_adds_nothing(spark, tmp_path):
    failed = spark.createDataFrame([("d1", "why")], "document_id string, error string")
    for run in ("1", "1", "2"):
        st.error_sink(failed, str(tmp_path), "t", "w", run)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_dedup_of_many_figures_on_a_page(spark):
    import time
    page = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: F.struct(
        (i % 30_000).cast("double").alias("value"), F.lit("t").alias("unit"), i.cast("int").alias("page"), F.lit("s").alias("source"))).alias("m"))
    start = time.time()
    got = page.select(ex.page_metric_dedup(F.col("m")).alias("m")).first().m
    assert time.time() - start < 8 and [m.page for m in got] == list(range(30_000))


def test_vectors_of_other_dimension(spark):
    chunks = spark.createDataFrame([(1, "c", 1, 1, "x", [1.0, 0.0]), (2, "c", 1, 1, "x", [1.0, 0.0, 0.0]), (3, "c", 1, 1, "x", None)],
                                   "chunk_id long, company string, year int, page int, content string, embedding array<float>")
    ask = "query_id long, question string, company string, year int, embedding array<float>"
    one = spark.createDataFrame([(1, "q", None, None, [1.0, 0.0])], ask)
    assert [r.chunk_id for r in se.vector_topk(chunks, one).collect()] == [1]
    assert [(r.chunk_id, r.error) for r in se.other_dimension(chunks, 2).collect()] == [(2, "vector of 3 dimensions instead of 2")]
    with pytest.raises(ValueError):
        se.vector_topk(chunks, one.union(spark.createDataFrame([(2, "q", None, None, [1.0])], ask)))


def test_search_scans_no_text_and_caps_in_one_scan(spark, sf):
    chunks = t.vector_chunks(spark, sf)
    assert "content" not in plan(se.score(chunks, t.search_queries(spark, sf)))
    capped = se.vector_topk_capped(chunks, t.search_queries(spark, sf), 0.05)
    assert len(re.findall(r"\bmapInArrow|MapInArrow", plan(capped))) == 0
    assert "NestedLoop" not in plan(capped) and "Cartesian" not in plan(capped)


def test_links_in_comments_and_scripts(spark):
    html = "<!-- <a href='/old.pdf'>x</a> --><script>'<a href=\"/no.pdf\">'</script><a class=q href='/a&#47;b.pdf?x=1&amp;y=2'>y</a>"
    got = sp.link_extract(spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string")).collect()
    assert [r.link for r in got] == ["http://h.org/a/b.pdf?x=1&y=2"]


def test_json_scan_keeps_broken_rows_apart(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    good, bad = st.extract_json_scan(spark, str(path), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1


def test_upsert_latest_wins(spark):
    df = spark.createDataFrame([("A", 2024, "x", 1), ("A", 2024, "y", 3), ("B", 2024, "z", 2)], "company string, year int, document_id string, processed_at int")
    assert sorted(r.document_id for r in st.reports_upsert(df, df).collect()) == ["y", "z"]


# ---------------------------------------------------------------- plans


def test_no_nested_loop_in_claim_detection(spark, sf):
    p = plan(cl.detect_claims(report_pages(spark, sf)))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_extraction_adds_no_shuffle(spark, sf):
    pages = t.extracted(spark, sf)
    out = au.report_metric_dedup(cl.claim_metrics_choice(cl.detect_claims(pages)).select("*", *[F.col(f"metrics.{k}").alias(k) for k in au.REPORT_KINDS]))
    assert "Exchange" not in plan(out)


def test_rankings_are_limited_before_the_shuffle(spark, sf):
    for df in (t.select_from(t.extracted(spark, sf)), t.hits(spark, sf), rp.latest_report(t.reports(spark, sf)), au.metric_sample(t.extracted(spark, sf))):
        assert re.search(r"WindowGroupLimit.*Partial", plan(df)), plan(df)


def test_year_filter_prunes_partitions(spark, sf, tmp_path):
    path = str(tmp_path / "by_year")
    rp.list_reports(t.reports(spark, sf)).write.partitionBy("year").parquet(path)
    p = plan(spark.read.parquet(path).where(se.year_filter(F.col("year"), 1997)).select("company"))
    assert re.search(r"PartitionFilters: \[isnotnull\(year", p)


def test_scan_reads_only_needed_columns(spark, sf):
    p = plan(table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text"))))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_collect_in_operators():
    from pathlib import Path
    root = Path(__file__).resolve().parents[1] / "reportlens"
    for f in root.rglob("*.py"):
        if "llm" in f.parts:
            continue
        text = f.read_text()
        assert ".toPandas(" not in text and "localCheckpoint" not in text, f
        # Rows that operators collect are bounded: samples of vectors, the pivot table, the manifest.
        assert text.count(".collect(") == {"keyed.py": 3, "pivots.py": 2, "quantise.py": 1}.get(f.name, 0), f


def test_expression_and_model_give_the_same_vectors(spark, sf):
    from reportlens.operators import embed as em
    docs = table(spark, sf, "documents").select(F.col("text").alias("content")).union(spark.createDataFrame([(None,), ("",), ("É !",)], "content string"))
    for dim in (64, 10):
        native = docs.withColumn("embedding", em.hashed_vector(F.col("content"), dim))
        assert "Python" not in plan(native) and "Arrow" not in plan(native)
        assert sorted(map(str, native.collect())) == sorted(map(str, em.embed_chunks(docs, em.hashed_words(dim)).collect()))
    asked = em.embed_queries(docs.withColumnRenamed("content", "question"))
    assert "Python" not in plan(asked) and sorted(map(str, asked.collect())) == sorted(map(str, em.embed_chunks(docs).withColumnRenamed("content", "question").collect()))


def test_scope_patterns_in_lower_case_find_what_patterns_that_ignore_case_find(spark):
    """Capitals, the four letters whose case pair is in ASCII, and words that only fold to a pattern's word."""
    texts = [
        "SCOPE 1: 12 tCO2e. scope two EMISSIONS: 7.5 and İndirect emissions: 8, ındırect emiſsions: 9 indirect",
        "Scope 1 emiſſions: 1,200 Fugitive Emİssions: 4 Total GHG emissions: 31 Total Scopes 1, 2 & 3: 5 Business Travel: emission 6",
        "ſcope 1: 3. Scope 3: ١٢ scope | Scope 2 | 44. FY Scope 1 was as in FY2024: 17 K Stationary  combustion: 6.5", "", "no figure",
    ]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, text string")
    got = {r.page: r for r in ex.scope_metrics_from_text(pages).collect()}
    found = 0
    for kind in tx.SCOPE_KINDS:
        for i, text in enumerate(texts):
            low = text.lower()
            run = [p for literals, p in tx.SCOPE_PATTERNS[kind] if all(w in low for w in literals)]
            row = pages.where(F.col("page") == i).select(*[
                F.regexp_extract_all("text", F.lit(ignore_case(p)), F.lit(1)).alias(str(k)) for k, p in enumerate(run)]).first() if run else []
            want = [float(v.replace(",", "")) for values in row for v in values if v.isascii() and v.strip(",")]
            assert [m.value for m in got[i][kind]] == [v for v in want if v > 0], (kind, i)
            found += len(want)
    assert found > 12


def test_scope_patterns_do_not_run_ignoring_case(spark):
    """A search that ignores case over Unicode tries the pattern at every character."""
    plan = ex.scope_metrics_from_text(spark.createDataFrame([(1, "x")], "page int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_folded" in plan and "(?iu)" not in plan
