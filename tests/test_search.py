"""Quantised search and pivot pruning against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlens.operators import pivots as pv
from reportlens.operators import quantise as qz
from reportlens.operators import search as se
from reportlens.plans import tables as t
from reportlens.plans.queries import REGISTRY

CHUNKS = "chunk_id long, company string, year int, page int, content string, embedding array<float>"
ASKS = "query_id long, question string, company string, year int, embedding array<float>"


def frame(spark, x, extra=()):
    rows = [(i, f"Company {i % 3}", 2020 + i % 4, i % 9, f"p{i}", v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows + list(extra), CHUNKS).repartition(5)


def asks(spark, x, every=20):
    filters = [(None, None), ("PANY 1", None), (None, 2022), ("company 2", 2021)]
    return spark.createDataFrame([(i, "q", *filters[i // every % 4], x[i].tolist()) for i in range(0, len(x), every)], ASKS)


ODD = [(9001, "C", 2020, 1, "null", None), (9002, "C", 2020, 1, "zero", [0.0] * 16), (9003, "C", 2020, 1, "short", [1.0, 2.0])]


def recall(spark, sf):
    exact = {(r.query_id, r.chunk_id) for r in REGISTRY["vector_topk"](spark, sf).collect()}
    near = [(r.query_id, r.chunk_id, r.similarity) for r in REGISTRY["vector_topk_ivf"](spark, sf).collect()]
    return len({n[:2] for n in near} & exact) / len(exact)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_search_reaches_recall(spark, name):
    sf = f"/root/testdata/{name}"
    assert recall(spark, sf) >= 0.9
    n = t.vector_chunks(spark, sf).count()
    # Codes of all rows, and the vectors of nine chunks a question, against the vectors of all rows.
    assert (n * qz.PARTS + 9 * t.search_queries(spark, sf).count() * 256) / (n * 256) <= 0.2


def test_quantised_search_is_exact_when_all_is_reranked(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[200:320] = x[7]
    chunks, queries = frame(spark, x, ODD), asks(spark, x)
    book = qz.fit_codebook(chunks.where(F.size("embedding") == 16), parts=5, sample=200)
    assert sorted(len(p) for p in book.pieces()) == [3, 3, 3, 3, 4]
    codes = qz.encode(chunks, book)
    assert codes.count() == 400 and codes.columns == ["chunk_id", "company", "year", "code"] and len(codes.first().code) == 5
    found = [tuple(r) for r in qz.vector_topk_quantised(chunks, codes, book, queries, 0.1, 5, rerank=400).orderBy("query_id", "rank").collect()]
    assert found == [tuple(r) for r in se.vector_topk(chunks, queries, 0.1, 5).select(*qz.vector_topk_quantised(chunks, codes, book, queries).columns).orderBy("query_id", "rank").collect()]


def test_tables_are_products_with_what_codes_stand_for():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 10))
    book = qz.Codebook(10, [qz._cluster(x[:, at], 256, 4, rng) for at in np.array_split(np.arange(10), 3)])
    code = book.encode(x)
    back = np.column_stack([c[code[:, k]] for k, c in enumerate(book.centres)])
    q = rng.normal(size=(7, 10))
    tables = book.tables(q)
    assert np.allclose(sum(tables[k][code[:, k]] for k in range(3)).T, q @ back.T, atol=1e-4)
    assert ((x - back) ** 2).sum() < 0.1 * (x ** 2).sum()


def test_empty_tables(spark):
    none = spark.createDataFrame([], CHUNKS)
    x = np.eye(16)
    book = qz.fit_codebook(none, dim=16)
    queries = asks(spark, x, 4)
    assert qz.vector_topk_quantised(none, qz.encode(none, book), book, queries).count() == 0
    full = frame(spark, x)
    book = qz.fit_codebook(full)
    assert qz.vector_topk_quantised(full, qz.encode(full, book), book, queries.limit(0)).count() == 0
    pivots = pv.choose_pivots(none, dim=16)
    celled = pv.assign_cells(none, pivots)
    assert pivots.shape == (0, 16) and pv.pruned_similarity(celled, pv.PivotTable.of(celled, pivots), queries, 0.1).count() == 0


# ---------------------------------------------------------------- pivots


@pytest.mark.parametrize("threshold", [-1.0, 0.2, 0.9, 1.0])
@pytest.mark.parametrize("strict", [True, False])
def test_pruned_pairs_equal_all_pairs(spark, tmp_path, threshold, strict):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 16)) * 0.15
    x[100:130] = x[0]
    x[130] = -x[0]
    chunks, queries = frame(spark, x, ODD), asks(spark, x)
    pivots = pv.choose_pivots(chunks.where(F.size("embedding") == 16), 8)
    path = str(tmp_path / "cells")
    celled = pv.assign_cells(chunks, pivots)
    celled.write.partitionBy("list_id").parquet(path)
    stored = spark.read.schema(celled.schema).parquet(path)
    table = pv.PivotTable.of(stored, pivots)
    assert table.sizes.sum() == 600
    got = sorted(tuple(r) for r in pv.pruned_similarity(stored, table, queries, threshold, strict).collect())
    assert got == sorted(tuple(r) for r in se.query_chunk_similarity(chunks.where(F.size("embedding") == 16), queries, threshold, strict).collect())
    read = pv.probes(table, queries, threshold, 16)
    scored = sum(table.sizes[np.isin(table.cells, sorted(cells))].sum() for cells in read.values())
    share = scored / (600 * len(read))
    if threshold >= 0.9:
        assert share < 0.3  # rows scored fall as the threshold rises
    if threshold < 0:
        assert share == 1


def test_bounds_hold_for_any_pivots():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (1, 3, 20):
        pivots = x[rng.permutation(500)[:n]]
        angle = pv._angles(x, pivots)
        cell = rng.integers(0, 40, 500)
        table = pv.PivotTable(pivots, np.arange(40), np.bincount(cell, minlength=40), np.array([angle[cell == c].min(axis=0) for c in range(40)]), np.array([angle[cell == c].max(axis=0) for c in range(40)]))
        for threshold in (0.0, 0.5, 0.99):
            met = table.met(x[:50], threshold)
            for q, row in zip(x[:50], met, strict=True):
                assert not (x @ q >= threshold)[~row[cell]].any()
