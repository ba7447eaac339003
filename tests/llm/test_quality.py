import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reportlens.llm import docstats, gam, trees
from reportlens.llm.arrays import pieces

SCHEMA = "doc_id long, text string, lang string, score string, x int"


def counts(text):
    """Straight from the definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
    n, marked, seen, dup = Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        if n[x] > 1:
            marked |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é#|\n\n \t\x0b\x85€"), max_size=60)), max_size=6))
def test_counts(texts):
    got = [c for _, _, w in pieces(pa.array(texts, pa.string()), None) for c in docstats.measure(w)[0].tolist()]
    assert got == [counts(t) for t in texts]


def test_counts_of_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, "no id"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "a b c\n" * 40000), (10**9 + 2, "a b c\n" * 40000)], "doc_id long, text string")
    data = docs.select("doc_id", "text").union(extra).selectExpr("doc_id", "text", "1 as kept", "'y' as score")
    forest = trees.train(data, spark.read.parquet(f"{sf}/labels.parquet"))
    got = trees.verdicts(data, forest).collect()
    want = sorted((str(r.doc_id), *counts(r.text)) for r in data.collect())
    assert sorted((str(r.doc_id), *(r[c] for c in docstats.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def accuracy(spark, sf, rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], p) for i, p in rows if i in labels and zlib.crc32(str(i).encode()) % 3 == 1]
    zeros = [p == 0 for q, p in held if q == 0]
    return np.mean([p == q for q, p in held]), np.mean(zeros)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = gam.scores(docs, gam.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right, zeros = accuracy(spark, sf, [(r.doc_id, r.predicted) for r in got])
    assert right > 0.95 and zeros > 0.8, (right, zeros)
    right, zeros = accuracy(spark, sf, [(r.doc_id, int(r.score >= 0.5)) for r in trees.verdicts(docs, trees.train(docs, labels)).collect()])
    assert right > 0.95 and zeros > 0.8, (right, zeros)


def test_monotone_and_flat():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 800) > 0.5).astype(float)
    forest = trees.fit(x, y, np.array([-1, 0, 0]))
    grid = np.repeat(rng.random((40, 3)), 50, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 40)
    z = forest.score(grid).reshape(40, 50)
    assert (np.diff(z, axis=1) <= 1e-12).all() and z.std() > 0.05
    assert np.mean((trees.fit(x, y, np.zeros(3)).score(x) > 0.5) == y) > 0.85


def test_scores_are_table_sums_row_by_row():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((900, 4)), 2)  # many values stand on a cut
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.6)).astype(float)
    model = gam.fit(x, y, rounds=40)
    assert model.pairs
    for row, score in zip(x.tolist(), model.score(x).tolist(), strict=True):
        place = [sum(e < v for e in edges.tolist()) for v, edges in zip(row, model.edges, strict=True)]
        z = model.bias + sum(t[p] for t, p in zip(model.tables, place, strict=True)) + sum(g[place[i], place[j]] for (i, j), g in zip(model.pairs, model.grids, strict=True))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12


def test_flat_trees_are_walked_like_trees():
    rng = np.random.default_rng(6)
    x = np.round(rng.random((700, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    forest = trees.fit(x, y, np.array([1, 0, 0]))

    def value(node, row):
        if forest.left[node] == node:
            return forest.value[node]
        return value(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node], row)
    for row, score in zip(x, forest.score(x).tolist(), strict=True):
        z = forest.bias + sum(value(r, row) for r in forest.root.tolist())
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_accepted_keeps_rows_and_columns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.train(docs, labels)
    odd = spark.createDataFrame([(None, None), (10**9, ""), (10**9, ""), (10**9 + 1, "word " * 200000)], "doc_id long, text string")
    data = docs.select("doc_id", "text").union(odd).selectExpr("doc_id", "text", "1 as score", "'x' as quality", "array(2) as batch")
    good = {(r.doc_id, r.text) for r, s in zip(data.collect(), gam.scores(data, model).collect(), strict=True) if s.score >= 0.5}
    kept = gam.accepted(data, model)
    assert kept.columns == data.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in data.collect() if (r.doc_id, r.text) in good)
    assert gam.accepted(data.limit(0), model).count() == 0


def test_ids_with_several_texts_train_once(spark):
    rows = [(k % 40, f"{'word ' * (k % 7 + 1)}{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    first = docstats.training_rows(docs, labels, "quality", 1000)
    again = docstats.training_rows(docs.repartition(7), labels, "quality", 1000)
    assert len(first[1]) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(40)) and all((a == b).all() for a, b in zip(first, again, strict=True))


def test_pairs_matter():
    rng = np.random.default_rng(4)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (2, 0) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 1), (2, "", "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = gam.scores(docs, gam.train(docs, labels)).collect()
    assert sorted(r.score for r in got) == [0.5] * 4 and sum(r.held_out for r in got if r.doc_id is None) == 0
    assert trees.verdicts(docs, trees.train(docs, labels)).count() == 4
    none = docs.limit(0)
    assert gam.scores(none, gam.train(none, labels)).count() == trees.verdicts(none, trees.train(none, labels)).count() == 0
