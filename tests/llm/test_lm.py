import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reportlens.llm import lm
from reportlens.llm.arrays import pieces

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head", [64, lm.HEAD])
def test_base_score(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no Id ÉT"), (10**9, None), (10**9 + 1, ""), (3, "again and"), (3, "again and"), (10**9 + 2, "ab b. " * 200000)], "doc_id long, text string")
    data = docs.union(odd).selectExpr("doc_id", "text", "1 as k", "2 as score", "3 as h")
    rows = [(r.doc_id, words(r.text)) for r in data.collect()]
    c = Counter(w for i, ws in rows if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in rows)
    got = lm.scores(data, head=head).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert [x[5] for x in have] == pytest.approx([x[5] for x in want], rel=1e-9)
    held = [r for r in got if r.held_out]
    # The tiny table holds too few tokens to learn much from; the model is still no worse than the unigram.
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held) * 1.01


def test_better_than_unigram(spark):
    got = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    per_token = [sum(getattr(r, c) for r in got) / sum(r.n_tokens for r in got) for c in ("score", "base_score")]
    assert per_token[0] > per_token[1] + 0.1, per_token


def test_probabilities_add_up():
    t = next(lm.tokens(w) for _, _, w in pieces(pa.array(["a b a c", "", "b"])))
    h, n = np.unique(t.hash, return_counts=True)
    vocabulary = lm.Vocabulary(h, n, np.ones(lm.SUFFIXES))
    known, leaf = vocabulary.leaves(t)
    assert (vocabulary.h[known] == t.hash).all() and (vocabulary.find(np.array([1, 2], np.uint64)) == -1).all()
    weights = np.random.default_rng(1).normal(0, 1, (lm.ROWS[-1], lm.MEMBERS)).astype(np.float32)
    for place in (0, 2, 5):
        total = 0.0
        for x in range(lm.CLASSES * lm.MEMBERS):
            other = leaf.copy()
            other[place] = x
            total += 10 ** lm.log10_leaf(weights, t, other)[place]
        assert total == pytest.approx(1, abs=1e-4)


def test_gradient_step_lowers_loss():
    t = next(lm.tokens(w) for _, _, w in pieces(pa.array(["the cat sat on the mat " * 300])))
    h, n = np.unique(t.hash, return_counts=True)
    vocabulary = lm.Vocabulary(h, n, np.ones(lm.SUFFIXES))
    leaf = vocabulary.leaves(t)[1]
    weights, squares, used = np.zeros((lm.ROWS[-1], lm.MEMBERS), np.float32), np.zeros(lm.ROWS[-1], np.float32), np.zeros(lm.ROWS[-1], np.int64)
    before = lm.log10_leaf(weights, t, leaf).sum()
    for _ in range(20):
        lm.learn(weights, squares, used, t, leaf)
    assert lm.log10_leaf(weights, t, leaf).sum() > before * 0.5


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = lm.scores(spark.createDataFrame([(2, None)], "doc_id long, text string")).collect()
    assert len(only) == 1 and only[0].n_tokens == 1
