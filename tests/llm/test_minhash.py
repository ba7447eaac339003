import random

import duckdb
import pytest

from reportlens.llm import minhash
from reportlens.llm.oracles import near_duplicates

SCHEMA = "doc_id long, text string, n long, key string, rep long"


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for x in range(len(rows)):
        for y in range(x):
            c = len(sets[x] & sets[y])
            if rows[x][0] is not None and rows[y][0] is not None and c and den * c >= num * (len(sets[x]) + len(sets[y]) - c):
                a, b = find(rows[x][0]), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def sample():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 12, 60, 200]))] for _ in range(40)]
    rows = []
    for k in range(400):
        w = list(base[k % 40] if k % 3 else base[0])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(None, rows[3][1]), (None, None), (900, None), (901, ""), (902, " \n\t"), (7, rows[7][1]), (7, rows[8][1]), (903, "wörd x " * 3000), (904, "WöRD X " * 3000)]
    return rows


@pytest.mark.parametrize(("n", "num", "bands", "rows"), [(3, 85, 25, 5), (5, 80, 32, 4)])
def test_same_as_brute_force(spark, n, num, bands, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    data = sample()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in data], SCHEMA)
    got = minhash.near_duplicates(docs, n, (num, 100), bands, rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, n, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept for r in got if r.doc_id is None)


def test_chain_and_empty(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 150: 100, 200: 100}
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    sql = f"with recursive {near_duplicates('documents', 5, 80, 100)} select doc_id, component_id from classes"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == set(con.execute(sql).fetchall())


def test_representatives_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 1), (1, "a b", 8, 2), (2, "a b c d e f", 9, 3), (None, "a b c d e f", 1, 4)], "doc_id long, text string, nd_turn int, ND_turn_ int")
    got = minhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.nd_turn) for r in got.collect()) == [(0, "a b c d e f", 1), (1, "a b", 8)]
