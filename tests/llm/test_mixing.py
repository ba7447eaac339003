import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from reportlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, mx_note string, size int"


def poured(sizes, total, limit):
    """Targets by pouring again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, out = set(), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(limit * sizes[s] for s in full)
        out = {s: limit * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        over = {s for s in rest if out[s] > limit * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = {rng.choice([None, *"abcdefgh"]): rng.choice([0, 1, 50, 3000]) for _ in range(rng.randrange(1, 8))}
        got = mixing.targets(sizes)
        assert got == pytest.approx(poured(sizes, 1.5 * sum(sizes.values()), 2)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_tree_deals_all_blocks_once():
    counts = np.array([40, 0, 3, 100, 17])
    parts = [mixing.split(counts, 12, k, 5) for k in range(12)]
    assert (sum(own for own, _ in parts) == counts).all()
    at = np.zeros(5, int)
    for own, before in parts:
        assert (before == at).all()
        at += own
    sizes = [own.sum() for own, _ in parts]
    assert max(sizes) - min(sizes) <= 2


def sample():
    rng = random.Random(6)
    rows = [(k, "w " * rng.choice([1, 5, 40, 300]), rng.choice(["s1", "s2", "hot", "hot", "hot", "é", None]), None, 9) for k in range(900)]
    return rows + [(None, "a b c", "s1", "n", 1), (None, None, None, None, None), (2000, None, "s2", None, 1), (2001, "", "s2", None, 1), (5, "w w", "hot", None, 1),
                   (5, "w w", "hot", None, 1), (2002, "long " * 50000, "hot", None, 1), (2003, "", "none", None, 1), (2004, "x", "", None, 1)]


def near(got):
    """Targets are missed by 1 % or half a document: the smallest that is left, or the one that went in last. None exceeds its limit."""
    taken, target, left, drawn = defaultdict(int), {}, defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.mx_draws) <= 2 and len({d.mx_pass for d in r.mx_draws}) == len(r.mx_draws)
        taken[r.source] += r.mx_size * len(r.mx_draws)
        target[r.source] = r.mx_target
        if r.mx_size and len(r.mx_draws) < 2:
            left[r.source].append(r.mx_size)
        if r.mx_draws:
            drawn[r.source].append(r.mx_size)
    for s, t in target.items():
        last = min(left[s], default=0) if taken[s] < t else max(drawn[s], default=0)
        assert abs(taken[s] - t) <= max(0.01 * t, last / 2), (s, taken[s], t, last)
    return taken


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_null_ids_and_repeats_are_drawn_one_by_one(spark):
    rows = [(None, "w " * 100, "a")] * 200 + [(7, "w " * 50, "b")] * 300 + [(k, "w w", "c") for k in range(2000)]
    got = mixing.drawn(rows_of(spark, rows)).collect()
    taken = near(got)
    assert len(got) == len(rows) and abs(taken["a"] - (58500 - 8000) * 3 / 4) <= 50


@pytest.mark.parametrize("rows", [
    [(1, "w " * 2000, "a"), (2, "w " * 300, "b"), (3, "w " * 500, "b"), (4, "w " * 90, "c")],
    [(k, "w " * (3 + k % 5), "a") for k in range(3000)] + [(9999, "w " * 200000, "a"), (10000, "w " * 50000, "b")],
    [(k, "w " * (100_000 if k % 700 == 0 else 20), "abc"[k % 3]) for k in range(3500)],
    [(1, "w", "a"), (2, None, "b"), (3, "", None)],
])
def test_huge_documents_and_small_sources(spark, rows):
    near(mixing.drawn(rows_of(spark, rows)).collect())


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_given_sources(spark, name):
    near(mixing.drawn(spark.read.parquet(f"/root/testdata/{name}/documents.parquet")).collect())


def test_sums():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([1, 7, 50, 333, 2000]) + rng.randrange(5) for _ in range(rng.randrange(1, 14))]
        room = rng.randrange(1, sum(sizes) + 20)
        got = mixing.nearest_sum(sizes, room)
        best = max(s for s in {sum(sizes[k] for k in range(len(sizes)) if m >> k & 1) for m in range(1 << len(sizes))} if s <= room)
        assert len(set(got)) == len(got) and sum(sizes[k] for k in got) == best
    many = [rng.randrange(1, 500) for _ in range(1000)]
    assert 0 <= 40000 - sum(many[k] for k in mixing.nearest_sum(many, 40000)) <= 1
    assert sum([5 << 22, 3 << 22][k] for k in mixing.nearest_sum([5 << 22, 3 << 22], 7 << 22)) == 5 << 22


def test_names_in_use(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", k, "x", 1) for k in range(50)], "doc_id long, text string, source string, mx_size int, Mx_Draws string, size int")
    assert {r.mx_size_ for r in mixing.drawn(docs).collect()} == {3}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mx_shard", "mx_place"] and mixed.count() == 75


def test_mix(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.drawn(docs).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.mx_size == len((r.text or "").split()) and len(r.mx_draws) <= 2
        sizes[r.source] += r.mx_size
        taken[r.source] += r.mx_size * len(r.mx_draws)
        target[r.source] = r.mx_target
        assert len({d.mx_pass for d in r.mx_draws}) == len(r.mx_draws)
    assert {r.source: r.mx_source_size for r in got} == dict(sizes)
    assert target == pytest.approx(poured(sizes, 1.5 * sum(sizes.values()), 2))
    near(got)
    again = mixing.drawn(docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    mixed = mixing.mix(docs).collect()
    assert set(mixed[0].asDict()) == {*docs.columns, "mx_shard", "mx_place"}
    assert Counter((r.doc_id, r.text, r.mx_shard) for r in mixed) == Counter((r.doc_id, r.text, d.mx_shard) for r in got for d in r.mx_draws)
    assert len({r.mx_shard for r in mixed}) > 8


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
