import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlens.llm import nearest, whiten

SCHEMA = "vec_id long, embedding array<float>, h string, i int, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, None, 2) for i, v in rows], SCHEMA)


def messy(seed, n=300, d=6):
    """Clusters, copies, scaled copies, repeated ids, null, zero, short and non-finite vectors."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    rows = []
    for k in range(n):
        v = rng.choice(base)
        v = v if k % 3 else [c + rng.gauss(0, 1e-4 if k % 2 else 0.3) for c in v]
        rows.append((k, [float(np.float32(2 * c if k % 7 == 0 else c)) for c in v]))
    rows += [rows[0], rows[10], (10, [1.0] * d), (None, [1.0] * d), (400, None), (450, [0.0] * d), (500, [1.0, None] + [0.0] * (d - 2)), (550, [float("nan")] * d),
             (600, [float("inf")] * d), (650, []), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (750, [-0.0] + [1.0] * (d - 1)), (751, [0.0] + [1.0] * (d - 1)),
             (800, [1e-30] * d), (850, [3e38] * d)]
    return rows


# ---------------------------------------------------------------- whitening

@pytest.mark.parametrize("kind", ["spread", "zero", "equal", "tiny", "close"])
def test_rank_one_update(kind):
    rng = np.random.default_rng(3)
    for _ in range(40):
        d = int(rng.integers(1, 24))
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = np.sort({"spread": rng.random(d), "zero": np.zeros(d), "equal": rng.integers(0, 3, d).astype(float), "tiny": 10.0 ** rng.uniform(-14, 3, d), "close": 1 + 1e-13 * rng.random(d)}[kind])
        for v in (rng.normal(size=d) * 10.0 ** rng.uniform(-8, 2), q[:, 0] * 2, np.zeros(d)):
            want = q @ np.diag(values) @ q.T + np.outer(v, v)
            e, u = whiten.update(values, q, v)
            assert (np.diff(e) >= 0).all()
            assert np.abs(u.T @ u - np.eye(d)).max() < 1e-13
            assert np.abs(u @ np.diag(e) @ u.T - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300)


def test_blocks_merges_and_single_rows_give_one_spectrum():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 8)) * 9).astype(np.int64) + 1_000_000
    x[100:300] = x[100]
    centred = x - x.mean(axis=0)
    want = np.linalg.eigvalsh(centred.T @ centred)
    for sizes in ([500], [1] * 500, [7] * 72, [250, 3, 247]):
        whole, at = whiten.Spectrum.empty(8), 0
        for size in sizes:
            part = whiten.Spectrum.empty(8)
            if len(x[at: at + size]):
                part.block(x[at: at + size])
            whole.merge(part)
            at += size
        assert whole.n == len(x[:at]) and (whole.sums == x[:at].sum(axis=0)).all()
        if at >= 500:
            assert np.allclose(whole.values, want, rtol=1e-11)


def whitened_by_numpy(rows, components=32):
    width = Counter(len(v) for _, v in rows)
    d = max(width, key=lambda k: (width[k], k))
    rows = [(i, v) for i, v in rows if len(v) == d]
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    kept = min(components, int((e > e[0] * 1e-11).sum()))
    return [i for i, _ in rows], ((n * x - s) ** 2).sum(axis=1), c @ u[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


@pytest.mark.parametrize("block", [1, 37, 1 << 14])
def test_whitening(spark, block):
    rows = messy(1)
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 3e7 for c in v)]
    ids, deviation, w, explained = whitened_by_numpy(fine)
    got = whiten.whitened(frame(spark, rows).repartition(24), block=block).collect()
    assert len(got) == w.size and {r.n for r in got} == {len(ids)} and max(r.identity_error for r in got) < 1e-9
    by = Counter((r.vec_id, r.deviation) for r in got if r.component == 1)
    assert by == Counter(zip(ids, deviation.tolist(), strict=True))
    for k in range(w.shape[1]):
        own = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in got if r.component == k + 1)
        for sign in (1, -1):
            want = sorted((-1 if i is None else i, int(d), sign * v) for i, d, v in zip(ids, deviation, w[:, k], strict=True))
            if np.allclose([o[2] for o in own], [o[2] for o in want], atol=1e-6):
                break
        else:
            raise AssertionError(k)
        assert {round(r.explained / explained[k], 9) for r in got if r.component == k + 1} == {1.0}


def test_whitening_edges(spark):
    assert whiten.whitened(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]):
        assert whiten.whitened(frame(spark, rows)).count() == 0  # nothing varies
    line = whiten.whitened(frame(spark, [(k, [k / 4, 0.0, 1.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and {round(r.explained, 9) for r in line} == {1.0}


def test_deviations_stay_exact():
    x = np.array([[0, 1 << 31], [1, 0]], np.int64)
    n, sums = 1 << 20, np.array([5, 1 << 40], np.int64)
    want = [sum((n * v - s) ** 2 for v, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    assert whiten.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want] and None in whiten.deviations(x, n, sums)


# ---------------------------------------------------------------- nearest neighbours

def exact(rows, asks, k):
    """Row by row, every other row."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, x) in enumerate(fine):
        if asks(i):
            near = []
            for b, (j, y) in enumerate(fine):
                if a != b and len(x) == len(y):
                    near.append((-float((x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max())), j))
            out.append((i, near))
    return out


@pytest.mark.parametrize("block_bytes,least", [(1 << 20, 1024), (600, 8)])
def test_nearest(spark, monkeypatch, block_bytes, least):
    monkeypatch.setattr(nearest, "LEAST", least)
    rows = messy(2)
    got = nearest.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, block_bytes).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, lambda i: i % 50 == 0, 5)
    assert Counter(r.query_id for r in got) == sum((Counter({i: min(5, len(near))}) for i, near in want if near), Counter())
    for i in found:
        lists = [sorted(near, key=lambda s: s[0]) for j, near in want if j == i]
        assert len(found[i]) == sum(min(5, len(near)) for near in lists)
        for rank, j, score in found[i]:
            assert any(abs(-near[rank - 1][0] - score) < 1e-12 and any(m == j and abs(s + score) < 1e-12 for s, m in near) for near in lists if len(near) >= rank)
    # Ids of equal vectors come in ascending order, and a row is not its own neighbour unless it repeats.
    zero = [(rank, j) for rank, j, s in sorted(found[0])]
    assert (1, 0) in zero and len([1 for _, j in zero if j == 0]) == 2
    for i, own in found.items():
        own = sorted(own)
        if Counter(r.query_id for r in got)[i] == 5:
            assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(own[:-1], own[1:], strict=True))


def test_nearest_edges(spark):
    assert nearest.search(frame(spark, []), F.col("vec_id") % 50 == 0).columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    same = nearest.search(frame(spark, [(k, [1.0, 2.0]) for k in range(100, -1, -1)]), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in same) == sorted(
        (q, n + 1, j) for q in (0, 50, 100) for n, j in enumerate([j for j in range(7) if j != q][:5])) and {round(r.score, 12) for r in same} == {1.0}


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 48))
    heaps, exact_pairs = nearest.tile(x[:300], list(range(300)), x, [[k] for k in range(4000)], 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, heap in enumerate(heaps):
        s = unit @ unit[k]
        s[k] = -9
        assert [-n for _, n in sorted(heap, reverse=True)] == np.argsort(-s)[:5].tolist()
    assert exact_pairs < 0.03 * 300 * 4000
    q, c = nearest.Side.of(x[:300]), nearest.Side.of(x)
    about = nearest.products(q.code, c.code) * q.scale[:, None] * c.scale
    off = (1 + q.lost)[:, None] * c.lost + q.lost[:, None]
    assert (np.abs(about - unit[:300] @ unit.T) <= off + 1e-6).all()
