import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reportlens.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, sig string, bits int"


def by_deletion(rows):
    """Words, forms and roots by hashing every word with one letter left out."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near, holes = defaultdict(set), defaultdict(list)
    for w in count:
        for k in range(len(w)):
            holes[k, w[:k], w[k + 1:]].append(w)
            v = w[:k] + w[k + 1:]
            if v in count:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= {*group} - {w}
    form = {}
    for w in count:
        if near[w]:
            v = min(near[w], key=lambda v: (-count[v], v))
            if count[v] >= 10 * count[w]:
                form[w] = v

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), count[form[w]] if w in form else None) for w, n in count.items())


def result(spark, rows, **args):
    docs = spark.createDataFrame([(i, t, "w", 1, None, 2) for i, t in rows], SCHEMA)
    got = spelling.variants(docs, **args)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinstéÉ") for _ in range(rng.randint(5, 10))) for _ in range(120)]
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("xae÷×") + w[k:], w[:k] + rng.choice("aeiB") + w[k + 1:]]))
    rows = []
    for i in range(200):
        some = [rng.choice(words[: rng.choice([3, 40, 480])]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.05 else w for w in some)))
    return rows + [(None, "mistake mistake"), (None, None), (5, ""), (7, None), (7, "mistake"), (7, "mistake"), (900, "ab" * 30000 + " " + "ab" * 30000), (900, "ab" * 30000), (901, "×÷" * 4)] + [
        (1000 + k, "spelling " * 100 + "speling " * (k % 3) + "spellingg") for k in range(12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = corpus(seed)
    got = result(spark, rows)
    assert got == by_deletion(rows) and any(r[1] for r in got)


def test_small_blocks_and_other_parts_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    want = by_deletion(rows)
    monkeypatch.setattr(spelling, "BLOCK", 3)
    docs = spark.createDataFrame([(i, t, "w", 1, None, 2) for i, t in rows], SCHEMA)
    words = spelling.counted(docs)
    pairs = sorted(tuple(r) for r in spelling.near_pairs(words, 4, 3).select("a", "b").collect())
    assert len(pairs) == len(set(pairs)) and 2 * len(pairs) == sum(r[4] for r in want)
    assert result(spark, rows, parts=5) == want


def test_chains_reach_their_roots(spark):
    rows = [(10**9 + k, " ".join(["abcdefg"] * a)) for k, a in enumerate([30000])] + [(-1, "abcdefgh " * 2000), (-2, "abcdefghi " * 150), (-3, "abcdefghij " * 12)]
    got, want = result(spark, rows), by_deletion(rows)
    assert got == want and len({r[2] for r in got}) < len(got)


def test_signatures_miss_none():
    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choice("aabcdeiouÿ") for _ in range(rng.randint(7, 14)))
        k = rng.randrange(len(w))
        v = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1:]])
        sigs, bits = spelling.signatures([w, v, "unrelated"], rng.choice([3, 4, 6, 7]))
        assert (sigs[0] == sigs[1]).any() and bin(int(bits[0] ^ bits[1])).count("1") <= 2
        assert len(np.unique(sigs[0])) == sigs.shape[1]


def test_empty(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "short words only")]) == []
