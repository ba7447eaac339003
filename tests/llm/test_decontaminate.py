import random
import re
from collections import Counter

from pyspark.sql import functions as F

from reportlens.llm import decontaminate

SCHEMA = "doc_id long, text string, h long, n int, start string"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text):
    w = words_of(text)
    return [tuple(w[k: k + 5]) for k in range(len(w) - 4)]


def brute(rows, items):
    found = {}
    for i, text in rows:
        d = grams(text)
        for item, t in items:
            g = grams(t)
            best = None
            short = words_of(t)
            if 0 < len(short) < 5:
                w = words_of(text)
                best = next(((p, 1.0) for p in range(len(w)) if w[p: p + len(short)] == short), None)
            for p in range(max(0, len(d) - len(g)) + 1) if d and g else []:
                a, b = Counter(d[p: p + len(g)]), Counter(g)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and (best is None or s > best[1]):
                    best = (p, s)
            if best:
                found[(i, text, item)] = best
    return found


def sample():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 24, 40, 41])))) for k in range(12)]
    items += [(50, "too short"), (54, "これは文です"), (55, "one w7 w8 w9"), (51, None), (52, "ba " * 30), (53, " ".join(["one two three four five six"] * 6)), (None, "an item that has no id of its own here")]
    rows = []
    for k in range(170):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 90]))]
        part = items[k % len(items)][1]
        if k % 3 and part:
            part = part.split()
            for _ in range(rng.randrange(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            if k % 7 == 0:
                part = part[: -1 - len(part) // 12]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((k, " ".join(w).replace("w1", "W1") + "."))
    rows += [(None, items[3][1]), (None, items[4][1]), (300, None), (301, ""), (302, "ba " * 5000), (303, items[2][1]), (303, items[2][1]), (303, "no"), (304, "it is Too  short, too short."), (305, "too"), (306, "これは文です too")]
    return rows, items


def test_same_as_brute_force(spark):
    rows, items = sample()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark).withColumn("similarity", F.round("similarity", 9)).collect()
    want = brute(rows, items)
    assert len(got) == len(want) > 25
    assert Counter((r.doc_id, r.item_id, r.start, r.similarity) for r in got) == Counter((i, item, p, round(s, 9)) for (i, _, item), (p, s) in want.items())
    dirty = {(i, t) for i, t, _ in want}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in rows if (i, t) not in dirty)


def test_copies_padded_by_one_word(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(404))) for k in range(20)]
    rows = [(k, " ".join(t.split()[:-43] + ["zero"] * 43), 1, 2, "x") for k, t in items]
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start) for r in got} == {(k, k, 0) for k, _ in items}
    assert all(r.similarity == 357 / 443 for r in got)


def test_many_items_by_narrow_rows(spark):
    """5,000 items: lookup rows are numbers, beyond what is broadcast, and find the same."""
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(24 + k % 3))) for k in range(5000)]
    rows = [(k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(30)) + " " + items[k * 37][1], 1, 2, "x") for k in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    _, _, keys = decontaminate.item_tables(benchmark)
    assert {t for _, t in keys.dtypes} <= {"bigint", "int"} and keys.count() == 5000 * 7 * 46
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), benchmark)
    assert {(r.doc_id, r.item_id, r.start) for r in got.collect()} == {(k, k * 37, 30) for k in range(60)}


def test_radius_is_covered():
    rng = random.Random(1)
    masks = set(decontaminate._neighbours())
    for _ in range(500):
        flips = rng.sample(range(63), decontaminate.RADIUS)
        assert any(sum(1 << (f % 9) for f in flips if f // 9 == b) in masks for b in range(7))


def test_native_and_empty(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontaminate.contaminated(docs, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
