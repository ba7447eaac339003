"""Benchmark decontamination with DataFrame functions only.

1. Documents and items become arrays of 64-bit hashes of five-word shingles (lower-cased letters and digits).
2. A window can only be similar to an item if it holds one of its shingles, so runs of shared shingles mark where windows are made:
   the first place of each run, and all item-sized windows that meet the run.
3. Each window gets a SimHash of 63 bits over (shingle, occurrence number) pairs, whose Jaccard similarity is the weighted one of the
   shingles. Items list, for each of 7 blocks of 9 bits, all values within 2 bits; a window within 20 bits of an item has at least one
   block within 2 bits, so looking up its 7 blocks finds every item within the radius, and most others up to FARTHEST bits.
   Lookup rows are a few numbers each; shingles are joined to what passes the distance.
4. Candidates are verified by the weighted similarity of their shingles (sum of minima over sum of maxima of counts).
5. Items of fewer than five words are one run of words each and are found where a document holds that run.

Simulated at the least similarity, for 9 to 400 shingles: 0.006-0.023 % of windows lie beyond the radius, fewer than 3 in a million
are missed. This holds whatever the replaced shingles are, repeats included. Windows around have their own chances.

Defined cases: null and empty texts hold no words and match nothing; a document shorter than an item is one window; null ids are reported as null and told
apart by text_hash; repeated rows are one; ties go to the first window; very long texts are cut into windows only where they share a shingle;
other columns are not read, and pass through `clean` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlens.session import materialize

SHINGLE = 5
LANES, LANE_BITS = 21, 21
BLOCKS, BLOCK_BITS, BLOCK_RADIUS, RADIUS = 7, 9, 2, 20
#: Candidates up to this distance are verified.
FARTHEST = 24
#: A bit in each of the three lanes of a long.
_ONES = 1 | 1 << LANE_BITS | 1 << (2 * LANE_BITS)
#: Rows of a lookup table that are broadcast at most; each is at most five numbers, about 100 bytes in a hash table. Larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_hashes(text: Column, run: int = SHINGLE) -> Column:
    """Hashes of all runs of five words in order; what the last words, which lack followers, give is cut off."""
    # The array is bound once; named in the inner function it would be made anew for each word.
    hashes = F.transform(F.array(_words(text)), lambda v: F.transform(v, lambda w, i: F.xxhash64(w, *(F.get(v, i + k) for k in range(1, run)))))[0]
    return F.transform(F.array(hashes), lambda h: F.slice(h, 1, F.greatest(F.size(h) - (run - 1), F.lit(0))))[0]


def simhash(hashes: Column) -> Column:
    """63-bit SimHash of the (hash, occurrence number) pairs of an array; counts of three bits share a long, 21 bits each.

    The n-th occurrence of a hash has bits of its own, so one that repeats weighs no more than others. Equal hashes follow each other in
    sorted order; the pair of one step is counted in the next."""
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("number"), F.lit(0).cast("long").alias("pair"),
                    *(F.lit(0).cast("long").alias(f"c{k}") for k in range(LANES)))

    def counted(acc: Column) -> list[Column]:
        return [(acc[f"c{k}"] + F.shiftrightunsigned(acc["pair"], k).bitwiseAND(F.lit(_ONES))).alias(f"c{k}") for k in range(LANES)]

    def step(acc: Column, h: Column) -> Column:
        again, number = acc["last"].eqNullSafe(h), acc["number"] + 1
        return F.struct(h.alias("last"), F.when(again, number).otherwise(0).alias("number"),
                        F.when(again, F.xxhash64(h, number)).otherwise(h).alias("pair"), *counted(acc))

    counts = F.aggregate(F.sort_array(hashes), zero, step, lambda acc: F.struct(*counted(acc)))
    return F.transform(F.array(F.struct(counts.alias("c"), F.size(hashes).cast("long").alias("n"))), lambda x: _majority(x["c"], x["n"]))[0]


def _majority(counts: Column, n: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(LANES):
        for lane in range(3):
            count = F.shiftrightunsigned(counts[f"c{k}"], lane * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
            out = out.bitwiseOR(F.when(2 * count > n, F.lit(1 << (k + lane * LANE_BITS))).otherwise(F.lit(0)).cast("long"))
    return out


def _block(fingerprint: Column, block: int) -> Column:
    return F.shiftrightunsigned(fingerprint, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _neighbours() -> list[int]:
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def lookup(df: DataFrame) -> DataFrame:
    """A table to join with: broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def common(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of both counts."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(
        F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (key, item_id, ihs); their shingles (h, the one before, n); items by block (n, block, value, key, fingerprint)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("ihs"))
    items = materialize(items, "items").where(F.size("ihs") > 0).withColumn("n", F.size("ihs"))
    items = materialize(items.withColumns({"ifp": simhash(F.col("ihs")), "key": F.monotonically_increasing_id()}), "items")
    grams = items.select("n", "ihs", F.posexplode("ihs").alias("at", "h")).select(
        "h", F.when(F.col("at") > 0, F.get("ihs", F.col("at") - 1)).alias("before"), "n").distinct()
    keys = items.select("key", "n", "ifp", F.explode(F.array(*(
        F.struct(F.lit(b).alias("block"), _block(F.col("ifp"), b).alias("own")) for b in range(BLOCKS)))).alias("x"))
    keys = keys.select("key", "n", "ifp", F.col("x.block").alias("block"), F.explode(F.transform(
        F.array(*map(F.lit, _neighbours())), lambda m: F.col("x.own").bitwiseXOR(m.cast("long")))).alias("value"))
    return items.select("key", "item_id", "ihs"), grams, keys


def short_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start, similarity: the first place of each item of one to four words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("ws")).where(F.size("ws").between(1, SHINGLE - 1))
    items = materialize(items.select("item_id", F.size("ws").alias("run"), *(F.get("ws", F.lit(k)).alias(f"w{k}") for k in range(SHINGLE - 1))), "short-items")
    found = None
    for run in sorted(r.run for r in items.select("run").distinct().collect()):  # four numbers at most
        own = items.where(F.col("run") == run).select("item_id", F.xxhash64(*(F.col(f"w{k}") for k in range(run))).alias("h")).distinct()
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
        runs = text.select("doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(word_hashes(F.col("t"), run)).alias("start", "h"))
        hits = runs.join(lookup(own), "h").groupBy("doc_id", "text_hash", "item_id").agg(F.min("start").alias("start"), F.lit(1.0).alias("similarity"))
        found = hits if found is None else found.union(hits)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, text_hash, item_id, start (word of the best window), similarity; one row per document and item."""
    num, den = share
    items, grams, keys = item_tables(benchmark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    rows = text.select("doc_id", F.xxhash64("t").alias("text_hash"), word_hashes(F.col("t")).alias("hs"))
    met = rows.select("doc_id", "text_hash", "hs", F.posexplode("hs").alias("pos", "h")).join(lookup(grams), "h")
    leads = met.where((F.col("pos") == 0) | F.col("before").isNull() | (F.get("hs", F.col("pos") - 1) != F.col("before")))
    # All windows of n shingles that meet a run of at most n from here, and the hashes they need.
    size = F.size("hs")
    lowest = F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0))
    highest = F.least(F.col("pos") + F.col("n") - 1, F.greatest(size - F.col("n"), F.lit(0)))
    lowest = F.least(lowest, highest)
    leads = leads.select("doc_id", "text_hash", "n", lowest.alias("low"), highest.alias("high"), F.slice("hs", lowest + 1, highest - lowest + F.col("n")).alias("near"))
    windows = leads.select("doc_id", "text_hash", "n", "low", "near", F.explode(F.sequence("low", "high")).alias("start")).select(
        "doc_id", "text_hash", "n", "start", F.slice("near", F.col("start") - F.col("low") + 1, F.col("n")).alias("whs"))
    marked = windows.withColumn("fp", simhash(F.col("whs")))
    blocks = marked.select("*", F.explode(F.array(*(
        F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)))).alias("x"))
    near = blocks.select("doc_id", "text_hash", "n", "start", "whs", "fp", "x.block", "x.value").join(lookup(keys), ["n", "block", "value"])
    # An item that several blocks find is looked at in the first only.
    first = F.lit(True)
    for b in range(BLOCKS):
        close = F.bit_count(_block(F.col("fp"), b).bitwiseXOR(_block(F.col("ifp"), b))) <= BLOCK_RADIUS
        first &= (F.col("block") <= b) | ~close
    near = near.where(first & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= FARTHEST))
    met = near.select("doc_id", "text_hash", "start", "whs", "key").join(items, "key")
    both = met.select("doc_id", "text_hash", "item_id", "start", common(F.col("whs"), F.col("ihs")).alias("c"), (F.size("whs") + F.size("ihs")).alias("total"))
    hits = both.where(den * F.col("c") >= num * (F.col("total") - F.col("c"))).withColumn("similarity", F.col("c") / (F.col("total") - F.col("c")))
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    out = hits.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.start", "best.similarity")
    short = short_items(docs, benchmark)
    return out if short is None else out.union(short).groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.start", "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` that hold no item."""
    hits = materialize(contaminated(docs, benchmark, share).select(F.col("doc_id").alias("hit_id"), "text_hash").distinct(), "hits")
    same = docs["doc_id"].cast("long").eqNullSafe(hits["hit_id"]) & (F.xxhash64(docs["text"]) == hits["text_hash"])
    return docs.join(hits, same, "left_anti")
