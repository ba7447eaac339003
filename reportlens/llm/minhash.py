"""Near-duplicate classes by MinHash.

1. Each text becomes a set of word shingles, and `bands x rows` universal hash minima of it.
2. Texts with equal sets are one class; only its smallest id goes on.
3. Minima are cut into bands; texts that agree in a band are candidates. Buckets are never expanded into
   all pairs: their most central member is compared with all, then a random member with those that are
   still apart, and only members of different components go on to the last round, where blocks of bounded size
   compare signatures of 512 minima and pass on what can reach the threshold.
4. Every link is confirmed on the full sets.
5. Components come from alternating large-star and small-star.

A pair at the threshold is missed with a chance of (1 - t^rows)^bands: 4e-7 for 0.85 with 25 bands of 5
(5e-5 for 0.80; 5e-8 with 32 bands of 4). The signature test lets pairs down to four standard deviations below the threshold pass.

Defined cases: null or empty texts have no shingles and are linked with nothing; rows with a null id are
left alone (component null, kept); repeated rows share their id's component; very long texts are hashed whole; of documents that could
stand for a component the smallest id does; an empty table gives no rows; other columns are not read, and pass through `representatives` whatever their names.
A bucket that stays open with n members in different components is compared in ceil(n / BLOCK)^2 / 2 groups: exact, and quadratic in such members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlens.llm.arrays import U, constants, mix, pieces, shingles
from reportlens.llm.names import free
from reportlens.session import materialize

#: Members of a bucket that meet in one task in the last round, and the minima that they compare there.
BLOCK, WIDE = 1024, 512
#: Shingles hashed at once.
STEP = 2048


def _signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(U).max, U)
    for k in range(0, len(values), STEP):
        np.minimum(low, (a[:, None] * values[None, k: k + STEP] + b[:, None]).min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, band keys."""
    a, b, band_of = constants(21, bands * rows), constants(22, bands * rows), constants(23, bands)
    turn = constants(24, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, stop, w in pieces(batch.column("text")):
                h, at = shingles(w, words)
                n, d1, d2, keys = [], [], [], []
                for k in range(stop - first):
                    own = np.unique(h[at[k]: at[k + 1]])
                    n.append(len(own))
                    d1.append((own * U(0x9E3779B97F4A7C15) ^ (own >> U(29))).sum(dtype=U))
                    d2.append(mix(own).sum(dtype=U))
                    if len(own):
                        low = _signature(own, a, b)
                        by_band = low.reshape(bands, rows)
                        keys.append(mix((by_band * turn).sum(axis=1, dtype=U) + band_of).view(np.int64))
                    else:
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, stop - first), pa.array(n, pa.int64()), pa.array(np.array(d1, U).view(np.int64)),
                    pa.array(np.array(d2, U).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted 64-bit hashes of its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, stop, w in pieces(batch.column("text")):
                h, at = shingles(w, words)
                sets = [np.unique(h[at[k]: at[k + 1]]).view(np.int64) for k in range(stop - first)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, stop - first), lists], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def wide_signatures(sets: DataFrame) -> DataFrame:
    """rep and one byte of each of WIDE minima: a finer estimate for the few documents whose buckets stay open."""
    a, b = constants(25, WIDE), constants(26, WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [(_signature(x.values.to_numpy().view(U), a, b) >> U(40)).astype(np.uint8).tobytes() for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sig, pa.binary())], ["rep", "sig"])

    return sets.mapInArrow(run, "rep long, sig binary")


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity `share[0] / share[1]`; sets are compared in the JVM, a pair at a time."""
    num, den = share
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
    left, right = (sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s), F.size("shingles").alias(f"n{s}")) for i, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect(x, y))
    both = pairs.join(left, "a").join(right, "b").where(den * F.least(nx, ny) >= num * F.greatest(nx, ny))
    return both.where(den * common >= num * (nx + ny - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root of each linked node, by alternating large-star and small-star; root is the smallest node reachable.

    Neighbourhoods are never collected: a star is a minimum per node and a join, so a hub's rows can be split.
    """
    def star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return e.join(low, "u")

    e = materialize(edges.select("a", "b").where("a <> b"), "edges")
    state: tuple | None = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = star(down)
        small = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            near.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _hub_pairs(members: DataFrame, rank: Column) -> DataFrame:
    """(a, b): each bucket's highest ranked member with its members of other components."""
    hub = members.groupBy("key").agg(F.max_by(F.struct("rep", "root"), rank).alias("hub"))
    met = members.join(hub, "key").where("root <> hub.root")
    return met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _block_pairs(members: DataFrame, reps: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of different components that meet in a bucket and whose signatures can reach the threshold.

    A bucket of n members is dealt into ceil(n / BLOCK) blocks; each pair of blocks is one group. A pair that
    meets in several buckets is passed on in the first only.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    some = sets.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    marked = materialize(reps.select(F.col("doc_id").alias("rep"), "bands").join(wide_signatures(some), "rep"), "minhash-wide")
    spread = members.join(marked, "rep").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", "rep", "root", "bands", "sig", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at, i, j = (x.as_py() for x in key)
        table = table.combine_chunks()
        rep, root, block = (table.column(c).to_numpy() for c in ("rep", "root", "own"))
        sig = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sig")])
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        size = sig.shape[1]
        t = share[0] / share[1]
        least = size * (t + (1 - t) / 256) - 4 * np.sqrt(size * t * (1 - t))
        place = int(np.argmax((bands == at).all(axis=0)))
        a, b = [], []
        for k in range(len(rep)):
            meet = (rep > rep[k]) & (root != root[k]) & ((block != block[k]) if i != j else True)
            meet = np.flatnonzero(meet)
            meet = meet[(sig[meet] == sig[k]).sum(axis=1) >= least]
            meet = meet[~(bands[meet, :place] == bands[k, :place]).any(axis=1)]
            a.append(np.full(len(meet), rep[k]))
            b.append(rep[meet])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    marked = materialize(signatures(docs, words, bands, rows), "minhash")
    linked = marked.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(linked.groupBy("d1", "d2", "n_shingles").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "minhash-classes")
    # A repeated id with another text is one document: its classes share a node.
    each = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(each.join(shared, "key").select("key", "rep", "n"), "minhash-buckets")

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(shingle_sets(text.join(some, "doc_id", "left_semi"), words), "minhash-sets")

    same = linked.select("d1", "d2", "n_shingles", "doc_id").join(
        reps.select("d1", "d2", "n_shingles", F.col("doc_id").alias("rep")), ["d1", "d2", "n_shingles"])
    # An id that stands for several texts joins their classes.
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    edges = same.join(twice, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    central = members.groupBy("rep").agg(F.sum("n").alias("c"))
    open_members = members.join(central, "rep").withColumn("root", F.col("rep"))
    rank = F.struct(F.col("c"), -F.col("rep"))
    edges = materialize(edges.union(confirmed(_hub_pairs(open_members, rank), sets, share)), "minhash-links")
    roots = components(edges)
    for last in (False, True):
        apart = _rooted(members, roots)
        mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        apart = materialize(apart.join(mixed, "key", "left_semi"), "minhash-open")
        pairs = _block_pairs(apart, reps, sets, share) if last else _hub_pairs(apart, F.xxhash64("key", "rep"))
        links = materialize(confirmed(pairs, sets, share), "minhash-links")
        if not links.isEmpty():
            edges = edges.union(links)
            roots = components(edges)

    of_class = same.select("doc_id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "rep")).alias("component_id"))
    return marked.select("doc_id", "n_shingles").join(of_class, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 4) -> DataFrame:
    """The rows of `docs`, with all columns, that stay: one of each class. Of rows that repeat an id the one with the least text stays."""
    found = near_duplicates(docs, words, share, bands, rows).where("doc_id is not null")
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("nd_id")).distinct(), "minhash-dropped")
    twice = materialize(found.where("kept").groupBy(F.col("doc_id").alias("nd_id")).count().where("count > 1").select("nd_id"), "minhash-repeated")
    own = docs["doc_id"].cast("long")
    once = docs.join(dropped, own == dropped["nd_id"], "left_anti").join(twice, own == twice["nd_id"], "left_anti")
    order = Window.partitionBy(docs["doc_id"]).orderBy(docs["text"])
    turn = free("nd_turn", docs.columns)
    first = docs.join(twice, own == twice["nd_id"], "left_semi").withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
    return once.unionByName(first)
