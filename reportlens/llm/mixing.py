"""Mixing sources to target weights.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `factor` of all words; a target stops at `limit`
   times its source's size and the excess goes to the others by weight. The level at which this settles has a closed form.
2. Each source's documents fall into a fixed number of blocks by a hash of their id; each pass over a source takes its blocks in another
   permuted order. The quota of a source is the whole blocks that its target holds, pass by pass; blocks that do not fit are left out, and the last BACK are given back.
3. What is still open is filled from copies that are left, in rounds: of the copies no larger than the room, a run of sub-blocks in order
   if there are more than FILL, then of the FILL next ones the choice whose sum is nearest. Rounds end when a source has no such copy or misses less than one part in
   2,000. At last the smallest copy left goes in if that is nearer. So a target is missed by one part in 2,000, or by
   at most half the smallest document that could still be taken.
4. A splitting tree deals the quotas to output shards: at each node the blocks of each source that go left are one multivariate
   hypergeometric draw. A shard walks its own path from the root (nodes are seeded by their number), so all shards agree without talking
   and the counts of shards add up to the quotas exactly. A shard's blocks are a run of its source's permuted order: disjoint by construction.
   Copies of the fill go to the shard of their sub-block.
5. A shard shuffles its own rows.

What reaches the driver is one row per source. Sizes are words `[^\x20\x09-\x0D]+`.
Defined cases: null texts have size 0; null sources are one source; rows that repeat id and text are numbered once and
stored, so that each is drawn for itself; null ids hash like any value; sizes of 0 are never taken; very long texts are measured whole and taken whole or
not at all; other columns pass through `mix` and are not read; an added name that is in use gets an underscore; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlens.llm.names import free
from reportlens.session import materialize

WEIGHTS = (3, 1, 2)
BLOCKS, SUB_BLOCKS, SHARDS = 64, 1024, 32
#: Parts of an output shard that can be dealt to tasks of their own.
PARTS = 4096
#: Copies after the run of sub-blocks that compete for what is left of a target; those of them whose sums are all tried; the share of a target that may be missed.
FILL, TRIED, MISS = 1024, 64, 0.0005
#: Blocks that are given back to the fill.
BACK = 8
#: Words up to which all sums are tried.
SUMS = 1 << 22


def names(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that `drawn` and `mix` add."""
    return {c: free(f"mx_{c}", docs.columns) for c in ("size", "source_size", "target", "draws", "shard", "place")}


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], factor: float = 1.5, limit: int = 2) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    left, heavy = factor * sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    # Sources reach their limit in the order of limit by weight.
    for s in sorted(order, key=lambda s: (limit * sizes[s] / weight[s], s is None, s or "")):
        out[s] = min(float(limit * sizes[s]), weight[s] * (left / heavy))
        if out[s] < limit * sizes[s]:
            level = left / heavy
            rest = [r for r in order if r not in out or r == s]
            return {**out, **{r: weight[r] * level for r in rest}}
        left, heavy = left - limit * sizes[s], heavy - weight[s]
    return out


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def located(docs: DataFrame, seed: int) -> DataFrame:
    """doc (all columns), id, null and name of the source, size, rank: a digest of id and text."""
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs["doc_id"].alias("id"), docs["source"].isNull().alias("null"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("name"), size_of(docs["text"]).alias("size"), _hash(F.lit(seed + 1), docs["doc_id"], docs["text"]).alias("rank"))


def spotted(rows: DataFrame, seed: int) -> DataFrame:
    """Adds block and sub-block of each row; rows that repeat have a `turn` from 0, which sends each its own way."""
    spot = F.when(F.col("turn") < 0, _hash(F.lit(seed), F.col("id"))).otherwise(_hash(F.lit(seed), F.col("id"), F.col("turn")))
    rank = F.when(F.col("turn") < 0, F.col("rank")).otherwise(_hash(F.col("rank"), F.col("turn")))
    return rows.withColumns({
        "block": F.pmod(spot, F.lit(BLOCKS)).cast("int"), "sub": F.pmod(F.shiftright(spot, 20), F.lit(SUB_BLOCKS)).cast("int"), "rank": rank})


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds `turn`: 0, 1, ... within rows of equal `key`. A key with very many rows is numbered by pieces, one for each task that held some."""
    rows = materialize(rows.withColumn("piece", F.spark_partition_id()), "mix-pieces")
    before = Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key, "piece").count().select(*key, "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(*key, "piece").orderBy("size")) - 1
    return rows.withColumn("turn", own).join(starts, [*key, "piece"]).withColumn("turn", F.col("start") + F.col("turn")).drop("start", "piece")


def permuted(seed: int, source: int, turn: int, n: int) -> np.ndarray:
    """Order of the n blocks of a source in one pass."""
    return np.random.default_rng([seed, source, turn]).permutation(n)


@dataclass
class Quota:
    """What a source gives: whole blocks in order, pass by pass; the passes that are left by block; words that still fit."""

    blocks: list[tuple[int, int]]  # (pass, block)
    left: list[list[int]]
    room: float
    rounds: list[tuple[float, int]] = field(default_factory=list)  # of the fill: largest copy, and the last place of its run


def quota(totals: np.ndarray, target: float, seed: int, source: int, limit: int = 2) -> Quota:
    """Whole blocks that fit, pass by pass, but for the last BACK of them: their copies are left to the fill, which finds sums that whole blocks cannot."""
    out, left, room = [], [[] for _ in totals], float(target)
    for turn in range(limit):
        for block in permuted(seed, source, turn, len(totals)).tolist():
            if not totals[block]:
                continue
            if totals[block] <= room:
                out.append((turn, block))
                room -= float(totals[block])
            else:
                left[block].append(turn)
    if any(left):
        for turn, block in out[-BACK:]:
            left[block] = sorted([*left[block], turn])
            room += float(totals[block])
        out = out[:-BACK]
    return Quota(out, left, room)


def nearest_sum(sizes: list[int], room: float, tried: int = TRIED) -> list[int]:
    """Which of `sizes` to take: no more than `room`, all sums of the `tried` smallest considered, larger ones in falling order while they fit."""
    order, took = sorted(range(len(sizes)), key=lambda k: -sizes[k]), []
    left = int(room)
    if sum(sizes) <= left:
        return order
    cut = max(0, len(order) - tried)
    small = order[cut:]
    for k in order[:cut]:
        if sizes[k] <= left:
            took.append(k)
            left -= sizes[k]
    if left > SUMS:
        for k in small:
            if sizes[k] <= left:
                took.append(k)
                left -= sizes[k]
        return took
    mask, reach = (1 << (left + 1)) - 1, [1]
    for k in small:
        reach.append((reach[-1] | (reach[-1] << sizes[k])) & mask)
    at = reach[-1].bit_length() - 1
    for k, before in zip(reversed(small), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            took.append(k)
            at -= sizes[k]
    return took


def split(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `counts` blocks by source, how many go to `shard`, and how many of each source go to the shards before it."""
    counts, before = counts.astype(np.int64), np.zeros(len(counts), np.int64)
    low, high, node = 0, shards, 1
    while high - low > 1:
        middle = (low + high) // 2
        n = int(counts.sum())
        share = n * (middle - low) // (high - low)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, share, method="marginals") if n else counts
        if shard < middle:
            counts, high, node = left, middle, 2 * node
        else:
            counts, before, low, node = counts - left, before + left, middle, 2 * node + 1
    return counts, before


def plan(spark: SparkSession, quotas: list[Quota], shards: int, seed: int) -> DataFrame:
    """source index, pass, block, shard of each whole block; each shard works out its own part of the tree."""
    counts = np.array([len(q.blocks) for q in quotas], np.int64)
    blocks = [np.array(q.blocks, np.int64).reshape(-1, 2) for q in quotas]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"].tolist():
                own, before = split(counts, shards, shard, seed)
                for k in np.flatnonzero(own):
                    b = blocks[k][before[k]: before[k] + own[k]]
                    yield pd.DataFrame({"source": k, "pass": b[:, 0], "block": b[:, 1], "shard": shard})

    return spark.range(shards).mapInPandas(run, "source int, pass int, block int, shard int")


def _place(turn: Column) -> Column:
    """Order of copies within a source."""
    return (turn * BLOCKS + F.col("block")) * SUB_BLOCKS + F.col("sub")


def _within(turn: Column) -> Column:
    """Whether a round's run of sub-blocks holds this copy."""
    return F.exists("rounds", lambda r: (F.col("size") <= r["room"]) & (_place(turn) <= r["last"]))


def filled(light: DataFrame, quotas: list[Quota], keys: list[tuple[bool, str]], aims: list[float]) -> DataFrame:
    """source, rank, turns: copies that fill what whole blocks leave open. Notes the runs of sub-blocks in `quotas`."""
    spark = light.sparkSession
    none = spark.createDataFrame([], "source int, rank long, turn int, size long")
    picks = none

    def copies(over: bool) -> DataFrame:
        state = F.broadcast(spark.createDataFrame(
            [(k, *key, q.left, q.room, q.rounds) for k, (key, q) in enumerate(zip(keys, quotas, strict=True)) if q.room > MISS * aims[k] or over],
            "source int, null boolean, name string, left array<array<int>>, room double, rounds array<struct<room: double, last: bigint>>"))
        fits = F.col("size") > F.col("room") if over else F.col("size") <= F.col("room")
        each = light.join(state, ["null", "name"]).where((F.col("size") > 0) & fits).withColumn("turn", F.explode(F.get("left", F.col("block"))))
        return each.where(~_within(F.col("turn"))).join(picks.select("source", "rank", "turn"), ["source", "rank", "turn"], "left_anti").withColumn("place", _place(F.col("turn")).cast("long"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[nearest_sum(part["size"].tolist(), part["open"].iloc[0])][["source", "rank", "turn", "size"]]

    while any(q.room > MISS * aim for q, aim in zip(quotas, aims, strict=True)):
        each = materialize(copies(False).select("source", "rank", "turn", "size", "place", "room"), "mix-copies")
        upto = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        # A source has at most as many places as blocks, sub-blocks and passes.
        whole = Window.partitionBy("source")
        places = each.groupBy("source", "place", "room").agg(F.sum("size").alias("n"), F.count("*").alias("c")).withColumns(
            {"through": F.sum("n").over(upto), "copies": F.sum("c").over(whole)})
        # No more copies than can compete: all of them do.
        fits = (F.col("through") <= F.col("room")) & (F.col("copies") > FILL)
        run = places.groupBy("source").agg(F.max(F.when(fits, F.col("place"))).alias("last"), F.max(F.when(fits, F.col("through"))).alias("used"))
        found = run.collect()  # a row per source
        if not found:
            break
        ends = F.broadcast(spark.createDataFrame([(r.source, -1 if r.last is None else r.last, r.used or 0) for r in found], "source int, last long, used long"))
        rest = each.join(ends, "source").withColumn("open", F.col("room") - F.col("used")).where("place > last and size <= open")
        order = Window.partitionBy("source").orderBy("place", "rank", "size")
        few = rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FILL)
        chosen = materialize(few.groupBy("source").applyInPandas(choose, none.schema), "mix-fill")
        took = {r.source: r.n for r in chosen.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        for r in found:
            q = quotas[r.source]
            if r.last is not None:
                q.rounds.append((q.room, r.last))
            q.room -= (r.used or 0) + took.get(r.source, 0)
        picks = picks.union(chosen)
    low = copies(True).groupBy("source").agg(F.min(F.struct("size", "place", "rank", "turn")).alias("c"), F.first("room").alias("room"))
    over = low.where("c.size < 2 * room").select("source", "c.rank", "c.turn", "c.size")
    return materialize(picks.union(over).groupBy("source", "rank").agg(F.collect_set("turn").alias("turns")), "mix-picks")


def drawn(docs: DataFrame, shards: int = SHARDS, seed: int = 17, factor: float = 1.5, limit: int = 2) -> DataFrame:
    """The rows of `docs` with mx_size, mx_source_size, mx_target and mx_draws: the (pass, shard) of each time the row is taken."""
    spark, new = docs.sparkSession, names(docs)
    rows = located(docs, seed)
    light = materialize(rows.drop("doc"), "mix-sizes")
    key = ["null", "name", "rank"]
    twice = materialize(light.where("size > 0").groupBy(key).count().where("count > 1").select(key), "mix-repeated")
    if twice.isEmpty():
        rows, light = (spotted(x.withColumn("turn", F.lit(-1)), seed) for x in (rows, light))
    else:
        # Stored once: the number of a repeated row must be the same whenever it is asked for.
        copies = materialize(numbered(rows.join(twice, key, "left_semi"), key), "mix-repeats")
        rows = spotted(rows.join(twice, key, "left_anti").withColumn("turn", F.lit(-1).cast("long")).unionByName(copies), seed)
        light = materialize(rows.drop("doc"), "mix-sizes")
    blocks = light.groupBy("null", "name", "block").agg(F.sum("size").alias("n")).groupBy("null", "name").agg(
        F.collect_list(F.struct("block", "n")).alias("blocks")).collect()  # a row per source, BLOCKS numbers each
    totals = {(r.null, r.name): np.bincount([b.block for b in r.blocks], [b.n for b in r.blocks], BLOCKS).astype(np.int64) for r in blocks}
    keys = sorted(totals)
    sizes = {None if null else name: int(totals[null, name].sum()) for null, name in keys}
    goals = targets(sizes, factor, limit)
    aims = [goals[None if null else name] for null, name in keys]
    quotas = [quota(totals[k], aim, seed, n, limit) for n, (k, aim) in enumerate(zip(keys, aims, strict=True))]
    picks = filled(light, quotas, keys, aims)

    sources = F.broadcast(spark.createDataFrame(
        [(k, *key, int(totals[key].sum()), aims[k], q.left, q.rounds) for k, (key, q) in enumerate(zip(keys, quotas, strict=True))],
        "source int, null boolean, name string, source_size long, target double, left array<array<int>>, rounds array<struct<room: double, last: bigint>>"))
    full = plan(spark, quotas, shards, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("pass").alias("mx_pass"), F.col("shard").alias("mx_shard")))).alias("full"))
    # Both tables are bounded by the number of sources: 64 blocks and FILL copies a round each.
    out = rows.join(sources, ["null", "name"]).join(F.broadcast(materialize(full, "mix-blocks")), ["source", "block"], "left").join(
        F.broadcast(picks), ["source", "rank"], "left")
    runs = F.filter(F.get("left", F.col("block")), _within)
    filling = F.array_sort(F.array_union(runs, F.coalesce("turns", F.array().cast("array<int>"))))
    fill = F.transform(filling, lambda t: F.struct(t.alias("mx_pass"), F.pmod(_hash(F.lit(seed), F.col("block"), F.col("sub"), t), F.lit(shards)).cast("int").alias("mx_shard")))
    no_draw = F.array().cast("array<struct<mx_pass: int, mx_shard: int>>")
    draws = F.when(F.col("size") > 0, F.concat(F.coalesce("full", no_draw), fill)).otherwise(no_draw)
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns), F.col("size").alias(new["size"]), F.col("source_size").alias(new["source_size"]),
                      F.col("target").alias(new["target"]), draws.alias(new["draws"]))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 17, factor: float = 1.5, limit: int = 2) -> DataFrame:
    """The mixed rows with their output shard `mx_shard`, dealt by shard and shuffled within each."""
    new = names(docs)
    rows = drawn(docs, shards, seed, factor, limit)
    rows = rows.select(*(rows[c] for c in docs.columns), F.explode(new["draws"]).alias(new["draws"]))
    draw = rows[new["draws"]]
    rows = rows.select(*(rows[c] for c in docs.columns), draw["mx_shard"].alias(new["shard"]), F.xxhash64(
        F.lit(seed), draw["mx_pass"], draw["mx_shard"], rows["doc_id"]).alias(new["place"]))
    # Shards are cut into parts, so that tasks hold even shares however few or large the shards are.
    return rows.repartition(new["shard"], F.pmod(new["place"], F.lit(PARTS))).sortWithinPartitions(new["shard"], new["place"])
