"""Chat formatting of logged conversations, without the snapshots that longer ones contain.

A log often holds a conversation several times, each time with more turns. Each conversation gets a rolling hash of every prefix of its
turns: the sum of hashes of (place, role, text), kept as two sums of 40 bits, so that prefixes are window sums. A conversation whose whole hash is
another's proper prefix is dropped by an anti-join; of equal conversations the smallest id stays. Kept ones are rendered.

Turns are ordered by turn, role, text; places and prefix sums are taken within chunks of 1,024 turn numbers first, then over the totals of
chunks, so no window holds more than a chunk or a conversation's chunks. A rendered conversation is one row, as it is one training example.
Markers inside a text are broken up (`<|` becomes `< |`), so no turn can forge another.
Defined cases: null roles are written as an empty role, null texts as empty ones (in hashes too, as equals of empty); turns without a conversation id are one
conversation; repeated turns are kept as turns; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlens.session import materialize

CHUNK = 1024
BITS = (1 << 40) - 1


def numbered(turns: DataFrame) -> DataFrame:
    """conv, role, text, place (1 is the first) and the prefix sums a, b."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inner = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inner))
    over_chunks = Window.partitionBy("conv2").orderBy("chunk2").rowsBetween(Window.unboundedPreceding, -1)
    of_chunk = [F.col("conv").alias("conv2"), F.col("chunk").alias("chunk2")]
    sizes = rows.groupBy(*of_chunk).agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(over_chunks), F.lit(0)))
    same = F.col("conv").eqNullSafe(F.col("conv2")) & F.col("chunk").eqNullSafe(F.col("chunk2"))
    rows = rows.join(sizes, same).select("conv", "chunk", "turn", "role", "text", (F.col("k") + F.col("skip")).alias("place"))
    for name, seed in (("a", 1), ("b", 2)):
        rows = rows.withColumn(f"h{name}", F.xxhash64(F.lit(seed), "place", "role", "text").bitwiseAND(F.lit(BITS)))
    rows = materialize(rows, "turns")
    totals = rows.groupBy(*of_chunk).agg(F.sum("ha").alias("sa"), F.sum("hb").alias("sb"))
    for name in ("a", "b"):
        totals = totals.withColumn(f"before_{name}", F.coalesce(F.sum(f"s{name}").over(over_chunks), F.lit(0)))
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ia", F.sum("ha").over(upto)).withColumn("ib", F.sum("hb").over(upto))
    return rows.join(totals, same).select("conv", "place", "role", "text", (F.col("ia") + F.col("before_a")).alias("a"), (F.col("ib") + F.col("before_b")).alias("b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv, n: conversations that no longer one begins with, one of each group of equal ones."""
    whole = prefixes.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("last")).select("conv", F.col("last.place").alias("place"), "last.a", "last.b")
    whole = materialize(whole, "conversations")
    ends = whole.select(F.col("conv").alias("conv2"), F.col("place").alias("n"))
    proper = prefixes.join(ends, F.col("conv").eqNullSafe(F.col("conv2"))).where("place < n").select("place", "a", "b").distinct()
    first = whole.groupBy("place", "a", "b").agg(F.min(F.struct(F.col("conv").isNotNull().alias("given"), "conv")).alias("lowest"))
    return first.join(proper, ["place", "a", "b"], "left_anti").select("lowest.conv", F.col("place").alias("n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of every kept conversation."""
    rows = materialize(numbered(turns), "prefixes")
    kept = materialize(maximal(rows.select("conv", "place", "a", "b")), "kept").withColumnRenamed("conv", "kept_conv")
    own = rows.join(kept, F.col("conv").eqNullSafe(F.col("kept_conv")), "left_semi")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    parts = own.select("conv", F.struct("place", line.alias("line")).alias("part"))
    return parts.groupBy("conv").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts")).select(
        F.col("conv").alias("conv_id"), "n_turns", F.array_join("parts.line", "").alias("text"))
