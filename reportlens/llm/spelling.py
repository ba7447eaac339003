"""Spelling variants of words, grouped by PartEnum signatures.

1. Words and their counts over whole texts; some words lose a letter by a fixed rule of document id and word (`noised`).
2. A word is a binary vector: one dimension for each letter and occurrence of it ("level" sets l1 l2 e1 e2 v1). One inserted, deleted or replaced
   letter changes at most two dimensions.
3. Dimensions are dealt into `PARTS` parts by a hash. Vectors at Hamming distance at most two agree on all but two parts, so they share
   a signature: one for each choice of two parts left out, made of the dimensions set in all others. None is missed.
4. Words that share a signature meet in an equi-join, where those at edit distance one pass. Signatures of more than
   `BLOCK` words are dealt into pairs of blocks, so no task takes a whole bucket.
5. A word's form is its near word of largest count, if that is `RATIO` times its own or more; roots follow by pointer doubling,
   in rounds that grow with the logarithm of the longest chain.

Defined cases: null and empty texts hold no words; a null id counts as an empty one; repeated rows count as often as they are there; ties of counts go to
the smaller word in code-point order; very long runs of letters are words like others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reportlens.llm.arrays import U, constants, mix
from reportlens.session import materialize, spread

LETTERS, LEAST = r"A-Za-zÀ-ÿ", 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rate of words that lose a letter; parts of the dimensions; words of a signature that meet in one group; how much more frequent a form is.
EVERY, PARTS, BLOCK, RATIO = 31, 7, 1024, 10


def noised(word: Column, doc_id: Column) -> Column:
    """The word, without one letter if EVERY divides the checksum of id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return F.when(h % EVERY == 0, F.overlay(word, F.lit(""), (h % F.length(word)).cast("int") + 1, F.lit(1))).otherwise(word)


def counted(docs: DataFrame, least: int = LEAST, often: int = 2) -> DataFrame:
    """word, n: words of `least` letters or more that occur `often` times or more."""
    # A run of fewer letters cannot give such a word, and a run is matched whole, as no match can begin inside one.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = each.select("doc_id", low.alias("run")).select(noised(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def signatures(words: list[str], parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, words x choices of two parts left out, and the vectors folded into 64 bits by parity.

    Vectors that differ in two dimensions differ in at most two bits.
    """
    size = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
    at = np.concatenate([[0], np.cumsum(size)])
    order = np.sort((np.repeat(np.arange(len(words), dtype=U), size) << U(32)) | letters)
    begins = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
    turn = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    dimension = mix((order & U(0xFFFFFFFF)) * constants(41, 1) + turn.astype(U) * constants(42, 1))
    part = (dimension >> U(40)) % U(parts)
    value = mix(dimension)
    sums = np.zeros((len(words), parts), U)
    for p in range(parts):
        total = np.concatenate([np.zeros(1, U), np.cumsum(np.where(part == p, value, U(0)), dtype=U)])
        sums[:, p] = total[at[1:]] - total[at[:-1]]
    whole = sums.sum(axis=1, dtype=U)
    choices = list(combinations(range(parts), 2))
    bits = np.bitwise_xor.reduceat(U(1) << (dimension & U(63)), at[:-1]) if len(words) else np.zeros(0, U)
    return np.column_stack([mix((whole - sums[:, a] - sums[:, b]) ^ c) for (a, b), c in zip(choices, constants(43, len(choices)), strict=True)]), bits


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, n, bits, sig: a row per word and signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A piece has a bounded number of letters, but for a longer word of its own.
            size = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy())
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(1 << 18, int(size[-1]) if len(size) else 0, 1 << 18)), [batch.num_rows]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = batch.slice(a, b - a)
                sigs, bits = (x.view(np.int64) for x in signatures(piece.column("word").to_pylist(), parts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, sigs.shape[1], dtype=np.int32)), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("word"), piece.column("n"), pa.array(bits), lists], ["word", "n", "bits", "sigs"])

    return words.mapInArrow(run, "word string, n long, bits long, sigs array<long>").select("word", "n", "bits", F.explode("sigs").alias("sig"))


def near_pairs(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """a, na, b, nb: words at edit distance one, a < b, with their counts."""
    shared = signed(words, parts).withColumn("m", F.count("*").over(Window.partitionBy("sig"))).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    members = materialize(shared.withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int")), "spelling-members")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "sig", "word", "n", "bits", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sides = [dealt.select("sig", "i", "j", *(F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "bits", "own"))) for s in "ab"]
    # Two words of one block meet where i = j only. Vectors are compared first, then letters in their order.
    met = sides[0].join(sides[1], ["sig", "i", "j"]).where(
        (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2) & (F.col("a_word") < F.col("b_word"))
        & ((F.col("i") == F.col("j")) | (F.col("a_own") != F.col("b_own"))) & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("na"), F.col("b_word").alias("b"), F.col("b_n").alias("nb")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form; counts rise along a chain, so there are no rings."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = LEAST, often: int = 2, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(counted(docs, least, often), "spelling-words")
    pairs = near_pairs(spread(words), parts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("v"), F.col("nb").alias("nv")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("v"), F.col("na").alias("nv")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nv")).alias("less"), "v")).alias("top"))
    is_form = -F.col("top.less") >= ratio * F.col("n")
    found = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top.v")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n")),
        "spelling-found")
    return found.join(roots(found.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
