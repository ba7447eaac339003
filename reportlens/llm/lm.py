"""Hashed maximum-entropy language model with class-factored softmax, and the unigram base score.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end token a document. Counts of all training
tokens come from one distributed aggregation. A token is predicted as a leaf: the most frequent words have
leaves of their own, others share leaves by their last letters; in a shared leaf a word has the share (c + 1) / (sum of c + 1, and 1 more).
Leaves are grouped into classes: P(leaf) = P(class | history) P(member | class, history). Features of the history are the bigram (leaf of the
previous word), a skip feature (leaf of the one before) and the hashed pair of both words; each feature is a row of weights.

Training: in each round the tasks take gradient steps (row-wise AdaGrad) on their shares of the documents, from the same weights;
changes are averaged row by row, weighted by how often each task used the row. Every training document is used in one round. There are as many partial
models as slots in the cluster, so what a round shuffles does not grow with the input.
Weights have a fixed size (4.5 MB), as has the table of the HEAD most frequent words that is broadcast; counts of all other words meet their
documents in a shuffled join, so the vocabulary may grow without bound, and no such word is frequent enough to be a hot key.

Defined cases: null and empty texts are one end token; a null id is never held out; repeated rows are scored each and each count in training; without training rows all probabilities are those of
an untrained model; a very long text is one row, handled in steps; words of equal counts are ordered by their hashes; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlens.llm.arrays import U, Words, constants, mix, pieces
from reportlens.session import materialize

HEAD = 1 << 18
CLASSES, MEMBERS = 32, 32
SUFFIXES = 320
OWN = CLASSES * MEMBERS - SUFFIXES
START = CLASSES * MEMBERS  # leaf of what stands before a document
END = U(0x51ED270B9F652295)
PAIRS, NEAR, SKIP = 1 << 13, 1 << 14, 1 << 13
#: First rows of the features: class bias, previous leaf, leaf before it, pair; member bias by class, previous leaf, leaf before it.
ROWS = np.cumsum([0, 1, START + 1, START + 1, PAIRS, CLASSES, NEAR, SKIP]).tolist()
STEP, ROUNDS, RATE = 4096, 3, 0.35
#: Hashes that a task counts at once.
COUNTED = 1 << 21


@dataclass
class Tokens:
    hash: np.ndarray
    suffix: np.ndarray
    first: np.ndarray  # per document, one more at the end


def tokens(w: Words) -> Tokens:
    docs = len(w.first) - 1
    first = w.first + np.arange(docs + 1)
    place = np.arange(len(w.hash)) + w.documents()
    h = np.full(first[-1], END, U)
    h[place] = w.hash
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    suffix = np.zeros(first[-1], np.int64)
    suffix[place] = ((last * 257 + before) * 40503 >> 4) % SUFFIXES
    return Tokens(h, suffix, first)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(train: DataFrame) -> DataFrame:
    """h, c, suffix: how often each token occurs in `train`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate([t.hash for t in held])
            value, at, n = np.unique(h, return_index=True, return_counts=True)
            suffix = np.concatenate([t.suffix for t in held])[at]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(suffix.astype(np.int32))], ["h", "n", "s"])

        for batch in batches:
            for _, _, w in pieces(batch.column("text")):
                held.append(tokens(w))
                if sum(len(t.hash) for t in held) >= COUNTED:
                    yield flush()
        if held:
            yield flush()

    found = train.select("text").mapInArrow(run, "h long, n long, s int")
    return found.groupBy("h").agg(F.sum("n").alias("c"), F.first("s").alias("suffix"))


class Vocabulary:
    """The most frequent tokens, found by open addressing; and the leaves."""

    def __init__(self, h: np.ndarray, c: np.ndarray, mass: np.ndarray):
        order = np.lexsort([h, -c])
        self.h, self.c = h[order], c[order]
        self.own = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), -1)
        self.mass = mass  # of each shared leaf
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(h)))) + 3))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, at, self.probes = np.arange(len(h)), self._home(self.h), 0
        while len(todo):
            free = self.slot[at] < 0
            place, pick = np.unique(at[free], return_index=True)
            self.slot[place] = todo[free][pick]
            placed = self.slot[at] == todo
            todo, at = todo[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each token, -1 if it is not among them."""
        out, at = np.full(len(h), -1, np.int64), self._home(h)
        rest = np.arange(len(h))
        for _ in range(self.probes):
            found = self.slot[at]
            hit = (found >= 0) & (self.h[np.maximum(found, 0)] == h[rest]) if len(self.h) else np.zeros(len(rest), bool)
            out[rest[hit]] = found[hit]
            go = ~hit & (found >= 0)
            rest, at = rest[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(rest):
                break
        return out

    def leaves(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        k = self.find(t.hash)
        own = self.own[np.maximum(k, 0)] if len(self.own) else k
        return k, np.where((k >= 0) & (own >= 0), own, OWN + t.suffix)


def history(t: Tokens, leaf: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of weights for the class and for the member of each token."""
    n = len(leaf)
    place = np.arange(n) - np.repeat(t.first[:-1], np.diff(t.first))
    one, two, h1, h2 = np.full(n, START), np.full(n, START), np.zeros(n, U), np.zeros(n, U)
    one[1:], h1[1:] = leaf[:-1], t.hash[:-1]
    two[2:], h2[2:] = leaf[:-2], t.hash[:-2]
    one[place < 1], h1[place < 1] = START, 0
    two[place < 2], h2[place < 2] = START, 0
    a = constants(41, 4)
    pair = (mix(h1 * a[0] + h2 * a[1]) >> U(51)).astype(np.int64)
    group = leaf // MEMBERS
    near = (mix((one * CLASSES + group).astype(U) * a[2]) >> U(50)).astype(np.int64)
    skip = (mix((two * CLASSES + group).astype(U) * a[3]) >> U(51)).astype(np.int64)
    return ([np.full(n, ROWS[0]), ROWS[1] + one, ROWS[2] + two, ROWS[3] + pair], [ROWS[4] + group, ROWS[5] + near, ROWS[6] + skip])


def _soft(weights: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores, and their sums."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z.sum(axis=1, keepdims=True)


def log10_leaf(weights: np.ndarray, t: Tokens, leaf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(leaf))
    by_class, by_member = history(t, leaf)
    for k in range(0, len(leaf), STEP):
        cut = slice(k, k + STEP)
        row = np.arange(len(leaf[cut]))
        for rows, target in ((by_class, leaf[cut] // MEMBERS), (by_member, leaf[cut] % MEMBERS)):
            z, total = _soft(weights, [r[cut] for r in rows])
            out[cut] += np.log10(np.maximum(z[row, target], 1e-30) / total[:, 0])
    return out


def learn(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, t: Tokens, leaf: np.ndarray) -> None:
    """Gradient steps over one piece, in place."""
    by_class, by_member = history(t, leaf)
    for k in range(0, len(leaf), STEP):
        cut = slice(k, k + STEP)
        row = np.arange(len(leaf[cut]))
        for rows, target in ((by_class, leaf[cut] // MEMBERS), (by_member, leaf[cut] % MEMBERS)):
            own = [r[cut] for r in rows]
            z, total = _soft(weights, own)
            z /= -total
            z[row, target] += 1
            for r in own:
                if r[0] == r[-1] and (r == r[0]).all():
                    at, g, n = r[:1], z.sum(axis=0, keepdims=True), np.array([len(r)])
                else:
                    order = np.argsort(r)
                    edge = np.flatnonzero(np.concatenate([[True], r[order][1:] != r[order][:-1]]))
                    at, g, n = r[order][edge], np.add.reduceat(z[order], edge, axis=0), np.diff(np.append(edge, len(r)))
                squares[at] += (g * g).mean(axis=1)
                weights[at] += (RATE * 0.2 / np.sqrt(squares[at] + 1e-3))[:, None] * g
                used[at] += n


def gradient_round(part: DataFrame, vocabulary, weights: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one round over `part`, and the sums of squares that set the step sizes."""
    spark = part.sparkSession
    start = spark.sparkContext.broadcast((weights, squares))
    names = [f"d{k}" for k in range(MEMBERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, squares = start.value[0], start.value[1].copy()
        own, used = before.copy(), np.zeros(len(before), np.int64)
        for batch in batches:
            for _, _, w in pieces(batch.column("text")):
                t = tokens(w)
                learn(own, squares, used, t, vocabulary.value.leaves(t)[1])
        at = np.flatnonzero(used)
        change = (own[at] - before[at]) * used[at, None]
        grown = (squares[at] - start.value[1][at]) * used[at]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(used[at]), pa.array(grown.astype(np.float32)), *(pa.array(c.astype(np.float32)) for c in change.T)],
                                         ["row", "n", "q", *names])

    # One partial model for each slot of the cluster, whatever the size of the input: a task reads several splits in turn.
    slots = part.select("text").coalesce(max(1, spark.sparkContext.defaultParallelism))
    steps = slots.mapInArrow(run, "row int, n long, q float, " + ", ".join(f"{c} float" for c in names))
    total = steps.groupBy("row").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), *(F.sum(c).alias(c) for c in names)).toArrow()
    start.unpersist()
    at, n = total.column("row").to_numpy(), total.column("n").to_numpy()
    weights, squares = weights.copy(), squares.copy()
    weights[at] += np.column_stack([total.column(c).to_numpy() / n for c in names]).astype(np.float32) if len(at) else 0
    squares[at] += (total.column("q").to_numpy() / n).astype(np.float32) if len(at) else 0
    return weights, squares


def train(docs: DataFrame, counted: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    top = counted.orderBy(F.desc("c"), "h").limit(head).toArrow()
    h, c, s = (top.column(k).to_numpy() for k in ("h", "c", "suffix"))
    mass = np.ones(SUFFIXES)
    for r in counted.groupBy("suffix").agg((F.sum("c") + F.count("*")).alias("m")).collect():  # a row per suffix
        mass[r.suffix] += r.m
    first = np.lexsort([h.view(U), -c])[:OWN]
    np.subtract.at(mass, s[first], c[first] + 1)
    vocabulary = Vocabulary(h.view(U), c, np.maximum(mass, 1))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    weights, squares = np.zeros((ROWS[-1], MEMBERS), np.float32), np.zeros(ROWS[-1], np.float32)
    for k in range(rounds):
        weights, squares = gradient_round(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k), shared, weights, squares)
    return vocabulary, weights


def scores(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`."""
    spark = docs.sparkSession
    rows = _texts(docs)
    training = rows.where(~held_out(F.col("doc_id")))
    counted = materialize(counts(training), "lm-counts")
    vocabulary, weights = train(training, counted, head, rounds)
    n, v = (x or 0 for x in counted.agg(F.sum("c"), F.count("*")).first())
    model = spark.sparkContext.broadcast((vocabulary, weights))
    log_all = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        vocabulary, weights = model.value
        log_c, log_mass, number = np.log10(vocabulary.c + 1.0), np.log10(vocabulary.mass), TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, stop, w in pieces(batch.column("text")):
                t = tokens(w)
                known, leaf = vocabulary.leaves(t)
                in_head, shared = known >= 0, leaf >= OWN
                base = np.zeros(len(leaf))
                base[in_head] = log_c[known[in_head]]
                model_part = log10_leaf(weights, t, leaf)
                model_part[shared] += base[shared] - log_mass[leaf[shared] - OWN]
                size = stop - k
                sums = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every document has a token
                tail = np.flatnonzero(~in_head)
                at = np.searchsorted(tail, t.first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number, number + size)), batch.column("doc_id").slice(k, size), pa.array(np.diff(t.first)), pa.array(sums(in_head.astype(np.int64))),
                    pa.array(sums(base)), pa.array(sums(model_part)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(t.hash[tail].view(np.int64)))],
                    ["k", "doc_id", "n_tokens", "head_known", "head_base", "model", "tail"])
                number += size

    scored = materialize(rows.mapInArrow(run, "k long, doc_id long, n_tokens long, head_known long, head_base double, model double, tail array<long>"), "lm-scored")
    tail = scored.select("k", F.explode("tail").alias("h")).join(counted.select("h", "c"), "h").groupBy("k").agg(
        F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1)).alias("tail_base"))
    known, extra = F.coalesce("tail_known", F.lit(0)), F.coalesce("tail_base", F.lit(0.0))
    return scored.drop("tail").join(tail, "k", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("head_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + extra - F.col("n_tokens") * log_all).alias("base_score"), (F.col("model") + extra).alias("score"))
