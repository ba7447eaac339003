"""Statistics of whole documents, counted in numpy over Arrow batches; shared by the quality operators.

Null texts count as empty; all shares of an empty text are 0. Letter case is kept: equal lines and equal
windows are equal as written. Very long texts are measured whole, a piece each; repeated rows are measured each; nothing here depends on the order of rows, so
there are no ties; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlens.llm.arrays import U, Words, constants, mix, pieces

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols", "upper", "digits", "punctuation", "not_ascii", "dup_lines", "repeats",
    "distinct_words", "line_words", "bars", "exclamations", "closed_lines", "short_words", "long_words", "longest_word", "top_word",
]


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


SYMBOLS = _flags("#*$%&|<>")
UPPER, DIGITS = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789")
LETTERS = UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
PUNCTUATION = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
CHARACTER = np.array([c & 0xC0 != 0x80 for c in range(256)])  # first bytes of characters


def _per(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the runs that begin at `first`."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line that holds a word."""
    breaks = np.flatnonzero(w.data == 10)
    full = np.flatnonzero(np.diff(w.text_at) > 0)
    doc = np.searchsorted(w.text_at, breaks, side="right") - 1
    more = breaks + 1 < w.text_at[doc + 1]
    start, doc = np.concatenate([w.text_at[full], breaks[more] + 1]), np.concatenate([full, doc[more]])
    end = np.minimum(np.append(breaks, len(w.data))[np.searchsorted(breaks, start)], w.text_at[doc + 1])
    holds = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    return start[holds], end[holds], doc[holds]


def measure(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (documents x 5) and FEATURES (documents x 18)."""
    docs = len(w.first) - 1
    data, at, n = w.data, w.text_at, np.diff(w.first)
    doc = w.documents()
    seed = mix(np.arange(docs, dtype=U) + U(1))
    heads = np.concatenate([[0], np.cumsum(CHARACTER[data], dtype=np.int64)])
    length = heads[w.end] - heads[w.start]
    chars, word_chars = heads[at[1:]] - heads[at[:-1]], _per(w.first, length)

    def share(flags: np.ndarray) -> np.ndarray:
        return _per(at, flags[data])

    symbols, upper = share(SYMBOLS), share(UPPER)
    letters = share(LETTERS)

    factor = constants(31, 3)
    size = max(0, len(w.hash) - 2)
    windows = sum((w.hash[k: k + size] * factor[k] for k in range(3)), np.zeros(size, U))
    place = np.flatnonzero(doc[2:] == doc[:size])
    place = place[_repeated(mix(windows[place]) ^ seed[doc[place]])]
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[place + k] = True
    repeats = _per(w.first, covered)

    start, end, line_doc = _lines(w)
    key = w.spans(start, end) ^ seed[line_doc]
    _, first_seen = np.unique(key, return_index=True)
    lines = np.bincount(line_doc, minlength=docs)
    dup_lines = lines - np.bincount(line_doc[first_seen], minlength=docs)
    last = np.searchsorted(w.end, end, side="right") - 1
    closed = np.bincount(line_doc, weights=PUNCTUATION[data[w.end[last] - 1]], minlength=docs) if len(last) else np.zeros(docs)

    own = w.hash ^ seed[doc]
    order = np.argsort(own)
    edge = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else np.zeros(0, np.int64)
    run, run_doc = np.diff(np.append(edge, len(own))), doc[order][edge]
    distinct = np.bincount(run_doc, minlength=docs)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, run_doc, run)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, length)

    words, characters = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.column_stack([
        np.log1p(n), word_chars / words, symbols / words, upper / np.maximum(letters, 1), share(DIGITS) / characters,
        share(PUNCTUATION) / characters, _per(at, data >= 128) / characters, dup_lines / np.maximum(lines, 1), repeats / words,
        distinct / words, np.log1p(n / np.maximum(lines, 1)), _per(at, data == 124) / words, _per(at, data == 33) / words,
        closed / np.maximum(lines, 1), _per(w.first, length <= 2) / words, _per(w.first, length > 12) / words, np.log1p(longest), top / words])
    return np.column_stack([n, word_chars, symbols, dup_lines, repeats]).astype(np.int64), features


def measured(docs: DataFrame, columns: dict[str, str], result: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """doc_id and what `result` makes of counts and features, a row per row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stop, w in pieces(batch.column("text"), fold=None):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, stop - k), *result(*measure(w))], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{k} {v}" for k, v in {"doc_id": "long", **columns}.items()))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most `bound` labelled rows that are not held out (crc32 of the id mod 3 is 1).

    Which rows: those whose ids hash lowest. `bound` also limits what is broadcast and what reaches the driver.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    rows = measured(some.select("doc_id", "text"), {"x": "array<double>"}, lambda _, x: [pa.array(list(x), pa.list_(pa.float64()))])
    # An id with several texts gives the least of its rows, so there are no more rows than labels.
    labelled = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").toArrow()
    x = labelled.column("x").combine_chunks()
    y = labelled.column("y").to_numpy().astype(np.float64)
    x = np.asarray(x.values if not isinstance(x, pa.ChunkedArray) else pa.concat_arrays(x.chunks).values).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y, labelled.column("doc_id").to_numpy()])
    return x[order], (y[order] > 0).astype(np.float64)


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1
