"""Token ids in Re-Pair compressed blocks.

Texts are sorted by id over range partitions, encoded, and packed into blocks of consecutive documents. In a
block the most frequent pairs of neighbouring ids are replaced by nonterminals, round by round, until no pair
is frequent. A block holds its rules, the expansion length of each nonterminal, the sequence, and a directory of
its documents, so a document or a range of ids can be decoded without expanding the rest. Pairs never span two documents.

Block format (little endian): magic `RPB1`; counts of documents, rules and symbols (uint32 each) and the base id
from which nonterminals are numbered (uint32); rules as two uint32 arrays (left, right); expansion lengths (uint32);
per document the number of symbols and of ids (uint32 each); width 2 or 4 of a symbol (uint32); the symbols.
Blocks are rows of a Parquet table, so Spark's commit protocol covers lost tasks: (shard, block, payload).

Defined cases: a null text is empty and yields the end id alone; null ids sort first; rows that repeat an id are
ordered by a hash of the text, then the text; a very long text is one document of its block, however large; pairs of equal frequency are taken by their
ids; other columns are not read, whatever their names; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlens.session import workspace

MAGIC = b"RPB1"
#: Ids and documents in a block at most, if its last document ends there.
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 1 << 14
#: Pairs rarer than this in a block are left alone; a rule costs 12 bytes.
MIN_PAIRS = 24
#: Pieces whose ids a worker remembers, new ones that are encoded in one string, and texts that are cut at once.
REMEMBERED, TOGETHER, TEXTS = 1_000_000, 256, 1024
_AFTER, _BEFORE = re.compile(r" (?:\s|\Z)"), re.compile(r"[^\S ] ")
#: Letters and marks between which the pattern always ends a token, and characters that are no white space.
_LETTER, _MARK, _INK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?#&%", "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: What keeps a piece from being encoded in one string with others: white space and special strings.
_apart = re.compile(r"\s|<\|")
_CUTS = ((f"([{_LETTER}])([{_MARK}])", "\\1\0\\2"), (f"([{_INK}])\n([{_INK}])", "\\1\0\n\0\\2"))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    opens = np.array([str(tokenizer.id_to_token(k)).startswith("\u0120") for k in range(tokenizer.get_vocab_size())])
    line = tokenizer.encode("\n", add_special_tokens=False).ids
    # A special string that holds a cut would be torn.
    whole = len(line) != 1 or any(re.search(p, x.content) for x in tokenizer.get_added_tokens_decoder().values() for p, _ in _CUTS)
    return tokenizer, opens, None if whole else line[0], {}, {}


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each entry, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _pieces(segments: pa.Array, whole: bool) -> tuple[np.ndarray, pa.Array]:
    """Segments cut where a token always ends: between a letter and a mark, and around a single line feed. Where the pieces of each begin, and the pieces."""
    if whole:
        return np.arange(len(segments) + 1), segments
    cut = segments
    for pattern, by in _CUTS:
        cut = pc.replace_substring_regex(cut, pattern, by)
    # What holds the separator itself stays whole: it is swapped for an empty string and put back.
    odd = pc.match_substring(segments, "\0")
    lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", segments.type), cut), "\0")
    begin, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    if pc.any(odd).as_py():
        at = np.zeros(len(flat), bool)
        at[begin[:-1][odd.to_numpy(zero_copy_only=False)]] = True
        flat = pc.replace_with_mask(flat, pa.array(at), segments.filter(odd))
    return begin, flat


def _known(pieces: pa.Array, remembered: dict[str, bytes], encode_new) -> tuple[np.ndarray, list[bytes]]:
    """For each piece its place among the distinct ones, and the ids of those as bytes."""
    distinct = pieces.dictionary_encode()
    words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
    fresh = [x for x in words if x not in remembered]
    if fresh:
        remembered.update(zip(fresh, encode_new(fresh), strict=True))
    return distinct.indices.to_numpy().astype(np.int64), list(map(remembered.__getitem__, words))


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text.

    The byte-level pattern never joins what stands before a single space with what follows it, so a text is cut there, its distinct segments
    are cut once more (`_pieces`), and the ids of each piece are remembered. Texts with other runs of white space are encoded whole.
    """
    if not texts:
        return []
    tokenizer, opens, line, bare, spaced = _tokenizer(path)
    if len(bare) + len(spaced) > REMEMBERED:
        bare.clear()
        spaced.clear()

    def split(run: list[str], gap: str, begins) -> Iterator[bytes]:
        """Ids of each of a run of strings, encoded as one text with `gap` before each."""
        runs = [run[k: k + TOGETHER] for k in range(0, len(run), TOGETHER)]
        for own, e in zip(runs, tokenizer.encode_batch_fast([gap + gap.join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            begin = np.flatnonzero(begins(ids))
            if len(begin) != len(own):
                raise ValueError("a token other than a piece's first begins with its gap")
            raw = ids.tobytes()
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
                yield raw[4 * i: 4 * j]

    def after_space(new: list[str]) -> Iterator[bytes]:
        return split(new, " ", lambda ids: opens[ids])

    def alone(new: list[str]) -> list[bytes]:
        # Short pieces without white space or special strings are encoded together, line by line.
        easy = [x for x in new if line is not None and x and not _apart.search(x)]
        found = dict(zip(easy, (x[4:] for x in split(easy, "\n", lambda ids: ids == line)), strict=True))
        rest = [x for x in new if x not in found]
        found.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [found[x] for x in new]

    whole = np.array([text[:1] == " " or bool(_AFTER.search(text) or _BEFORE.search(text)) for text in texts])
    lists = pc.split_pattern(pa.array(["" if w else text for text, w in zip(texts, whole.tolist(), strict=True)], pa.large_string()), " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    later = np.ones(at[-1], bool)
    later[at[:-1]] = False
    # First segments and whole texts begin without a space, all others with one.
    first = pa.array([text if w else text.split(" ", 1)[0] for text, w in zip(texts, whole.tolist(), strict=True)], pa.large_string())
    segments = lists.values.filter(pa.array(later)).dictionary_encode()
    n_first = len(first)
    begin_first, flat_first = _pieces(first, line is None)
    begin, flat = _pieces(segments.dictionary, line is None)
    head = np.zeros(len(flat), bool)
    head[begin[:-1]] = True
    code_head, ids_head = _known(flat.filter(pa.array(head)), spaced, after_space)
    code_bare, ids_bare = _known(pa.concat_arrays([flat_first, flat.filter(pa.array(~head))]), bare, alone)
    # Pieces of the first segments, then of the distinct others; then texts as places of segments, segments as places of pieces.
    code = np.empty(len(flat_first) + len(flat), np.int64)
    code[:len(flat_first)] = code_bare[:len(flat_first)]
    code[len(flat_first):][~head] = code_bare[len(flat_first):]
    code[len(flat_first):][head] = len(ids_bare) + code_head
    known = ids_bare + ids_head
    table, size = np.frombuffer(b"".join(known), np.uint32), np.fromiter(map(len, known), np.int64, len(known)) // 4
    piece_begin = np.concatenate([begin_first[:-1], len(flat_first) + begin[:-1]])
    piece_count = np.concatenate([np.diff(begin_first), np.diff(begin)])
    order = np.empty(at[-1], np.int64)
    order[at[:-1]] = np.arange(n_first)
    order[later] = n_first + segments.indices.to_numpy()
    codes = code[_spans(piece_begin[order], piece_count[order])]
    ids = table[_spans((np.cumsum(size) - size)[codes], size[codes])]
    # Ids up to the end of each segment give those up to the end of each text.
    of_segment = np.add.reduceat(size[code], piece_begin) if len(code) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(of_segment[order])])[at]
    return [ids[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def pack(docs: list[np.ndarray], min_pairs: int = MIN_PAIRS) -> bytes:
    """A block of some documents' ids."""
    ids = np.array([len(d) for d in docs], np.uint32)
    seq = (np.concatenate(docs) if docs else np.zeros(0)).astype(np.uint32)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), ids)
    base = int(seq.max()) + 1 if len(seq) else 0
    lefts, rights, lengths = [], [], np.ones(base, np.uint32)
    recent = 0
    while len(seq) > 1:
        # Pairs without a recent symbol were counted before; when none of the others is frequent, all are counted once more.
        touched = (seq[:-1] >= recent) | (seq[1:] >= recent) if recent else np.ones(len(seq) - 1, bool)
        some = np.flatnonzero(touched & (doc[:-1] == doc[1:]))
        # Pairs and places share one number, so that one plain sort groups them.
        places, symbols = int(len(seq)).bit_length(), (base + sum(map(len, lefts))).bit_length()
        if places + 2 * symbols > 64:
            raise ValueError("block of too many different ids")
        shift, mask = np.uint64(places), np.uint64((1 << places) - 1)
        key = (((seq[some].astype(np.uint64) << np.uint64(symbols)) | seq[some + 1]) << shift) | some.astype(np.uint64)
        key.sort()
        ordered = key >> shift
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(ordered)))
        often = count >= min_pairs
        if not often.any():
            if not recent:
                break
            recent = 0
            continue
        # All frequent pairs of a round at once, the more frequent first where two overlap.
        value = ordered[edge[often]]
        priority = np.empty(len(value), np.int64)
        priority[np.argsort(-count[often], kind="stable")] = np.arange(len(value))
        of = np.full(len(seq), -1, np.int32)
        keep = np.repeat(often, count)
        of[(key[keep] & mask).astype(np.int64)] = np.repeat(np.arange(len(value), dtype=np.int32), count[often])
        hit = np.flatnonzero(of >= 0)
        of = of[hit]
        hit, of = _disjoint(hit, priority[of], of)
        used, rule = np.unique(of, return_inverse=True)
        recent = base + sum(map(len, lefts))
        lefts.append((value[used] >> np.uint64(symbols)).astype(np.uint32))
        rights.append((value[used] & np.uint64((1 << symbols) - 1)).astype(np.uint32))
        lengths = np.append(lengths, lengths[lefts[-1]] + lengths[rights[-1]])
        seq[hit] = (recent + rule).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, doc = seq[stay], doc[stay]
    left = np.concatenate([*lefts, np.zeros(0, np.uint32)]).astype(np.uint32)
    right = np.concatenate([*rights, np.zeros(0, np.uint32)]).astype(np.uint32)
    width = 2 if base + len(left) <= 1 << 16 else 4
    return b"".join([
        MAGIC, struct.pack("<4I", len(docs), len(left), len(seq), base), left.tobytes(), right.tobytes(), lengths[base:].astype(np.uint32).tobytes(),
        np.bincount(doc, minlength=len(docs)).astype(np.uint32).tobytes(), ids.tobytes(), struct.pack("<I", width), seq.astype(f"<u{width}").tobytes()])


def _disjoint(hit: np.ndarray, priority: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places that may overlap by one, those to replace: in a run of neighbours a place goes if it ranks before both; equal ranks go from the left."""
    n = len(hit)
    after = np.zeros(n, bool)
    after[1:] = hit[1:] == hit[:-1] + 1
    same = np.zeros(n, bool)
    same[1:] = after[1:] & (of[1:] == of[:-1])
    # Within a run of one pair (as in a a a a) every second place stays.
    run = np.flatnonzero(~same)
    offset = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    ok = offset % 2 == 0
    before_better, after_better = np.zeros(n, bool), np.zeros(n, bool)
    before_better[1:] = after[1:] & ~same[1:] & (priority[:-1] < priority[1:])
    after_better[:-1] = after[1:] & ~same[1:] & (priority[1:] < priority[:-1])
    # The last place of a run of one pair meets the next run only if it stays itself.
    ok &= ~(before_better | after_better)
    clash = np.zeros(n, bool)
    clash[1:] = after[1:] & ok[1:] & ok[:-1]
    ok &= ~clash
    return hit[ok], of[ok]


class Block:
    """A packed block; documents and ranges of ids are decoded on demand."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.docs, rules, symbols, self.base = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(n: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out
        self.left, self.right, self.length = take(rules), take(rules), take(rules)
        self.symbols, self.ids = take(self.docs), take(self.docs)
        self.seq = take(symbols, f"<u{take(1)[0]}").astype(np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.symbols, dtype=np.int64)])

    @functools.cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all nonterminals end to end, and where each begins. Rules only name earlier symbols."""
        first = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        flat = np.empty(first[-1], np.uint32)
        for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            at = first[k]
            for x in (a, b):
                if x < self.base:
                    flat[at] = x
                    at += 1
                else:
                    n = self.length[x - self.base]
                    flat[at: at + n] = flat[first[x - self.base]: first[x - self.base] + n]
                    at += n
        return flat, first

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        deep = np.flatnonzero(seq >= self.base)
        if not len(deep):
            return seq.astype(np.uint32)
        flat, first = self._flat
        rule = seq[deep] - self.base
        size = np.ones(len(seq), np.int64)
        size[deep] = self.length[rule]
        # Terminals are looked up behind the expansions.
        start = np.arange(len(seq)) + len(flat)
        start[deep] = first[rule]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.concatenate([flat, seq])[at]

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.seq[self.first[k]: self.first[k + 1]])

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k, expanding only the symbols that hold them."""
        own = self.seq[self.first[k]: self.first[k + 1]]
        size = np.where(own >= self.base, self.length[np.maximum(own, self.base) - self.base] if len(self.length) else 1, 1)
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, start, side="right")), int(np.searchsorted(end, stop, side="left")) + 1
        skip = int(end[a - 1]) if a else 0
        return self._expand(own[a:b])[start - skip: stop - skip]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each begins."""
        return self._expand(self.seq), np.concatenate([[0], np.cumsum(self.ids, dtype=np.int64)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, min_pairs: int = MIN_PAIRS) -> str:
    """Write the blocks of `docs` under `path`: shard, block (ascending in id order), doc_ids, payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, block = TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, block
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([pack(held, min_pairs)], pa.binary())], ["shard", "block", "n_ids", "doc_ids", "payload"])
            ids, held, size, block = [], [], 0, block + 1
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts = [x or "" for x in part.column("text").to_numpy(zero_copy_only=False)]
                for doc_id, own in zip(part.column("doc_id").to_pylist(), encode(texts, tokenizer), strict=True):
                    ids.append(doc_id)
                    held.append(np.append(own, np.uint32(end_id)))
                    size += len(own) + 1
                    if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield flush()
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, "shard int, block long, n_ids long, doc_ids array<long>, payload binary").write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard, block, place; decoded from the blocks."""
    blocks = spark.read.schema("shard int, block long, n_ids long, doc_ids array<long>, payload binary").parquet(path)
    # Totals of shards, then of blocks in a shard: no window holds more than the blocks of one shard or one row a shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    places = blocks.select("shard", "block", "n_ids").withColumn("inner", F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    starts = places.join(shards, "shard").select("shard", "block", (F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, doc_ids, payload in zip(*(batch.column(c) for c in ("shard", "block", "doc_ids", "payload")), strict=True):
                block = Block(payload.as_py())
                ids, at = block.all()
                raw = memoryview(ids.astype("<u4").tobytes())
                n = block.docs
                yield pa.RecordBatch.from_arrays([
                    doc_ids.values.cast(pa.int64()), pa.array([shard.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int64()),
                    pa.array(range(n), pa.int32()), pa.array(at[:-1]), pa.array(np.diff(at)),
                    pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())],
                    ["doc_id", "shard", "block", "place", "inner", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(
        run, "doc_id long, shard int, block long, place int, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "place")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write `docs` as blocks into the shared folder and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, workspace(spark, "tokens"), tokenizer, end_id))


