"""Secret scan: fixed patterns, and strings that a public vocabulary cannot shorten.

Base kinds are leftmost, non-overlapping matches, from which those that are too short are dropped. The method adds `random`: strings
of STRING whose characters per token under a tiktoken vocabulary are at most RATIO, since natural words and code take 3 to 6 characters a token and
random ones less than 2. Known digests, UUIDs, numbers and identifiers of parts that the vocabulary knows are left out, as is what overlaps a base span.
Places count code points, ends are exclusive.

Strings of fewer than 16 characters are no candidates: the ratio of so few tokens says little.

Defined cases: a null text is empty; a null id is carried along; repeated rows are scanned each; spans of an empty text are ''; spans that begin together are
ordered by kind; other columns are not read, whatever their names; an empty table gives no rows. Texts are scanned whole, one at a time, in
time that grows with their length.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ are maximal, so this finds the same as dropping short ones
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

STRING = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
RATIO = 2.3
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: Words, numbers and names joined by marks. Possessive, so that a failing end is found in linear time.
_WORD = r"(?:[A-Z]?[a-z]++\d{0,4}+|[A-Z]++\d{0,4}+|\d++)"
_IDENTIFIER = re.compile(rf"[+/_-]*+{_WORD}(?:[+/_-]++{_WORD})*+[+/_-]*+")
_CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[A-Z]{2,}(?=[A-Z][a-z]))++\d{0,4}+")
_PART = re.compile(r"[A-Z]?[a-z]++|[A-Z]+(?![a-z])")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def known(string: str) -> bool:
    """Digests and UUIDs, which are public by nature."""
    return bool(len(string) in DIGEST_LENGTHS and _DIGEST.fullmatch(string) or _UUID.fullmatch(string))


def identifier(string: str, encoding) -> bool:
    """Numbers and names whose parts the vocabulary knows: parts of one token, all others with more than RATIO letters a token."""
    if not (_IDENTIFIER.fullmatch(string) or _CAMEL.fullmatch(string)):
        return False
    parts = [(len(p), min(len(encoding.encode_ordinary(x)) for x in (p, p.lower()))) for p in _PART.findall(string)]
    parts = [(n, tokens) for n, tokens in parts if tokens > 1]
    return not parts or sum(n for n, _ in parts) > RATIO * sum(tokens for _, tokens in parts)


def random_spans(text: str, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:
    out = []
    # Base spans in order; the furthest end among those that begin up to each. Strings come in order too.
    starts = sorted(a for a, _, _ in base)
    reach = list(itertools.accumulate((b for _, _, b in sorted(base)), max))
    for m in STRING.finditer(text):
        before = bisect.bisect_left(starts, m.end())
        if known(m[0]) or before and reach[before - 1] > m.start():
            continue
        if len(m[0]) <= RATIO * len(encoding.encode_ordinary(m[0])) and not identifier(m[0], encoding):
            out.append((m.start(), 3, m.end()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; a row per row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, encoding)
                for k in range(3):
                    columns[k].append(sum(kind == k for _, kind, _ in base))
                columns[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                columns[4].append(written(base + more))
                columns[5].append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(columns))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
