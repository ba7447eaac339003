"""Each stage on what the one before kept, against definitions written out in Python."""

import re
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_decontaminate import brute as leaks  # noqa: E402
from test_minhash import brute as classes  # noqa: E402
from test_mixing import poured  # noqa: E402

from reportlens.session import materialize  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(3).union(spark.createDataFrame([(None, "no id " * 60, None, None, None), (10**9, None, "en", None, 0), (10**9 + 1, "", None, "src1", 0)], docs.schema))
    docs = docs.union(extra)
    rows = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        rows[name] = docs.collect()
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    key = lambda r: (str(r.doc_id), r.text or "")
    given, good = Counter(map(key, rows["documents"])), Counter(map(key, rows["quality"]))
    assert good <= given
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(quality.get(r.doc_id) == 0 for r in rows["quality"]) <= 1
    kept = {r.doc_id for r in rows["quality"]}
    assert sum(q == 1 and i not in kept for i, q in quality.items()) <= 1

    by_id = {r.doc_id: r for r in sorted(rows["quality"], key=key, reverse=True) if r.doc_id is not None}
    roots = {i: root for i, _, root in classes([(i, r.text) for i, r in by_id.items()], 5, 80, 100)}
    want = Counter(key(r) for i, r in by_id.items() if roots[i] == i) + Counter(key(r) for r in rows["quality"] if r.doc_id is None)
    assert Counter(map(key, rows["near_duplicates"])) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {(str(i), t or "") for i, t, _ in leaks([(r.doc_id, r.text) for r in rows["near_duplicates"]], items)}
    assert Counter(map(key, rows["decontamination"])) == Counter(k for k in map(key, rows["near_duplicates"]) if k not in dirty) and dirty

    size, taken = Counter(), Counter()
    n = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in rows["decontamination"]:
        size[r.source] += n(r)
    for r in rows["mixture"]:
        taken[r.source] += n(r)
    assert max(Counter(map(key, rows["mixture"])).values()) <= 2
    for s, target in poured(size, 1.5 * sum(size.values()), 2).items():
        assert abs(taken[s] - target) <= max(0.04 * target, 3), (s, taken[s], target)

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter((r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows["mixture"])
    assert Counter((r.doc_id, r.n_tokens) for r in rows["token_ids"]) == lengths


def test_run_and_empty(spark, sf, tmp_path):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
