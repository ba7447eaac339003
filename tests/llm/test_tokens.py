import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reportlens.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=5))
def test_blocks_round_trip(docs):
    docs = [np.array(d, np.uint32) for d in docs]
    block = tokens.Block(tokens.pack(docs, 2))
    ids, at = block.all()
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d.tolist() == ids[at[k]: at[k + 1]].tolist()
        for start in range(0, len(d), 3):
            assert block.slice(k, start, min(len(d), start + 5)).tolist() == d[start: start + 5].tolist()


def test_rules_replace_frequent_pairs():
    block = tokens.Block(tokens.pack([np.array([7, 8, 9] * 500, np.uint32)]))
    assert len(block.seq) < 30 and block.length.max() > 50
    with pytest.raises(ValueError):
        tokens.Block(b"none" * 9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab'sl.É1 Ġ\x1c<|>"), max_size=30), max_size=6))
def test_segments_encode_like_whole_texts(texts):
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings():
    texts = ["a <|endoftext|> b<|endoftext|>c <|endoftext|>", "<|endoftext|>"]
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_round_trip(spark, sf, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (10**9, None), (10**9 + 1, ""), (3, "again"), (3, "again"), (10**9 + 2, "long " * 30000)], "doc_id long, text string")
    data = docs.union(odd)
    whole = Tokenizer.from_file(PATH)
    got = tokens.token_table(data.selectExpr("doc_id", "text", "1 as start", "2 as shard", "'x' as payload"), PATH).collect()
    assert len(got) == data.count()
    want = {}
    for r in data.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_empty(spark):
    assert tokens.token_table(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "tion", "é", ".", ",", "#", "'s", " ", "\n", "\0", "\x85", "<|endoftext|>", "1"]), max_size=25).map("".join), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_remembered_once():
    """Marks behind a word and lines do not make other pieces of it."""
    *_, bare, spaced = tokens._tokenizer(PATH)
    bare.clear()
    spaced.clear()
    tokens.encode(["so word, word. word;\nso word! word"], PATH)
    assert set(spaced) == {"word"} and set(bare) == {"so", ",", ".", ";", "\n", "!"}
