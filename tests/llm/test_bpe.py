"""Forced-boundary encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe
from quern.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = "a s t ' 's 're ve ll Q 1 23 é 漢 😀 \u0301 <|endoftext|> <|endof text|> # .. - word the".split() + [" ", "  ", "\n", "\t", "\u3000", "\x85", "\r\n", "\x00", "\U00010d40"]


def ids_of(texts, limit=bpe.CHUNK):
    out = []
    for _, _, ids, at in bpe.encode_column(bpe.vocabulary(PATH), pa.array(texts, pa.string()), limit):
        out += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def expected(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def oddities(n=3000):
    rnd = random.Random(5)
    return ["".join(rnd.choices(PARTS, k=rnd.randrange(40))) for _ in range(n)] + [None, "", "  " * 400 + "x", "x" * 3000, "ab" * 500 + "'s"]


def test_no_merge_crosses_a_forced_cut():
    vocab = bpe.vocabulary(PATH)
    for token, i in LIBRARY.get_vocab().items():
        b = np.frombuffer(LIBRARY.decode([i], skip_special_tokens=False).encode(), np.uint8)
        assert token in ("<|endoftext|>",) or len(b) < 2 or "\ufffd" in LIBRARY.decode([i]) or vocab.inside[b[:-1], b[1:]].all()
    assert not vocab.inside[ord("e"), ord(" ")] and vocab.inside.mean() < 0.05


@pytest.mark.parametrize("limit", [1 << 20, 3000])
def test_ids_of_oddities(limit):
    texts = oddities()
    assert ids_of(texts, limit) == expected(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    assert ids_of(texts) == expected(texts)


def test_long_texts_are_cut_where_nothing_changes():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(PARTS, k=4000)), "no blank at all " * 3 + "y" * 2000]
    assert ids_of(texts, 200) == expected(texts)


@pytest.mark.parametrize("longest", [4, 1 << 20])
def test_merges_by_heap_and_side_by_side(monkeypatch, longest):
    monkeypatch.setattr(bpe, "LONG", longest)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 300))) for _ in range(50)] + ["aaaaaaa", "=" * 77]
    assert ids_of(texts) == expected(texts)


def test_a_shared_hash_does_not_share_ids(monkeypatch):
    monkeypatch.setattr(bpe.words, "hash_ranges", lambda b, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    texts = oddities(200)
    assert ids_of(texts) == expected(texts)


def test_broken_characters_decode_as_in_the_library():
    rnd = random.Random(4)
    rows = [rnd.choices(range(300), k=rnd.randrange(9)) for _ in range(500)] + [[50256, 60000, -1, 64]]
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    got = bpe._texts(*bpe.vocabulary(PATH).decode(np.concatenate([np.array(r, int) for r in rows]), at)).to_pylist()
    assert got == [LIBRARY.decode([i for i in r if 0 <= i <= 50256], skip_special_tokens=False) for r in rows]


def test_query_against_the_library(spark, sf):
    rows = {r.doc_id: r for r in Q.op12_forced_cuts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d, ids in zip(docs, expected([d.text for d in docs]), strict=True):
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digest)


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a<|endoftext|>", "z"), (2, "b", "b"), (2, "b", "b")], "doc_id long, text string, ids string")
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert out.columns == ["doc_id", "ids", "text"]
    got = sorted(map(repr, ((r.doc_id, r.ids, r.text) for r in out.collect())))
    assert got == sorted(map(repr, [(1, [], ""), (1, [], ""), (None, [64, 50256], "a<|endoftext|>"), (2, [65], "b"), (2, [65], "b")]))
    assert not bpe.encode_documents(docs.limit(0), PATH).collect()
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode_documents(nothing, PATH).collect()] == ["", ""]
