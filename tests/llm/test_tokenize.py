import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import bpe, scan, tokenize
from stratalog.llm.bpe import PairIndexBPE, Vocabulary
from stratalog.llm.tokenize import decode, BYTE_BPE_50K, encode

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return PairIndexBPE(Vocabulary(BYTE_BPE_50K))


def ids(coder, texts):
    return [x for part in coder.encode(pa.array(texts, pa.string())) for x in part.to_pylist()]


AWKWARD = [
    None, "", " ", "  ", "\n", "\r\n", " \n \n", "a", "'s", "'", "''s", "it's we'll they're I'm he'd 'tis rock'n'roll 'S 'LL", "'sx've''re", "x  y   z", "a b", "  a", "a　 b  c", "  'll",
    "日本語 の 文章。", "½ ² №5 ٣", "é ﬁ ß İ", "🙂🙂 👩‍👩‍👧", "<|endoftext|> x", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 500, "=" * 3000, " " * 3000 + "x", "\n" * 777, "﻿​­", "1234567 89", "a1b2 c_d-e",
]


def test_awkward_texts(coder, reference):
    assert ids(coder, AWKWARD) == [reference.encode_ordinary(x or "") for x in AWKWARD]


def test_texts_do_not_touch(coder, reference):
    """A text's end is an end, whatever follows it in the batch."""
    parts = ["it", "'s", " ", " a", "a", " ", "", "\n", "b", None, "'", "re"]
    assert ids(coder, parts) == [reference.encode_ordinary(x or "") for x in parts]


LETTERS = st.sampled_from(list("aAzé'sdltrevm 019 \n\r\t.,-=/+_ßñ日の 　½🙂́"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(LETTERS, max_size=60), st.text(max_size=30)), max_size=8))
def test_any_text(coder, reference, texts):
    assert ids(coder, texts) == [reference.encode_ordinary(x) for x in texts]


def test_small_chunks_and_forgetting(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 200)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "REMEMBER", 30)
    r = random.Random(1)
    texts = [r.choice([None, "", *("".join(r.choice("abcdef 'st\n1") for _ in range(r.randrange(120))) for _ in range(3))]) for _ in range(200)]
    assert ids(coder, texts) == [reference.encode_ordinary(x or "") for x in texts]


def test_every_token_is_reached(coder):
    """Each token's own bytes, as far as they are one word, encode to it: the index merges as the vocabulary was made."""
    v = coder.v
    signs = {s: i for i, s in enumerate(bpe.byte_signs())}
    raws = {}
    for left, right, made in zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), strict=True):
        for x in (left, right):
            if x not in raws:
                raws[x] = bytes([int(np.flatnonzero(v.of_byte == x)[0])])
        raws[made] = raws[left] + raws[right]
    toks = sorted(raws)
    off = np.cumsum([0, *(len(raws[t]) for t in toks)])
    got, at = coder.merge(np.frombuffer(b"".join(raws[t] for t in toks), np.uint8), off)
    assert len(signs) == 256 and len(got) == len(toks) and got.tolist() == toks and at.tolist() == list(range(len(toks) + 1))


def test_colliding_identities(coder, reference, monkeypatch):
    """Words that share the first half of their identity are still told apart by the second."""
    true = scan.identities
    monkeypatch.setattr(bpe, "identities", lambda *a: (true(*a)[0] & np.uint64(0x3), true(*a)[0]))
    e = PairIndexBPE(coder.v)
    texts = ["the quick brown fox jumps over the lazy dog again and again", "the lazy dog sleeps"]
    assert ids(e, texts) == [reference.encode_ordinary(x) for x in texts]


def test_words_table_grows():
    w = scan.Words(4)
    r = np.random.default_rng(0)
    k, k2 = r.integers(0, 1 << 62, 5000).astype(np.uint64), np.zeros(5000, np.uint64)
    k = np.unique(k)
    a = w.add(k[:10], k2[:10])
    b = w.add(k[10:], k2[10 : len(k)])
    assert w.find(k, k2[: len(k)]).tolist() == [*a.tolist(), *b.tolist()]
    assert (w.find(k + np.uint64(1 << 63), k2[: len(k)]) == -1).all()


def test_encode_frame(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(AWKWARD)] + [(7, "again", None)] * 3 + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string").repartition(3)
    out = encode(df, "text")
    assert out.columns == ["doc_id", "text", "ids"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.ids == reference.encode_ordinary(r.text or "") for r in got)
    same = encode(df, "text", out="text")
    assert same.columns == ["doc_id", "ids", "text"] and same.where("doc_id = 0").first().text == []
    assert encode(df.limit(0), "text").count() == 0


def test_one_very_long_text(coder, reference):
    r = random.Random(2)
    t = "".join(r.choice(["word ", "Ünï ", "12 ", "\n\n", "x" * 50, "...", "'ll "]) for _ in range(300_000))
    assert ids(coder, [t]) == [reference.encode_ordinary(t)]


@pytest.mark.parametrize("at_once", [1, 4, 1 << 18])
def test_decoding_gives_the_text_back(spark, monkeypatch, at_once):
    monkeypatch.setattr(tokenize, "DECODED", at_once)
    texts = ["plain words, 1234", "", None, "日本語 \U0001f600 İ\u0301", "\r\n\t  x", "a" * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, text string")
    back = decode(encode(df, "t"), "ids")
    assert back.columns == ["id", "t", "ids", "text"]
    assert {r.id: bytes(r.text).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert [bytes(r.ids) for r in decode(encode(df.where("id = 0"), "t"), "ids", "ids").collect()] == [b"plain words, 1234"]
    assert decode(encode(df.limit(0), "t"), "ids").count() == 0
