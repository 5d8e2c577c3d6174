import base64
import random

import numpy as np
import pytest

from stratalog.llm.split import BLOCK, LINE, PARAGRAPH, PART, boundaries, pack, split_oversized

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


def test_boundaries():
    raw = b"A: b\nB: c\n\nHi.\n\npara one. Two.\n> quoted\n> more\nback\n--b\nContent-Type: multipart/x; boundary=b\n\nx"
    found = dict(boundaries(raw))
    assert found[raw.index(b"--b")] == PART
    assert found[raw.index(b"> quoted")] == BLOCK and found[raw.index(b"back")] == BLOCK
    assert found[raw.index(b"para")] == PARAGRAPH
    assert list(found) == sorted(found) and 0 not in found


def test_a_quotation_keeps_its_lead():
    raw = b"A: b\n\nHi.\nAnna wrote on Wed, 22 Jan 2025 13:55:48 -0800:\n> quoted\n>> Ben wrote:\n>> deeper\n"
    found = dict(boundaries(raw))
    assert found[raw.index(b"Anna")] == BLOCK and found[raw.index(b"> quoted")] == LINE
    assert found[raw.index(b">> Ben")] == BLOCK and found[raw.index(b">> deeper")] == LINE


@pytest.mark.parametrize("seed", range(30))
def test_pack_covers_within_the_limit(seed):
    r = random.Random(seed)
    n, limit = r.randrange(1, 400), r.randrange(1, 60)
    cuts = sorted(r.sample(range(1, n), min(n - 1, r.randrange(0, 100)))) if n > 1 else []
    strengths = np.array([r.randrange(1, 7) for _ in cuts], np.int64)
    ends = pack(np.array(cuts, np.int64), strengths, n, limit)
    assert ends == sorted(set(ends)) and ends[-1] == n
    sizes = np.diff([0, *ends])
    assert sizes.max() <= limit
    # where neighbours would fit in one span together, a stronger boundary keeps them apart: never in a flat tree
    if len(set(strengths.tolist())) == 1 and len(cuts) == n - 1:
        assert all(a + b > limit for a, b in zip(sizes, sizes[1:], strict=False))


def test_pack_prefers_strong_boundaries():
    assert pack(np.array([10, 20, 30, 40]), np.array([1, 6, 1, 1]), 50, 30) == [20, 50]


def test_split_frame(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    para = lambda: " ".join(r.choice(["word", "Straße", "日本", "it's", "12,5", "x" * 30]) for _ in range(r.randrange(5, 60))) + ".\n"
    texts = ["From: a\n\n" + "\n".join(para() for _ in range(k)) for k in (0, 1, 5, 20, 60)] + [None, "", "\n" * 5000, "=" * 20000, "a" * 3000, "日本語" * 2000, "head\n" + "\n> ".join(para() for _ in range(50))]
    exact = " a" * 64
    texts += [exact, exact + " a"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "id int, text string, piece int").repartition(2)
    out = split_oversized(df, "id", "text", 64, 8).collect()
    assert {q.doc_id for q in out} == {i for i, t in enumerate(texts) if t and len(ref.encode_ordinary(t)) > 64}
    by = {}
    for q in out:
        by.setdefault(q.doc_id, []).append(q)
    assert len(by[3]) == 2 * len({q.piece for q in by[3]})
    del by[3]
    for i, ps in by.items():
        ps.sort(key=lambda q: q.piece)
        ids = ref.encode_ordinary(texts[i])
        assert [q.piece for q in ps] == list(range(len(ps)))
        assert ps[0].first_token == 0 and ps[-1].first_token + ps[-1].n_tokens == len(ids) == ps[0].doc_tokens
        for a, b in zip(ps, ps[1:], strict=False):
            assert a.first_token + a.n_tokens - b.first_token == 8
        for q in ps:
            assert 8 < q.n_tokens <= 64
            assert q.piece_text == ref.decode(ids[q.first_token : q.first_token + q.n_tokens], errors="replace")
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", 10, 5)
    assert split_oversized(df.limit(0), "id", "text").count() == 0
