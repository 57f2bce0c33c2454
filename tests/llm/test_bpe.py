import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import bpe

PIECES = ["a", "B", "'s", " ", "\n", "  ", "é", "1", "½", "²", "“", "…", "!", "\x85", "\xa0", "\t", "\x1d", "語", "😀", "ﬁ", "İ", "é", "'ll", "#", "<|endoftext|>", "_", "\r\n", "word", "aaaa"]


def texts():
    rng = random.Random(5)
    return ["", " ", "x" * 5000, "<|endoftext|>", *("".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(400))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("specials", [True, False])
def test_same_as_library(name, specials):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.ForcedBoundaryEncoder(path, specials)
    library.encode_special_tokens = not specials
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_cross_no_token_and_tokens_encode_to_themselves(name):
    own = bpe.encoder(public_tokenizers.path(name))
    for token, i in list(own.vocab.items())[::37]:
        if token in own.specials:
            continue
        end = bool(own.suffix) and token.endswith(own.suffix) and token != own.suffix
        raw = bytes(own._byte_of[c] for c in (token[: -len(own.suffix)] if end else token))
        assert own.fragments(raw) == [raw]
        assert own._core.encode_single_piece(raw + (b"\xff" if end else b"")) == [i]
    assert len(own.fragments("xqzzjv".encode())) > 1


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k)
    assert [memo[str(i % 25)] for i in range(100)] == [str(i % 25) for i in range(100)]
    assert len(memo) <= 10 and len(memo.older) <= 10


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello", "q"), (1, "Hello", "q"), (None, None, None), (2, "", "z")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(df, public_tokenizers.path("word_bpe_49k.json"), ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert {r.ids_sha256 for r in rows if not r.n_tokens} == {sha256(b"").hexdigest()}
    assert [r.decoded for r in rows if r.doc_id == 1] == ["hello</w>"] * 2
    assert bpe.encode_decode(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []
