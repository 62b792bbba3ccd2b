import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from annalist.llm import bpe
from tests.llm import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def truth(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(ranks, truth):
    codec, draw = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(0)
    alphabet = "aabcdeeghiilmnorstu  \n\t.,'0é日\U0001f600<|>"
    some = ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(2000)]
    some += [t for _, t in fixtures.texts() if t] + ["a" * 3000, "<|endoftext|>", "\x00\x01", " " * 500]
    for text in some:
        ids = codec.encode(text)
        assert ids == truth.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_a_small_cache_changes_nothing(ranks, truth, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "GROUP", 40)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = fixtures.prose(1, 400)
    assert codec.encode(text) == truth.encode_ordinary(text)


def test_leftmost_of_equal_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    assert bpe.merge(b"aaaaa", ranks) == [256, 257]
    assert bpe.Pairs(ranks).merge([b"aaaaa", b"aa", b"ba", b"aaaa"], 8) == [(256, 257), (256,), (98, 97), (256, 256)]


def test_trees_of_many_matches_are_those_of_one(ranks):
    draw, pairs = random.Random(1), bpe.Pairs(ranks)
    for size in (2, 4, 8, 32, 64):
        some = [bytes(draw.choices(b"aeinorst \xc3\xa9", k=draw.randint(2, size))) for _ in range(300)]
        some = [x for x in some if x not in ranks]
        assert pairs.merge(some, size) == [tuple(bpe.merge(x, ranks)) for x in some]


def test_a_long_text_in_runs(ranks, truth, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 100)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = [fixtures.prose(1, 400), "", "a b", fixtures.prose(2, 3)]
    assert list(codec.encode_all(texts)) == [truth.encode_ordinary(t) for t in texts]


def test_documents(spark, truth):
    docs = fixtures.documents(spark)
    found = bpe.coded_digests(docs, PATH, public_tokenizers.PATTERN)
    assert found.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = found.collect()
    assert len(rows) == len(fixtures.rows())
    for row in rows:
        ids = truth.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256((row.text or "").encode()).hexdigest()


def test_round_trip(spark):
    coded = bpe.encode(fixtures.documents(spark).select("doc_id", "text"), PATH, public_tokenizers.PATTERN)
    for row in bpe.decode(coded, PATH).collect():
        assert bytes(row.decoded) == (row.text or "").encode()


def test_empty_table(spark):
    assert bpe.coded_digests(fixtures.nothing(spark), PATH, public_tokenizers.PATTERN).count() == 0
