import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from annalist.llm import tokencount
from tests.llm import fixtures

PIECES = tokencount.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def library(pieces, fallback):
    out = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always", split=True)
    return out


def some():
    draw = random.Random(0)
    alphabet = "aabcdeeghiilmnorstu  \n\t.,'0é日\U0001f600<>▁"
    out = ["".join(draw.choices(alphabet, k=draw.randrange(50))) for _ in range(1500)]
    return out + [t for _, t in fixtures.texts() if t] + ["", " ", "  a  b", "▁▁a▁b c", "<0x0A>\n<s>", "日本" * 50, "\x00"]


def test_counts_are_those_of_the_library():
    truth, counter = library(PIECES, True), tokencount.Counter(PIECES)
    texts = some()
    for text, found in zip(texts, truth.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text)[0] == len(found.ids), text


@pytest.mark.parametrize("seed", range(5))
def test_ties_and_unknowns(seed):
    draw = random.Random(seed)
    pieces = [("<unk>", 0.0), *((p, -float(draw.randrange(1, 4))) for p in {"".join(draw.choices("abc", k=draw.randrange(1, 4))) for _ in range(12)})]
    truth, counter = library(pieces, False), tokencount.Counter(pieces)
    for _ in range(300):
        text = "".join(draw.choices("abcd ", k=draw.randrange(12)))
        assert counter.count(text)[0] == len(truth.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_score_is_the_best_of_all_segmentations():
    pieces = [("<unk>", 0.0), ("a", -3.0), ("ab", -4.0), ("b", -2.0), ("abb", -6.0), (tokencount.MARK, -1.0)]
    counter = tokencount.Counter(pieces)
    score = dict(pieces)

    def best(text):
        return max((score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score), default=float("-inf")) if text else 0.0

    for text in ("abbab", "aabb", "bbb", "ab abb"):
        assert counter.count(text)[1] == sum(best(tokencount.MARK + w) for w in text.split())


def test_documents(spark):
    docs, counter = fixtures.documents(spark), tokencount.Counter(PIECES)
    found = tokencount.counted(docs, PIECES).collect()
    assert len(found) == len(fixtures.rows())
    for row in found:
        assert (row.n_tokens, row.score) == counter.count(row.text)


def test_empty_table(spark):
    assert tokencount.counted(fixtures.nothing(spark), PIECES).count() == 0
