import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import language
from annalist.llm.common import remainder
from tests.llm import fixtures

PARTS = {"en": "the on ing re er an th ea st".split(), "fr": "le qui eux oi que é ment è".split(), "de": "ung keit sch ö ü der ie".split()}


def corpus():
    draw = random.Random(0)
    out = []
    for k in range(300):
        lang = draw.choice(sorted(PARTS))
        out.append((k, " ".join("".join(draw.choices(PARTS[lang], k=3)) for _ in range(20)), lang))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    held = remainder(F.col("doc_id"), 4) == 2
    found = language.identified(docs.filter(held), language.train(docs.filter(~held))).collect()
    assert len(found) > 40
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in found)


def test_counts_agree_with_a_loop(spark):
    docs = fixtures.documents(spark)
    own = Counter()
    for _, text, lang, *_ in fixtures.rows():
        if text is not None and lang is not None:
            for buckets in language.hashed(text):
                own.update((lang, int(b)) for b in buckets)
    assert {(r.lang, r.bucket): r.n for r in language.counts(docs).collect()} == own


def test_pieces_give_the_same_n_grams(monkeypatch):
    text = fixtures.prose(1, 200)
    whole = np.sort(np.concatenate(list(language.hashed(text))))
    monkeypatch.setattr(language, "PIECE", 7)
    assert (np.sort(np.concatenate(list(language.hashed(text)))) == whole).all()


def single(text, block):
    names, _, mass = language.best_of([text], block, (["und"], np.array([-np.inf]), np.zeros(1)))
    return names[0], 1 / mass[0]


def test_likelihoods_by_hand(monkeypatch):
    matrix = np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 3).T).astype(np.float32)
    prior = np.log([0.2, 0.5, 0.3])
    total = prior + sum(matrix[int(b)].astype(float) for own in language.hashed("hello world") for b in own)
    n = sum(map(len, language.hashed("hello world")))
    share = np.exp((total - total.max()) / n**0.5)
    for cells, piece in ((language.CELLS, language.PIECE), (9, 5)):
        monkeypatch.setattr(language, "CELLS", cells)
        monkeypatch.setattr(language, "PIECE", piece)
        assert single("hello world", language.Block(["a", "b", "c"], matrix, prior)) == ("abc"[total.argmax()], pytest.approx(1 / share.sum(), rel=1e-5))


def test_ties_and_nothing_learned(spark):
    assert single("x", language.Block(["a", "b"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros(2))) == ("a", 0.5)
    model = language.train(fixtures.nothing(spark))
    assert {(r.lang_pred, r.score) for r in language.identified(fixtures.documents(spark), model).collect()} == {("und", 0.0)}


def predicted(rows, text):
    """A whole prediction by loops over dictionaries."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    counts, texts = {}, Counter()
    for said, lang in rows:
        if said is not None and lang is not None:
            texts[lang] += 1
            own = counts.setdefault(lang, Counter())
            for buckets in language.hashed(said):
                own.update(buckets.tolist())
    found = {}
    grams = [b for buckets in language.hashed(text) for b in buckets.tolist()]
    for lang, own in counts.items():
        size = sum(own.values()) + language.SMOOTHING * language.BUCKETS
        found[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((own[b] + language.SMOOTHING) / size) for b in grams)
    best = min(found, key=lambda k: (-found[k], k))
    return best, 1 / sum(math.exp((x - found[best]) / len(grams) ** 0.5) for x in found.values())


@pytest.mark.parametrize("languages", [2048, 1])
def test_predictions_agree_with_a_loop(spark, languages, monkeypatch):
    """With all languages in one block, and with a block for each."""
    monkeypatch.setattr(language, "LANGUAGES", languages)
    docs = spark.createDataFrame(corpus()[:60], "doc_id long, text string, lang string").unionByName(fixtures.documents(spark).select("doc_id", "text", "lang"))
    blocks = language.train(docs)
    assert len(blocks) == (1 if languages > 1 else 3)
    rows = [(r.text, r.lang) for r in docs.collect()]
    for r in language.identified(docs, blocks).collect():
        if len(r.text or "") < 2000:
            lang, score = predicted(rows, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)


def test_hard_cases(spark):
    docs = fixtures.documents(spark)
    found = language.identified(docs, language.train(docs))
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(fixtures.rows())
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.identified(fixtures.nothing(spark), language.train(docs)).count() == 0
