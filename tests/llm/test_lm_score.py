import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import lm_score
from annalist.llm.common import remainder, utf8
from tests.llm import fixtures


def run(spark, docs):
    held = remainder(F.col("doc_id"), 7) == 2
    return lm_score.scored(docs.select("doc_id", held.alias("held_out"), utf8(F.col("text")))).collect()


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The same model in dictionaries, with probabilities by recursion."""

    def __init__(self, rows):
        self.counts = [Counter(), Counter(), Counter()]
        for i, text in rows:
            if not out(i):
                own = ["<s>", *words(text), "</s>"]
                for n in range(3):
                    self.counts[n].update(tuple(own[k - n : k + 1]) for k in range(1, len(own)) if k >= n)
                self.counts[0]["<s>",] += 1
        self.context, self.types = defaultdict(int), defaultdict(int)
        for own in self.counts[1:]:
            for gram, n in own.items():
                self.context[gram[:-1]] += n
                self.types[gram[:-1]] += 1
        starts = self.counts[0].pop(("<s>",), 0)
        self.tokens, self.distinct = sum(self.counts[0].values()), len(self.counts[0])
        self.starts = starts
        self.discount = []
        for own in self.counts:
            once, twice = (sum(n == k for n in own.values()) for k in (1, 2))
            self.discount.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(self, gram):
        d, n = self.discount[len(gram) - 1], self.counts[len(gram) - 1][gram]
        if len(gram) == 1:
            if not self.tokens:
                return 1.0
            return (n - d) / self.tokens if n else d * self.distinct / self.tokens
        c = self.context[gram[:-1]]
        if not c:
            return self.p(gram[1:])
        return max(n - d, 0) / c + d * self.types[gram[:-1]] / c * self.p(gram[1:])

    def row(self, i, text):
        own = ["<s>", *words(text), "</s>"]
        score = sum(math.log10(self.p(tuple(own[max(0, k - 2) : k + 1]))) for k in range(1, len(own)))
        c = [self.counts[0][w,] for w in own[1:]]
        base = sum(math.log10((n + 1) / (self.tokens + self.distinct + 1)) for n in c)
        return i, out(i), len(c), sum(n > 0 for n in c), self.tokens, round(base, 6), round(score, 6)


def rounded(found):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)


def test_a_walk_follows_arcs_and_failure_arcs():
    """States: none 0, a 1, b 2, ab 3. Words: start 0, a 1, b 2, c 3 (unknown)."""
    arcs = {(0, 0): (0, -9.0), (0, 1): (1, -1.0), (0, 2): (2, -2.0), (1, 2): (3, -0.5), (3, 1): (1, -0.25)}
    order = sorted(arcs)
    automaton = lm_score.Automaton(
        4, np.array([s * 4 + w for s, w in order]), np.array([arcs[k][0] for k in order]), np.array([arcs[k][1] for k in order]),
        np.array([0, 0, 0, 2]), np.array([0.0, -0.1, -0.2, -0.3]), -4.0,
    )
    # a: arc of none; b: arc of a; a: arc of ab; a: a fails to none; c: a fails, unknown; b: arc of none.
    steps = [(1, -1.0), (2, -0.5), (1, -0.25), (1, -0.1 - 1.0), (3, -0.1 - 4.0), (2, -2.0)]
    # In ab, b fails to b and then to none.
    steps += [(0, 0.0), (1, -1.0), (2, -0.5), (2, -0.3 - 0.2 - 2.0)]
    words = np.array([w for w, _ in steps], np.int32)
    assert automaton.walked(words, 0) == pytest.approx([x for _, x in steps])


@pytest.mark.parametrize("lane", [1, 2, 3, 7])
def test_lanes_reach_the_states_of_one_walk(lane, monkeypatch):
    """Lanes of any length give what one lane over all tokens gives."""
    draw = np.random.default_rng(5)
    deal = lm_score.Deal(1000, {})
    words = np.sort(deal.narrow(draw.integers(0, 1 << 63, 9).astype(np.uint64)))
    sizes = np.array([30, 2, 50, 4])
    ids = draw.integers(1, 8, sizes.sum()).astype(np.int32)
    ids[np.cumsum(sizes) - 1], ids[np.cumsum(sizes) - sizes] = 8, 0
    chunk = lm_score.Chunk(deal, words, ids, sizes, np.array([True, True, False, True]))
    parts = []
    for kind in range(3):
        sent = [lm_score.unpack(payload) for _, payload in chunk.asked(kind).messages(deal)]
        parts.append([lm_score.bucket_sums([m])[0][0] for m in sent])
    automaton, n1 = chunk.automaton(lm_score.Totals(int(n1_sum(chunk)), 8, [(2, 1)] * 3), parts)
    monkeypatch.setattr(lm_score, "LANE", len(ids))
    whole = automaton.walked(ids, 0)
    monkeypatch.setattr(lm_score, "LANE", lane)
    assert automaton.walked(ids, 0) == pytest.approx(whole) and len(automaton.failures) > 20


def n1_sum(chunk):
    return np.repeat(chunk.train, np.bincount(chunk.text, minlength=len(chunk.train))).sum()


@pytest.mark.parametrize("size", [1 << 21, 100])
def test_scores_are_those_of_the_whole_model(spark, size, monkeypatch):
    """With one chunk for each partition, and with many chunks that each see little of the corpus."""
    monkeypatch.setattr(lm_score, "CHUNK", size)
    monkeypatch.setattr(lm_score, "SPARE_BITS", 43)
    monkeypatch.setattr(lm_score, "BUCKETS", (4, 4))
    plain = Plain(fixtures.texts())
    found = run(spark, fixtures.documents(spark))
    assert rounded(found) == Counter(plain.row(*r) for r in fixtures.texts())


def test_frequent_words_go_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE", 1.0)
    monkeypatch.setattr(lm_score, "FREQUENT", 1 / 200)
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    monkeypatch.setattr(lm_score, "SPARE_BITS", 43)
    rows = [(k, fixtures.prose(k % 9, 60 + k % 5)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).sort("doc_id")
    kept = docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), utf8(F.col("text"))).withColumn("row", F.lit(0))
    deal = lm_score.sampled(kept.select("row", "doc_id", "held_out", "text"))
    assert len(deal.names) > 5 and deal.counts.max() > 2
    plain = Plain(rows)
    assert rounded(run(spark, docs)) == Counter(plain.row(*r) for r in rows)


def test_probabilities_of_each_context_add_up_to_one():
    plain = Plain([(k, fixtures.prose(k % 6, 60)) for k in range(12)])
    every = [w for (w,) in plain.counts[0]]
    contexts = [(), *list(plain.context)[::7]]
    assert any(len(c) == 2 for c in contexts)
    for context in contexts:
        assert sum(plain.p((*context, w)) for w in [*every, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_hashes_follow_lower_cased_words_and_text_bounds():
    texts = [b"Hello  World hello\tx", b"", b"a b", b" ", "Éa".encode(), b"x" * 300_000 + b" hello"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, counts = lm_score.word_hashes(data, np.cumsum([0, *map(len, texts)]))
    own = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert [[a == b for a in own] for b in own] == [[a == b for a in hashes] for b in hashes]


def test_packed_arrays_come_back():
    draw = np.random.default_rng(3)
    arrays = [draw.integers(0, 1 << 63, 1000).astype(np.uint64), np.zeros(0, np.uint64), np.array([5], np.uint64), draw.integers(0, 9, 70).astype(np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, lm_score.unpack(lm_score.pack(*arrays)), strict=True))


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.createDataFrame([(k, fixtures.prose(k, 200)) for k in range(150)], "doc_id long, text string")
    held = [r for r in run(spark, docs) if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    rows = [(i, "a b") for i in range(100) if out(i)][:1]
    assert [(r.n_known, r.train_tokens, r.score) for r in run(spark, spark.createDataFrame(rows, "doc_id long, text string"))] == [(0, 0, 0.0)]
    assert run(spark, fixtures.nothing(spark)) == []
