import re
from collections import Counter

import numpy as np
import pytest

from annalist.llm import quality_rules as rules
from tests.llm import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "x x x x x", "l\nl\n l\n\n \nl", "#a *b c d", "a b c d a b c\na b c"])
def test_base_counts(text):
    assert rules.base_counts(text) == brute(text)


def test_base_counts_of_documents():
    for _, text in fixtures.texts():
        assert rules.base_counts(text) == brute(text)


def test_many_different_words():
    words = [b"%d" % (k % 1000) for k in range(5000)]
    assert rules.repeated_words(words) == 5000


def symbols(text):
    return [rules.EDGE] * 4 + [ord(c.lower()) if "A" <= c <= "Z" else ord(c) for c in text] + [rules.EDGE]


def grams(text):
    own = symbols(text)
    return [tuple(own[k : k + 5]) for k in range(len(own) - 4)]


def named(gram):
    high = gram[0] << 21 | gram[1]
    return high, gram[2] << 42 | gram[3] << 21 | gram[4]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def log_probability(model, gram):
    high, low = (np.array([x], np.int64) for x in named(gram))
    return model.unseen + sum(rules.looked_up(block.value, high, low, len(model.blocks) == 1)[0] for block in model.blocks)


class Plain:
    """Modified Kneser-Ney in dictionaries, by the formula."""

    def __init__(self, texts):
        self.tables = {5: Counter(g for t in texts for g in grams(t))}
        for n in (4, 3, 2, 1):
            self.tables[n] = Counter(g[1:] for g in self.tables[n + 1])
        self.cuts = {}
        for n, table in self.tables.items():
            n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
            self.cuts[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]

    def p(self, g):
        if not g:
            return 1 / (len(self.tables[1]) + 1)
        n, lower = len(g), self.p(g[1:])
        own = [(h, c) for h, c in self.tables[n].items() if h[:-1] == g[:-1]]
        total = sum(c for _, c in own)
        if not total:
            return lower
        cut = lambda c: self.cuts[n][min(c, 3) - 1] if c else 0
        c = self.tables[n].get(g, 0)
        return (c - cut(c)) / total + sum(cut(c) for _, c in own) / total * lower


TEXTS = [fixtures.prose(k, 60) for k in range(4)] + ["\u65e5\u672c\u8a9e\u306e\u6587 \u65e5\u672c", "\U0001f600 Éa ünd"]


def test_counts_agree_with_a_loop(spark):
    texts = [t for _, t in fixtures.texts() if t]
    found = {(r.high, r.low): r.n for r in rules.counts(fixtures.documents(spark)).collect()}
    assert found == Counter(named(g) for t in texts for g in grams(t))


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_kneser_ney_by_hand(spark, block, monkeypatch):
    """Known and unknown n-grams, with the model in one block and in many."""
    monkeypatch.setattr(rules, "BLOCK", block)
    plain, model = Plain(TEXTS), rules.model(frame(spark, TEXTS))
    assert len(model.blocks) == (1 if block > 200 else -(-sum(len(b.value[0]) for b in model.blocks) // 200))
    known = list(plain.tables[5])
    odd = [(*g[:4], 0x6F22) for g in known[:5]] + [(0x6F22, *g[1:]) for g in known[5:10]] + [(0x6F22,) * 5, (*known[3][:3], 0x6F22, 101)]
    for g in [*known[::9], *known[-12:], *odd]:
        assert np.exp(log_probability(model, g)) == pytest.approx(plain.p(g), rel=1e-9)


def test_probabilities_of_every_context_add_up_to_one():
    plain = Plain(TEXTS)
    every = [s for (s,) in plain.tables[1]]
    for g in list(plain.tables[5])[::97]:
        assert sum(plain.p((*g[:4], s)) for s in [*every, 0x6F22]) == pytest.approx(1, abs=1e-9)


def test_perplexities_are_means_of_log_probabilities(spark, monkeypatch):
    plain = Plain(TEXTS)
    for block in (1 << 22, 500):
        monkeypatch.setattr(rules, "BLOCK", block)
        docs = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, "", None])], "doc_id long, text string")
        found = {r.doc_id: r.log_perplexity for r in rules.scored(docs, rules.model(docs)).collect()}
        for k, text in enumerate([*TEXTS, "", None]):
            own = [np.log(plain.p(g)) for g in grams(text)] if text and len(text) < 100 else None
            if own:
                assert found[k] == pytest.approx(-np.mean(own))
            elif not text:
                assert found[k] == 0


def test_gibberish_in_any_script_is_rejected(spark):
    draw = np.random.default_rng(0)
    words = ["".join(chr(0x430 + c) for c in draw.integers(0, 32, 4)) for _ in range(30)]
    rows = [(k, " ".join(draw.choice(words, 80)), "ru") for k in range(60)]
    rows += [(100 + k, " ".join("".join(chr(0x430 + c) for c in draw.integers(0, 32, 6)) for _ in range(80)), "ru") for k in range(3)]
    found = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {k: k < 100 for k, *_ in rows}


def test_verdicts_follow_the_bands(spark):
    rows = [(k, fixtures.prose(k, 80), "en") for k in range(60)]
    rows += [(100, " ".join("qzxv jkwq vvxz qqjz".split() * 30), "en"), (101, "#$% " * 80, "en"), (102, fixtures.prose(1, 20), "en")]
    draw = np.random.default_rng(0)
    rows.append((103, " ".join("".join(chr(33 + c) for c in draw.integers(0, 90, 9)) for _ in range(90)), "en"))
    found = {r.doc_id: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].kept for k in range(60))
    assert not any(found[k].kept for k in (100, 101, 102, 103))
    assert found[102].base_failed and found[100].base_failed and not found[103].base_failed


def test_each_language_has_its_band(spark):
    rows = [(lang, False, base + k % 9 / 100) for lang, base in (("en", 1.0), ("", 2.0), (None, 3.0)) for k in range(40)] + [("xx", False, 1.0), ("en", True, 9.0)]
    limits = rules.bands(spark.createDataFrame(rows, "lang string, base_failed boolean, log_perplexity double"))
    by = {r.band_lang: (r.band_low, r.band_high) for r in limits.collect()}
    assert set(by) == {"en", "", None, "xx"}
    for lang, base in (("en", 1.0), ("", 2.0), (None, 3.0)):
        assert base - 0.3 < by[lang][0] < base and base + 0.08 < by[lang][1] < base + 0.4
    probe = [("en", False, 1.0), ("en", False, 2.0), (None, False, 3.0), ("", False, 3.0), ("xx", False, 2.0), ("xx", False, 1.0), ("yy", False, 1.0), ("en", True, 1.0)]
    found = rules.verdict(spark.createDataFrame(probe, "lang string, base_failed boolean, log_perplexity double"), limits).collect()
    assert sorted((str(r.lang), r.log_perplexity, r.kept) for r in found) == sorted(
        [("en", 1.0, True), ("en", 2.0, False), ("None", 3.0, True), ("", 3.0, False), ("xx", 2.0, False), ("xx", 1.0, True), ("yy", 1.0, False), ("en", 1.0, False)]
    )


def test_all_columns_are_kept(spark):
    docs = fixtures.documents(spark)
    judged = {(r.doc_id, r.n_words) for r in rules.judged(docs).filter("kept").collect()}
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, len(r.text.split())) for r in kept.collect()} == judged
    assert {r.n_words for r in kept.collect()} <= {1, None}  # the clashing column is the input's own


def test_hard_cases(spark):
    found = rules.judged(fixtures.documents(spark)).collect()
    assert len(found) == len(fixtures.rows())
    assert all(not r.kept and r.base_failed for r in found if r.doc_id in (100, 101, 102, 104))


def test_empty_table(spark):
    assert rules.judged(fixtures.nothing(spark)).count() == 0
    assert rules.filtered(fixtures.nothing(spark)).count() == 0
