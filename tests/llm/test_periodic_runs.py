import random
from hashlib import sha256
from zlib import crc32

import numpy as np

from annalist.llm import periodic_runs as pr

from .fixtures import documents, nothing, prose, texts


def brute(words):
    """Runs of a list by comparing it with itself at every distance; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def changed(words, doc_id):
    if doc_id is None or crc32(str(doc_id).encode()) % 10 or not words:
        return words
    n, g = len(words), crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text, change=True):
    words = (text or "").encode().split()
    words = changed(words, doc_id) if change else words
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(rest).hexdigest())


def test_runs_equal_brute_force_on_random_sequences():
    draw = random.Random(1)
    for _ in range(150):
        every = []
        for _ in range(draw.randint(1, 5)):
            own = []
            while len(own) < draw.randint(0, 300):
                piece = [draw.randint(0, 3) for _ in range(draw.randint(1, 12))]
                own += piece if draw.random() < 0.4 else (piece * 40)[: draw.randint(1, 120)]
            every.append(np.array(own, np.int64))
        got = pr.runs(every)
        assert got == [brute(x.tolist()) for x in every]
        owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
        may = pr.repeating(np.concatenate(every), owner, len(every))
        assert all(may[k] for k, found in enumerate(got) if found)


def test_greatest_exponent_is_exact_and_ties_go_to_the_first():
    assert pr.best([(0, 30, 10), (40, 60, 20), (200, 31, 10)]) == (200, 31, 10)
    assert pr.best([(5, 24, 8), (40, 30, 10)]) == (5, 24, 8)
    assert pr.best([]) is None


def small(rows):
    return [(k, t) for k, t in rows if len(t or "") < 20_000]


def test_report_of_hard_cases(spark):
    periodic = [(k, " ".join((prose(k, 7).split() * 30)[: 20 + 13 * k])) for k in range(200, 210)]
    extra = [(300, "a " * 50), (301, " ".join(["a b c d"] * 6)), (302, " ".join(prose(1, 40).split() + ["x"] * 24 + ["y", "z"] * 12))]
    rows = small(texts()) + periodic + extra
    got = [tuple(r) for r in pr.report(spark.createDataFrame(rows, "doc_id long, text string"), pr.extended).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    whole = [tuple(r) for r in pr.report(documents(spark)).collect()]
    assert sorted(x for x in whole if x[0] == 104) == [expected(104, "x" * 50_000, change=False)]
    assert len(whole) == documents(spark).count()
    assert pr.report(nothing(spark)).count() == 0


def test_groups_of_texts_do_not_matter(spark, monkeypatch):
    rows = [(k, " ".join((prose(k, 5).split() * 30)[: 20 + 3 * k])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    many = sorted(map(tuple, pr.report(docs, pr.extended).collect()))
    monkeypatch.setattr(pr, "GROUP", 64)
    monkeypatch.setattr(pr, "LEAVES", 16)
    assert sorted(map(tuple, pr.report(docs, pr.extended).collect())) == many == sorted(expected(*r) for r in rows)


def test_collapsed_keeps_columns_and_texts_without_runs(spark):
    docs = spark.createDataFrame([(1, "a  b", 7), (2, "p q " * 20 + "end", 8), (3, None, None)], "doc_id long, text string, n_runs int")
    assert sorted(map(tuple, pr.collapsed(docs).collect())) == [(1, "a  b", 7), (2, "p q end", 8), (3, None, None)]
