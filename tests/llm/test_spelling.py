import random
import re
from collections import Counter
from zlib import crc32

import pytest

from annalist.llm import spelling

from .fixtures import documents, nothing, texts


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """All pairs, and forms followed one by one."""
    by = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in by.items():
        top = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(by[w]), counts[form[w]] if form[w] else 0) for w, n in counts.items())


def counted(rows, change):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if change and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def vocabulary(seed, n, alphabet, size):
    draw = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(draw.choices(alphabet, k=draw.randint(6, size)))
        for _ in range(draw.randint(0, 6)):
            words[w] = 5 ** draw.randint(1, 7) + draw.randint(0, 3)
            at = draw.randrange(len(w))
            w = draw.choice((w[:at] + w[at + 1 :], w[:at] + draw.choice(alphabet) + w[at:], w[:at] + draw.choice(alphabet) + w[at + 1 :]))
            if len(w) < 6:
                break
    return words


@pytest.mark.parametrize(("hot", "shard"), [(512, 1 << 15), (2, 40)])
def test_groups_equal_all_pairs(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD", shard)
    counts = vocabulary(1, 300, "abé", 9) | vocabulary(2, 100, "xy", 30) | {"commonstart" + c: 7 for c in "abcdefghijklmnop"} | {"z" * 3000: 5, "z" * 2999: 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.grouped(words)) == grouped(counts)


def test_a_pair_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 2)
    counts = {w: 5 for w in ("aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaa", "aaabaaa", "baaaaa", "aaaaab")}
    found = [(r["word"], r["other"]) for r in spelling.pairs(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in counts for b in counts if near(a, b)}


def test_parting():
    assert [spelling.parting(*p) for p in (("abcdef", "abcdef"), ("abcdef", "abxdef"), ("abcdef", "abcdefg"), ("abcdef", "xabcdef"), ("abcdef", "abcdfe"))] == [None, 2, 6, 0, None]


def test_documents(spark):
    more = [(k, "Motherly motherly mother Straße, strasse été " * 3 + "éclairs éclaire " * (k % 3)) for k in range(400, 700)]
    rows = texts() + more
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n long")
    assert got(spelling.variants(docs)) == grouped(counted(rows, False))
    assert got(spelling.grouped(spelling.vocabulary(spelling.altered(spelling.occurrences(docs))))) == grouped(counted(rows, True))
    assert spelling.variants(documents(spark)).count() == len(counted(texts(), False))
    assert spelling.variants(nothing(spark)).count() == 0
