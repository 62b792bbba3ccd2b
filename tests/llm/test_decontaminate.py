from collections import Counter
from hashlib import sha256
import re

import pytest

from annalist.llm import decontaminate
from tests.llm import fixtures

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(width, len(own))
        for k in range(len(own) - n + 1) if n else ():
            windows.setdefault(tuple(own[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(own[k : k + n])]
        out.append((doc, len(own), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return Counter(out)


def items():
    passage = fixtures.prose(3, 80).split()
    out = [(k, fixtures.prose(200 + k, 30)) for k in range(5)]
    out += [(10, " ".join(passage[10:40])), (2, " ".join(passage[20:33])), (11, "Éa, ÜND"), (11, "é! ñ"), (12, None), (13, " .,"), (14, "x"), (15, " ".join(passage[0:12]))]
    return [*out, out[5]]


def hard():
    prose = fixtures.prose(3, 80)
    return fixtures.texts() + [(300, "X x"), (301, prose.upper() + " " + prose), (302, fixtures.prose(1, 2000) + " " + prose), (303, re.sub(" ", "--", prose))]


def judged(spark):
    docs = spark.createDataFrame(hard(), "doc_id long, text string")
    return decontaminate.judged(docs, spark.createDataFrame(items(), "item_id long, text string")).drop("text").collect()


def test_verdicts(spark):
    found = Counter(tuple(r) for r in judged(spark))
    assert found == brute(hard(), items())
    assert sum(r[5] for r in found) >= 4


@pytest.mark.parametrize("block", [13, 20, 40])
def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    assert Counter(tuple(r) for r in judged(spark)) == brute(hard(), items())


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "_hashes", lambda ids, width: np.zeros(len(ids) - width + 1, np.uint64))
    windows = decontaminate.Windows([("1", [b"a", b"b"]), ("2", [b"b", b"a"])], 2)
    mask, found = windows.hits([b"a", b"b", b"b"])
    assert mask.tolist() == [True, True, False] and found == {"1"}


def test_removal_keeps_the_other_rows_as_they_are(spark):
    docs, benchmark = fixtures.documents(spark), spark.createDataFrame(items(), "item_id long, text string")
    kept = decontaminate.removed(docs, benchmark)
    assert kept.columns == docs.columns
    bad = {i for i, *_, contaminated in brute(fixtures.texts(), items()) if contaminated}
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in fixtures.rows() if r[0] not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(fixtures.nothing(spark), none).count() == 0
    assert decontaminate.judged(fixtures.documents(spark), none).filter("contaminated or n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_items_without_an_id_hit_too(spark, monkeypatch, block):
    """They count as one item, as in SQL, and only their id is left out of the digest."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    own, named = fixtures.prose(901, 20), fixtures.prose(902, 20)
    docs = spark.createDataFrame([(1, own), (2, own + " " + named), (3, fixtures.prose(903, 20))], "doc_id long, text string")
    known = [(None, own), (None, fixtures.prose(904, 20)), (7, named), (None, named), (None, None)]
    found = decontaminate.judged(docs, spark.createDataFrame(known, "item_id long, text string")).collect()
    digest = lambda x: sha256(x.encode()).hexdigest()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == {1: (20, 1, digest(""), True), 2: (40, 2, digest("7"), True), 3: (0, 0, digest(""), False)}
    assert [r.doc_id for r in decontaminate.removed(docs, spark.createDataFrame(known, "item_id long, text string")).collect()] == [3]
