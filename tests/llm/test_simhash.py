import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from annalist.llm import simhash
from tests.llm import fixtures


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius and root(a) != root(b):
            parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return Counter((i, prints[k], least[root(k)]) for k, (i, _) in enumerate(rows))


def test_fingerprint_is_that_of_the_rule():
    for _, text in fixtures.texts():
        if len(text or "") < 5000:
            assert simhash.fingerprint(None if text is None else text.encode()) == [brute_print(text)]
            assert simhash.fingerprint((text or "").encode(), wide=4)[0] == brute_print(text)


def test_long_text_in_chunks(monkeypatch):
    text = fixtures.prose(1, 500).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_classes_agree_with_brute_force(spark):
    found = simhash.near_duplicates(fixtures.documents(spark)).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == brute_classes(fixtures.texts())


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_every_near_pair_is_found(spark, m, monkeypatch):
    draw = np.random.default_rng(m)
    fps = draw.integers(0, 2**64, 60, dtype=np.uint64, endpoint=False)
    near = [int(f) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 7), replace=False)) for f in np.repeat(fps, 4)]
    every = np.unique(np.concatenate([fps, np.array(near, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "block_count", lambda n, radius: m)
    frame = spark.createDataFrame([(int(f.view(np.int64)), k, k) for k, f in enumerate(every)], "fp long, node long, first long")
    made = simhash.plan(frame.select("fp", "node"), len(every))
    found = {(r.a, r.b) for r in simhash.links(frame, made, ["fp"], 4).collect()}
    near = {(a, b) for a in range(len(every)) for b in range(a) if int(every[a] ^ every[b]).bit_count() <= 4}
    assert found == near
    assert {(r.a, r.b) for r in simhash.first_links(frame, made, ["fp"], 4).collect()} <= near


def test_links_of_a_dense_cluster_are_linear(spark):
    """5,000 different near copies of one fingerprint: some three million pairs of them link."""
    draw = np.random.default_rng(1)
    fps = {0x0123456789ABCDEF ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 4), replace=False)) for _ in range(6000)}
    fps = np.array(sorted(fps), np.uint64)[:5000]
    prints = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    nodes = prints.withColumn("node", F.col("fp"))
    made = simhash.plan(nodes, len(fps))
    first = simhash.first_links(nodes, made, ["fp"], 4)
    assert first.count() <= 3 * 5 * len(fps)
    named = simhash.components(first)
    nodes = nodes.join(named, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("first"))
    assert simhash.links(nodes, made, ["fp"], 4).count() <= 15 * len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    parent, left = {}, set(range(len(fps)))
    while left:
        start = left.pop()
        reached, fresh = {start}, [start]
        while fresh:
            near = np.flatnonzero((bits != bits[fresh.pop()]).sum(axis=1) <= 4)
            new = set(near.tolist()) & left
            left -= new
            reached |= new
            fresh += new
        parent |= dict.fromkeys(reached, start)
    found = {r.fp: r.component for r in simhash.classes(prints).collect()}
    pairs = Counter((parent[k], found[int(f)]) for k, f in enumerate(fps.view(np.int64)))
    assert len(pairs) == len(set(parent.values())) == len(set(found.values()))


def test_allocation_is_the_cheapest():
    costs = np.random.default_rng(0).random((20, 4, 4))
    found = simhash.allocate(costs, 1)
    for q in range(20):
        options = [t for t in itertools.product(range(-1, 3), repeat=4) if sum(t) == 1]
        best = min(sum(costs[q, i, t + 1] for i, t in enumerate(o)) for o in options)
        assert found[q].sum() == 1
        assert sum(costs[q, i, t + 1] for i, t in enumerate(found[q])) == pytest.approx(best)


def test_correlated_bits_share_a_block():
    bits = np.random.default_rng(0).integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    blocks = simhash.correlated_blocks(bits.T @ bits, 500, 4)
    assert sorted(itertools.chain(*blocks)) == list(range(64))
    assert any({3, 40} <= set(b) for b in blocks)


def test_more_fingerprints_take_wider_blocks():
    assert [simhash.block_count(n) for n in (10**4, 10**10)] == [5, 2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1001, 1000)], "a long, b long").repartition(4)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 301)} | {1001: 1000}


def similar(a, b):
    """Jaccard's similarity of the sets of five-word shingles."""
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_deduplicated_keeps_one_of_each_class(spark):
    docs = fixtures.documents(spark)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    texts, ids = dict(fixtures.texts()), [r.doc_id for r in kept.collect()]
    # 2 has copies, 105 copies 5, 106 nearly 3, a null id copies 7; 100 to 102 have no words.
    gone = {105, 101, 102}
    assert similar(texts[3], texts[106]) >= 0.8
    assert sorted(i for i in ids if i is not None) == sorted(set(i for i in texts if i is not None) - gone - {106})
    assert ids.count(None) == 1


def test_each_class_keeps_a_row_whatever_its_ids(spark):
    a, b, c, d = (fixtures.prose(k, 80) for k in (201, 202, 203, 204))
    rows = [(5, a, 1), (5, b, 2), (9, b, 3), (None, c, 4), (None, c, 4), (None, d, 5), (7, d, 6), (5, a, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = Counter(map(tuple, simhash.deduplicated(frame).collect()))
    assert kept == Counter([(5, a, 0), (5, b, 2), (None, c, 4), (7, d, 6)])
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert found == {(5, 5), (9, 5), (None, None), (None, 7), (7, 7)}


def test_similar_texts_go_and_others_stay(spark):
    """Against brute-force similarity: nearly all texts of 0.85 or more go, none under 0.7."""
    draw = random.Random(5)
    rows, expected = [], {}
    for k in range(60):
        words = fixtures.prose(300 + k, 150 + 10 * (k % 20)).split()
        other = list(words)
        for _ in range(1 + k % 12):
            other[draw.randrange(len(other))] = f"new{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        expected[2 * k + 1] = similar(rows[-2][1], rows[-1][1])
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(60))
    near = [i for i, s in expected.items() if s >= 0.85]
    assert len(near) > 10 and sum(i not in kept for i in near) >= 0.9 * len(near)
    assert all(i in kept for i, s in expected.items() if s < 0.7) and any(s < 0.7 for s in expected.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(fixtures.nothing(spark)).count() == 0
    assert simhash.deduplicated(fixtures.nothing(spark)).count() == 0
