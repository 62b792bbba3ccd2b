import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from annalist.llm import sharding
from tests.llm import fixtures

SCHEMA = "doc_id long, text string"


def laws(found, rows, shards):
    key = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((i, *key(t)) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r["size"] for r in found if r.shard == k) for k in range(shards)]
    return sizes


def test_sizes_are_even_and_copies_together(spark):
    rows = [(k, fixtures.prose(k % 700, 5 + k % 40)) for k in range(2000)]
    found = sharding.shards(spark.createDataFrame(rows, SCHEMA).repartition(4), 8).collect()
    sizes = laws(found, rows, 8)
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) <= max(r["size"] for r in found)
    where = defaultdict(set)
    text = dict(rows)
    for r in found:
        where[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 0.1 * len(where)


def test_one_group_of_a_third_of_all_rows(spark):
    rows = [(k, "the same text again and again" if k % 3 == 0 else fixtures.prose(k, 6)) for k in range(3000)]
    found = sharding.shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    sizes = laws(found, rows, 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + max(r["size"] for r in found)
    assert len({r.shard for r in found if r.doc_id % 3 == 0}) <= 5


def test_the_layout_of_files_decides_nothing(spark):
    rows = [(k, fixtures.prose(k % 200, 5 + k % 40)) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [sorted(map(tuple, sharding.shards(own, 8).collect())) for own in (docs.coalesce(1), docs.repartition(5, "text"))]
    assert found[0] == found[1]


def test_propagation_is_a_loop_over_split_groups(spark):
    """Few groups with room everywhere: each goes whole to the shard that most of it is in."""
    rows = [(k, fixtures.prose(k % 60, 20)) for k in range(300)] + [(k, fixtures.prose(k, 40)) for k in range(1000, 2000)]
    base = sharding.named(sharding.sized(spark.createDataFrame(rows, SCHEMA))).withColumn("shard", F.floor(sharding._draw(0, "name") * 8).cast("int"))
    linked = base.filter("doc_id < 300")
    held = defaultdict(Counter)
    for r in linked.collect():
        held[r.k1][r.shard] += 1
    total = 40.0 * sum(r["size"] for r in base.collect())
    for r in sharding.propagate(linked, total, 8).collect():
        assert r.shard == min(held[r.k1], key=lambda s: (-held[r.k1][s], s))


def test_only_copies(spark):
    rows = [(k, "copy") for k in range(400)]
    sizes = laws(sharding.shards(spark.createDataFrame(rows, SCHEMA), 4).collect(), rows, 4)
    assert max(sizes) - min(sizes) <= 40


def test_hard_cases(spark):
    docs = fixtures.documents(spark)
    found = sharding.shards(docs).collect()
    laws(found, fixtures.texts(), 40)


def test_empty_table(spark):
    assert sharding.shards(fixtures.nothing(spark)).count() == 0


@pytest.mark.parametrize("sizes", [[100.0], [60.0, 60.0], [400.0]])
def test_plan_of_large_groups(sizes):
    room = [50.0] * 4
    plan = sharding.plan_large([((k, 0), s, {k: 5}) for k, s in enumerate(sizes)], 50.0, room)
    for k, s in enumerate(sizes):
        bounds = [b for _, b in plan[k, 0]]
        assert bounds == sorted(bounds) and bounds[-1] == 1.0
        assert plan[k, 0][0][0] == k
    assert all(r >= 0 for r in room)


@pytest.mark.parametrize("placed", [200, 1 << 12])
def test_no_pair_stays_split_between_full_shards(spark, placed, monkeypatch):
    """A text with a third of all bytes fills whole shards; pairs of copies within those must go elsewhere."""
    monkeypatch.setattr(sharding, "PLACED", placed)
    rows = [(k, "the same text again and again" if k % 3 == 0 else fixtures.prose(k // 3 % 700 + 1000 * (k % 3 == 1), 6)) for k in range(4200)]
    rows += [(k, fixtures.prose(k, 6)) for k in range(5000, 6500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sized = sharding.named(sharding.sized(docs)).withColumn("shard", F.floor(sharding._draw(0, "name") * 40).cast("int"))
    pairs = sized.join(sized.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), ["k1", "k2"], "left_semi")
    total = float(sum(len(t) + 16 for _, t in rows))
    where, text = defaultdict(set), dict(rows)
    for r in sharding.propagate(pairs.select(sized.columns), total, 40).collect():
        where[text[r.doc_id]].add(r.shard)
    assert len(where.pop("the same text again and again")) >= 10 and len(where) > 1300
    assert not [t for t, s in where.items() if len(s) > 1]
    sizes = laws(sharding.shards(docs, 40).collect(), rows, 40)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 40 + 2 * max(len(t) + 16 for _, t in rows)


def test_groups_that_fit_are_placed_largest_first():
    spare = [10.0, 30.0, 25.0]
    found = sharding.place_exactly([((1, 0), 12.0, [0, 2]), ((2, 0), 20.0, [0]), ((3, 0), 40.0, [1]), ((4, 0), 9.0, [0, 1])], spare)
    assert found == {(2, 0): 1, (1, 0): 2, (4, 0): 0} and spare == [1.0, 10.0, 13.0]
