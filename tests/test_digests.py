"""Digests of groups that take turns, against MD5 of each group at once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from annalist.functions import md5
from annalist.operators import digests, report
from annalist.plans import ingest, upkeep
from annalist.sources import entities

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("plain", [False, True])
def test_a_stream_taken_up_again_has_the_digest_of_the_whole(monkeypatch, plain):
    if plain:
        monkeypatch.setattr(md5, "_library", lambda: None)
    draw = random.Random(1)
    for size in [*range(0, 130), 1000, 5000]:
        data, state, at = draw.randbytes(size), md5.start(), 0
        while at < size:
            step = draw.randint(0, 150)
            state, at = md5.updated(state, data[at : at + step]), at + step
        assert md5.hexdigest(state) == hashlib.md5(data).hexdigest()


def test_sizes_beyond_32_bits_are_counted():
    big = md5.start()[:16] + (2**29 * 64).to_bytes(8, "little")  # as many bits as 32 bits cannot count
    assert md5.updated(big, b"x" * 70) == md5._by_rounds(big, b"x" * 70)
    assert md5.hexdigest(big) == md5._by_rounds(big, b"\x80" + bytes(55) + (2**32 * 64).to_bytes(8, "little"))[:16].hex()


@pytest.mark.parametrize("turn", [4000, 1 << 20])
@pytest.mark.parametrize("gap", ["", "\n"])
def test_groups_of_several_turns(spark, monkeypatch, turn, gap):
    monkeypatch.setattr(digests, "TURN_BYTES", turn)
    monkeypatch.setattr(digests, "RANGE_BYTES", turn // 2)
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", "b", "b", None]), draw.choice([None, *range(60)]), draw.choice([None, "", "é", "x" * 90, f"{k}\n"])) for k in range(300)]
    rows += [("once", 1, "one"), ("none", 1, None), ("none", 2, None), ("empty", 1, "")]
    draw.shuffle(rows)
    found = digests.ordered_md5(spark.createDataFrame(rows, "g string, o int, p string").repartition(5), "g", ["o"], "p", gap).collect()
    wanted = {}
    for g in {r[0] for r in rows}:
        own = sorted(((o, p) for x, o, p in rows if x == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        said = [p for _, p in own if p is not None]
        wanted[g] = (len(own), hashlib.md5(gap.join(said).encode()).hexdigest() if said else None)
    assert {r.g: (r.n, r.md5) for r in found} == wanted and len(found) == len(wanted)
    assert digests.ordered_md5(spark.createDataFrame([], "g string, o int, p string"), "g", ["o"], "p").count() == 0


@pytest.mark.parametrize("query", [upkeep.export_sections, ingest.entity_bodies])
def test_no_task_holds_more_than_a_turn(spark, monkeypatch, query):
    whole = sorted(map(tuple, query(spark, FOLDER).collect()))
    real = digests._turn

    def seen(gap):
        run = real(gap)

        def counted(stream):
            size = 0

            def passed():
                nonlocal size
                for batch in stream:
                    size += sum(len(p or b"") for p in batch.column(5).to_pylist())
                    yield batch

            yield from run(passed())
            assert size <= 2 * 40_000, f"{size} bytes in one task"

        return counted

    monkeypatch.setattr(digests, "_turn", seen)
    monkeypatch.setattr(digests, "TURN_BYTES", 40_000)
    monkeypatch.setattr(digests, "RANGE_BYTES", 10_000)
    assert sorted(map(tuple, query(spark, FOLDER).collect())) == whole


def test_digests_are_those_of_the_rows_that_hold_all(spark):
    from annalist.plans.views import document_facts

    facts = document_facts(spark, FOLDER)
    sections = report.export_sections(facts).select("heading", "rank", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")))
    assert sorted(map(tuple, report.export_digests(facts).collect())) == sorted(map(tuple, sections.collect()))
    rows = [("a", 2, "f2", "two", "active"), ("a", 1, "f1", "one", "active"), ("b", 1, "f3", "old", "superseded"), ("c", 1, "f4", None, "active"), (None, 1, "f5", "x", "active")]
    listed = spark.createDataFrame(rows, "title string, ord int, id string, statement string, status string")
    at_once = listed.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "statement", "status"))).alias("f")).select("title", F.md5(entities.body(F.col("title"), F.col("f"))))
    assert {tuple(r) for r in entities.body_digests(listed).collect()} == {tuple(r) for r in at_once.collect()}
