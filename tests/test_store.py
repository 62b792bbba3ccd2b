"""Layers, the word index, and erasure beside other writers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annalist import store as store_module
from annalist.api import Memory, NotFound
from annalist.operators import change, erasure, similarity, wordindex
from annalist.schemas import FACT
from annalist.store import Conflict, Store

NAMES = [field.split()[0] for field in FACT.split(", ")]


def facts(spark, rows):
    """Rows of (id, entity_id, statement) and more by name."""
    fill = {"status": "active", "aliases": [], "supersedes": [], "source_ids": [], "predicate": "note", "ord": 1}
    return spark.createDataFrame([tuple((fill | {"id": i, "entity_id": e, "statement": s} | more).get(c) for c in NAMES) for i, e, s, more in rows], FACT)


def fact(i, statement, **more):
    return {"id": i, "predicate": "note", "statement": statement, **more}


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "memory"))


def test_layers_are_what_whole_tables_would_be(spark, tmp_path):
    draw, store, model, seen = random.Random(3), Store(spark, str(tmp_path / "s")), {}, []
    for k in range(5):
        put = {f"f{draw.randrange(40)}": f"statement {k} {draw.random()}" for _ in range(12 if k else 40)}
        gone = {i for i in draw.sample(sorted(model), min(4, len(model))) if i not in put}
        rows = facts(spark, [(i, "w_a", s, {}) for i, s in put.items()]).withColumn("gone", F.lit(False))
        rows = rows.unionByName(facts(spark, [(i, "w_a", "left behind", {}) for i in gone] or [("none", "w_a", None, {})]).withColumn("gone", F.lit(True)))
        store.publish(k, f"r{k}", "", changes={"facts": rows})
        model = {i: s for i, s in (model | put).items() if i not in gone}
        seen.append(dict(model))
    for k, wanted in enumerate(seen, 1):
        assert {r.id: r.statement for r in store.table("facts", k).collect()} == wanted
        some = sorted(wanted)[::3]
        assert {r.id for r in store.rows("facts", [*some, "gone"], k).collect()} == set(some)
    sizes = [layer["rows"] for layer in store.layers("facts")]
    assert len(sizes) > 1 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    # No text of a removed row is kept.
    for layer in store.layers("facts"):
        assert spark.read.parquet(f"{store.root}/{layer['folder']}").filter("statement = 'left behind'").isEmpty()
    key = spark.range(1).select(wordindex.family_key(F.lit("w_a"))).first()[0]
    assert sorted(r.id for r in store.indexed([key]).collect()) == sorted(model)


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(0, "r0", "", {"facts": facts(spark, [(f"f{k}", "w_a", f"word{k} thing", {}) for k in range(50)])})
    first = store.layers("facts")
    store.publish(1, "r1", "", changes={"facts": facts(spark, [("f3", "w_a", "new", {})]).withColumn("gone", F.lit(False))})
    assert store.layers("facts")[:1] == first and [layer["rows"] for layer in store.layers("facts")] == [50, 1]
    plan = store.rows("facts", ["f3"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id, [f3])]" in plan or "EqualTo(id,f3)" in plan


def test_index_finds_what_comparison_with_all_facts_finds(spark, tmp_path):
    draw = random.Random(5)
    words = [f"word{k}x" for k in range(40)]

    def statement():
        return " ".join(draw.choices(words, weights=[1 + 400 / (k + 1) for k in range(40)], k=draw.randint(1, 9)))

    entities = ["w_a", "w_a_2", "w_b", "pref_user", "p_x"]
    held = [(f"f{k}", draw.choice(entities), statement(), {"status": draw.choice(["active"] * 4 + ["superseded"])}) for k in range(150)]
    new = [(f"n{k}", draw.choice(entities), statement(), k) for k in range(60)]
    store = Store(spark, str(tmp_path / "s"))
    store.publish(0, "r0", "", {"facts": facts(spark, held)})
    proposals = spark.createDataFrame([(i, e, s, k) for i, e, s, k in new], "id string, entity_id string, statement string, order long")
    none = spark.createDataFrame([], "target string")
    active = facts(spark, held).filter("status = 'active'").select("id", "entity_id", "statement")
    probes = wordindex.probes(proposals)
    keys = [r[0] for r in probes.select("key").distinct().collect()]
    found = [r.id for r in wordindex.similar_ids(probes, store.indexed(keys)).collect()]
    near = store.rows("facts", found).filter("status = 'active'").select("id", "entity_id", "statement")
    assert 0 < len(found) < 150
    wanted = {r.id for r in similarity.placeable(proposals, active, none).collect()}
    assert {r.id for r in similarity.placeable(proposals, near, none).collect()} == wanted and len(wanted) < 60


def test_consolidation_reads_no_other_facts(memory, tmp_path, monkeypatch):
    path = tmp_path / "in" / "a.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(json.dumps({"id": f"a-{k}", "role": "user", "text": t}) for k, t in enumerate(["please always use tabs in python", "my name is Ada", "Please always use tabs in Python!", "my name is Bob"])))
    memory.request_change("remember", "r1", "pref_user", fact("f1", "User requested: use tabs in python, please"))
    memory.ingest(str(path))
    whole = memory.store.table
    monkeypatch.setattr(memory.store, "table", lambda name, revision=None: whole(name, revision) if name == "controls" else pytest.fail("the whole table was read"))
    assert memory.consolidate("b1", 2)["facts"] == 1 and memory.consolidate("b2", 2)["facts"] == 1
    monkeypatch.undo()
    assert sorted(r.statement for r in memory.store.table("facts").collect()) == ["User requested: use tabs in python, please", "User's name is Ada.", "User's name is Bob."]
    assert len(memory.store.layers("facts")) >= 1


def told(memory):
    memory.request_change("remember", "r1", "w_app", fact("f1", "the secret is alpha"))
    memory.request_change("remember", "r2", "w_app", fact("f2", "quite another", evidence="he said: the secret is alpha, twice"))
    memory.request_change("remember", "r3", "w_other", fact("f3", "the secret is alpha"))
    memory.request_change("remember", "r4", "w_app", fact("f11", "a longer id"))


def held(memory):
    """Every text in every Parquet file under the store."""
    tables = memory.store.root + "/tables"
    found = memory.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(tables)
    rows = found.select(F.concat_ws("|", "id", "statement", "evidence").alias("t")).collect() if "statement" in found.columns else []
    return "\n".join(r.t for r in rows)


def test_statements_are_erased_everywhere(memory):
    told(memory)
    out = memory.erase("f1")
    assert (out["facts"], out["same_statement"]) == (1, 1) and out["folders"] > 0
    assert "alpha" not in held(memory)
    assert {r.id for r in memory.store.table("facts").collect()} == {"f2", "f11"}
    assert memory.erase("f1")["folders"] == 0
    with pytest.raises(NotFound):
        memory.erase("f99")


def test_a_publication_meanwhile_is_a_conflict_and_the_head_stays_readable(memory, monkeypatch):
    told(memory)
    other, real = Memory(memory.spark, memory.root), memory.store._stored

    def slow(name, rows):
        monkeypatch.undo()
        other.tasks_update(0, {"id": "t"}, "t-1")
        return real(name, rows)

    monkeypatch.setattr(memory.store, "_stored", slow)
    with pytest.raises(Conflict):
        memory.erase("f1")
    assert {r.id for r in other.store.table("facts").collect()} == {"f1", "f2", "f3", "f11"}
    assert memory.erase("f1")["facts"] == 1
    # After the fence others may publish: what they name is clean, and is kept.
    told_again, finish = Memory(memory.spark, memory.root), memory.store.finish
    calls = []

    def late():
        calls.append(1)
        if len(calls) == 2:
            told_again.tasks_update(1, {"id": "u"}, "t-2")
        return finish()

    monkeypatch.setattr(memory.store, "finish", late)
    assert memory.erase("f11")["facts"] == 1
    assert {r.id for r in memory.store.table("facts").collect()} == {"f2"} and memory.tasks_read()["version"] == 2
    for revision in memory.store.revisions():
        assert "f11" not in {r.id for r in memory.store.table("facts", revision).collect()}
    assert "alpha" not in held(memory)


@pytest.mark.parametrize("step", ["_named_next", "_write", "_drop"])
def test_a_crash_is_made_good_by_the_next_call(memory, monkeypatch, step):
    told(memory)
    real, calls = getattr(memory.store, step), []

    def crash(*args, **more):
        if step == "_write" and not more.get("overwrite"):
            return real(*args, **more)
        # The first folder to be dropped is one of a merged layer, not one that is erased.
        if step == "_drop" and not memory.store._names("erasures"):
            return real(*args, **more)
        calls.append(1)
        raise KeyboardInterrupt

    monkeypatch.setattr(memory.store, step, crash)
    with pytest.raises(KeyboardInterrupt):
        memory.erase("f1")
    assert calls
    monkeypatch.undo()
    after = Memory(memory.spark, memory.root)
    after.erase("f1")
    assert "alpha" not in held(after) and after.store._names("erasures") == []
    assert {r.id for r in after.store.table("facts").collect()} == {"f2", "f11"}
    for revision in after.store.revisions():
        assert not {"f1", "f3"} & {r.id for r in after.store.table("facts", revision).collect()}


def test_needles():
    needles = erasure.Needles(["f1", "`w_a`"], ["I live in Rome.", ""])
    assert [needles.within(t) for t in ("see [f1]", "f11", "xf1", "f1_b", "f1", "so: I live in Rome. Yes", "row `w_a` (x)", "w_a", None, "")] == [True, False, False, False, True, True, True, False, False, False]
    assert needles.scrubbed("a\nb f1\n\nc `w_a`\nd") == "a\n\nd"
    assert not erasure.Needles([], []).within("f1")


def test_superseded_rows_of_a_correction(memory):
    memory.request_change("remember", "r1", "w_a", fact("f1", "one thing"))
    memory.request_change("correct", "r2", "w_a", fact("f2", "another thing"), target="f1")
    memory.request_change("forget", "r3", "w_a", target="f1")
    assert {r.id for r in memory.store.table("facts").collect()} == {"f2"} and memory.store.table("controls").count() == 2
    assert change.prunable(memory.store.table("controls")).count() == 1


def test_an_index_is_made_by_the_first_read_and_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "INDEXED_BYTES", 200)
    store = Store(spark, str(tmp_path / "s"))
    texts = [(f"f{k}", f"Deploys of area{k} use blue script{k % 3}") for k in range(40)]
    store.publish(0, "r1", "", changes={"facts": facts(spark, [(i, "w_a", t, {}) for i, t in texts]).withColumn("gone", F.lit(False))})
    folder = tmp_path / "s" / store.layers("facts")[0]["index"]
    assert not folder.exists()  # a layer that is merged or erased before it is asked for never has one
    keys = [r[0] for r in spark.createDataFrame([("script1",), ("area7",)], "w string").select(wordindex.stem_key(F.col("w"))).collect()]
    found = [r.id for r in store.indexed(keys, part=wordindex.SEARCH).collect()]
    assert sorted(found) == sorted([i for k, (i, _) in enumerate(texts) if k % 3 == 1] + ["f7"])
    assert [p.name for p in folder.iterdir()] == [wordindex.SEARCH] and len(list((folder / wordindex.SEARCH).glob("part-*"))) > 1
    assert sorted(r.id for r in store.indexed(keys, part=wordindex.SEARCH).collect()) == sorted(found)


def test_an_erasure_of_many_needles_is_done_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(erasure, "BLOCK_CHARS", 40)
    seen, real = [], erasure.Needles
    monkeypatch.setattr(erasure, "Needles", lambda ids, statements: seen.append(sum(map(len, [*ids, *statements]))) or real(ids, statements))
    store = Store(spark, str(tmp_path / "s"))
    long = [(f"g{k}", "w_a", f"said by a {k:03}" + "!" * 500 * (k % 2), {}) for k in range(30)]
    others = [("o1", "w_b", "x", {"evidence": "as said by a 004 there"}), ("o2", "w_b", "y", {"evidence": "see g7", "aliases": ["g8", "g88", "z"]}), ("o3", "w_b", "said by a 006", {}), ("o4", "w_b", "z", {"evidence": "said by a 0", "aliases": None})]
    rows = facts(spark, long + others).withColumn("gone", F.lit(False))
    store.publish(0, "r0", "", changes={"facts": rows})
    gone = change.erasure_targets(store.ever("facts"), "w_a")
    assert store.rewrite(1, "e", "", erasure.sought(gone.select("id"), gone.select("statement")), store.table("controls").limit(0)) == 1
    for revision in (1, 2):
        assert sorted((r.id, r.evidence, r.aliases) for r in store.table("facts", revision).collect()) == [("o1", None, []), ("o2", None, ["z", "g88"][::-1]), ("o4", "said by a 0", None)]
    # No statement that is longer than every evidence and alias is sought in them, and none of all is sought at once.
    assert len(seen) > 5 and max(seen) < 150


def test_a_store_leaves_no_copies_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.storage.shared_dir", lambda spark: str(tmp_path / "shared"))
    store = Store(spark, str(tmp_path / "s"))
    for k in range(3):
        store.publish(k, f"r{k}", "", changes={"facts": facts(spark, [(f"f{k}", "w_a", "text", {})]).withColumn("gone", F.lit(False))})
    assert not list((tmp_path / "shared").glob("cut-*"))


def test_an_index_is_made_of_a_few_files_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FILE_ROWS", 5)
    monkeypatch.setattr(store_module, "INDEXED_FILES", 3)
    seen, real = [], wordindex.entries
    monkeypatch.setattr(wordindex, "entries", lambda rows, part: seen.append(rows.count()) or real(rows, part))
    store = Store(spark, str(tmp_path / "s"))
    store.publish(0, "r1", "", changes={"facts": facts(spark, [(f"f{k:02}", "w_a", f"Deploys of area{k}", {}) for k in range(40)]).withColumn("gone", F.lit(False))})
    keys = [r[0] for r in spark.createDataFrame([("deploy",), ("area7",)], "w string").select(wordindex.stem_key(F.col("w"))).collect()]
    assert sorted(r.id for r in store.indexed(keys, part=wordindex.SEARCH).collect()) == sorted([f"f{k:02}" for k in range(40)] + ["f07"])
    assert sum(seen) == 40 and max(seen) < 30 and len(seen) >= 3
