import json

import pytest
from pyspark.sql import functions as F

from annalist.api import Memory, NotFound
from annalist.storage import Locked, only_writer
from annalist.store import Conflict, Invalid
from annalist.streaming import consolidate


def chat(path, said, start=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"id": f"{path.stem}-{start + k}", "role": r, "text": t}) for k, (r, t) in enumerate(said)))
    return str(path)


def fact(i, statement, **more):
    return {"id": i, "predicate": "note", "statement": statement, **more}


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "memory"))


def test_lifecycle(memory, tmp_path):
    log = chat(tmp_path / "in" / "a.jsonl", [("user", "My name is Ada."), ("assistant", "Hello Ada"), ("user", "Please always use tabs in this code."), ("user", "what is the weather")])
    assert memory.ingest(log) == {"new": 4, "skipped": 0}
    assert memory.ingest(log) == {"new": 0, "skipped": 4}
    assert memory.status()["events"] == 4 and memory.status()["lag"] == 4
    out = memory.consolidate("batch-1")
    assert (out["events"], out["accepted"], out["facts"]) == (4, 2, 2)
    assert out["quarantined"] == {"not a user statement": [2], "no high-confidence pattern matched": [4]}
    assert memory.consolidate("batch-1")["replayed"] and memory.consolidate("batch-2")["caught_up"]
    assert memory.status()["lag"] == 0 and memory.status()["active_facts"] == 2
    hits = memory.search("tabs")
    assert hits[0]["statement"] == "User requested: use tabs in this code" and hits[1]["id"].startswith("journal:")
    assert memory.read(hits[1]["id"])["statement"] == "Please always use tabs in this code."
    assert memory.read("p_ada")["statement"] == "User's name is Ada."
    assert memory.history("p_ada")["records"][0]["label"] == "current"
    assert "- `p_ada` (person) Ada — 1 active fact" in memory.index()
    assert memory.validate().count() == 0


def test_changes_are_applied_once(memory):
    first = memory.request_change("remember", "r1", "w_app", fact("f1", "The app uses tabs"))
    again = memory.request_change("remember", "r1", "w_app", fact("f1", "The app uses tabs"))
    assert first.revision == again.revision and again.replayed and not first.replayed
    with pytest.raises(Conflict):
        memory.request_change("remember", "r1", "w_app", fact("f1", "something else"))
    memory.request_change("correct", "r2", "w_app", fact("f2", "The app uses spaces"), target="f1")
    assert memory.read("f1")["label"] == "non-current" and memory.read("w_app")["fact_id"] == "f2"
    assert [r["status"] for r in memory.history("w_app")["records"]] == ["superseded", "active"]
    memory.request_change("forget", "r3", "w_app", target="f2", reason="wrong")
    with pytest.raises(NotFound):
        memory.read("f2")
    assert memory.search("spaces", facts_only=True) == []


def test_bad_changes(memory):
    for kind, entity, record, target in (("remember", "", fact("a", "b"), None), ("remember", "w_a", None, None), ("forget", "w_a", None, None), ("forget", "w_a", None, "gone"), ("rename", "w_a", fact("a", "b"), None)):
        with pytest.raises(Invalid):
            memory.request_change(kind, "x1", entity, record, target)
    with pytest.raises(Invalid):
        memory.request_change("remember", "no spaces", "w_a", fact("a", "b"))
    assert memory.store.head() == 0


def test_stale_base_is_a_conflict(memory):
    memory.request_change("remember", "r1", "w_a", fact("f1", "one"))
    rows = memory.store.table("facts")
    with pytest.raises(Conflict):
        memory.store.publish(0, "r2", "d", {"facts": rows})
    assert memory.store.publish(1, "r3", "d", {"facts": rows}).revision == 2
    assert memory.store.table("facts", 1).count() == 1


def test_two_writers_with_one_base(memory):
    from concurrent.futures import ThreadPoolExecutor

    def publish(k):
        try:
            return memory.store.publish(0, f"w{k}", "d", state={"by": k}).revision
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(publish, range(4)))
    assert sorted(map(str, out)) == ["1", "None", "None", "None"] and memory.store.head() == 1
    assert memory.store.manifest()["state"]["by"] == out.index(1)


def test_interrupted_changes_are_finished(memory):
    request = {"kind": "remember", "request_id": "r1", "entity_id": "w_a", "fact": fact("f1", "one"), "target": None, "reason": ""}
    memory.store.write_intent("r1", {"base": 0, "request": request})
    memory.store.write_intent("r2", {"base": 7, "request": request | {"request_id": "r2"}})
    assert memory.recover() == {"r1": "published", "r2": "conflict"}
    assert memory.read("f1")["statement"] == "one" and memory.status()["stale"] == 1 and memory.status()["pending"] == 0


def test_restated_facts_are_not_stored_twice(memory, tmp_path):
    said = [("user", "please always use four spaces for python indentation"), ("user", "Please never forget: use four spaces python indentation."), ("user", "please always answer in French")]
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", said))
    assert memory.consolidate("b1")["facts"] == 2


def test_batches_resume(memory, tmp_path):
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", f"my name is Name{chr(65 + k)}") for k in range(5)]))
    assert memory.consolidate_all("all", 2) == 3
    assert memory.status()["active_facts"] == 5 and memory.status()["lag"] == 0
    memory.ingest(chat(tmp_path / "in" / "b.jsonl", [("user", "my name is Zed")]))
    assert memory.consolidate("more")["events"] == 1


def test_erased_for_good(memory, tmp_path):
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", "my name is Ada"), ("user", "I live in Paris.")]))
    memory.consolidate("b1")
    target = memory.read("p_ada")["fact_id"]
    out = memory.erase(target)
    assert out["facts"] == 1 and out["events"] == 1
    for revision in memory.store.revisions():
        assert memory.store.table("facts", revision).filter(F.col("id") == target).count() == 0
    assert memory.journal.events().filter("content = '[erased]'").count() == 1
    assert memory.erase(target) == {"facts": 0, "events": 0, "folders": 0, "same_statement": 0}
    with pytest.raises(NotFound):
        memory.erase("fact_unknown")
    assert memory.ingest(str(tmp_path / "in")) == {"new": 0, "skipped": 2}
    assert memory.read("p_user")["statement"] == "User lives in Paris."


def test_forgotten_facts_are_not_extracted_again(memory, tmp_path):
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", "my name is Ada")]))
    memory.consolidate("b1")
    memory.request_change("forget", "f1", "p_ada", target=memory.read("p_ada")["fact_id"])
    memory.ingest(chat(tmp_path / "in" / "b.jsonl", [("user", "my name is Ada")]))
    assert memory.consolidate("b2")["facts"] == 0


def test_tidy(memory):
    memory.request_change("remember", "r1", "w_app", fact("f1", "The app builds with vite and pnpm on node twenty"))
    memory.request_change("remember", "r2", "w_app", fact("f2", "app builds with vite and pnpm"))
    memory.request_change("remember", "r3", "w_other", fact("f3", "Another thing entirely different here"))
    assert [(r.id, r.duplicate_of) for r in memory.tidy().collect()] == [("f2", "f1")]
    assert memory.tidy(keep=("f2",)).count() == 0
    judged = memory.tidy(judge=lambda items: [x["id"] for x in items if "Another" in x["statement"]])
    assert {(r.id, r.kind) for r in judged.collect()} == {("f2", "duplicate"), ("f3", "session_only")}
    memory.tidy(apply=True)
    assert {r.id for r in memory.store.table("facts").collect()} == {"f1", "f3"}


def test_tasks(memory):
    assert memory.tasks_read() == {"version": 0, "tasks": []}
    assert memory.tasks_update(0, {"id": "t1", "title": "x"}, "t-1")["version"] == 1
    with pytest.raises(Conflict):
        memory.tasks_update(0, {"id": "t2", "title": "y"}, "t-2")
    assert memory.tasks_update(0, {"id": "t1", "title": "x"}, "t-1")["version"] == 1


def test_evaluation_and_export(memory):
    memory.request_change("remember", "r1", "w_app", fact("f1", "Deploys use the blue script", visibility="shared"))
    memory.request_change("remember", "r2", "pref_user", fact("f2", "Prefers short answers"))
    scores = memory.evaluate([{"id": "c1", "question": "blue script", "expected_fact_ids": ["f1"], "must_include": ["BLUE"]}, {"id": "c2", "question": "green", "expected_fact_ids": ["f1"]}])
    assert {r.case_id: r.passed for r in scores.collect()} == {"c1": True, "c2": False}
    made = memory.export("Project", "# Mine\n")
    assert made.index("## Project") < made.index("## Preferences") and "- [f1] Deploys use the blue script _(shared)_" in made
    assert memory.export("Project", made).count("memory:begin") == 1
    assert "f1" not in memory.export("x", None, project="other")


def test_a_client_proposes_and_is_told_what_is_known(memory, tmp_path):
    memory.request_change("remember", "r1", "w_shop", fact("f1", "The shop deploys on Mondays"))
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", "The till is restarted every single night"), ("assistant", "ok")]))

    def client(batch, told):
        known = " and ".join(x["id"] + ": " + x["facts"][0] for x in told)
        return [{"ref": x["ref"], "lasting": True, "entity_type": "preference", "entity_name": "till", "predicate": "habit", "statement": f"Known is {known}.", "evidence": x["text"]} for x in batch]

    out = memory.consolidate("batch-1", client=client, tell=True)
    assert (out["events"], out["accepted"], out["facts"]) == (2, 1, 1)
    assert "Known is w_shop: The shop deploys on Mondays." in [r.statement for r in memory.store.table("facts").collect()]
    index = memory.export_parts(str(tmp_path / "parts")).collect()
    assert sum(r.bytes for r in index) == sum(p.stat().st_size for p in (tmp_path / "parts" / "lines").glob("part-*"))


def test_scopes_and_sources(memory, tmp_path):
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", "needle in mine")]), scope="personal")
    memory.ingest(chat(tmp_path / "in" / "b.jsonl", [("user", "needle in theirs")]), scope="team")
    assert len(memory.search("needle")) == 2
    assert [h["entity_id"] for h in memory.search("needle", scope="team")] == ["team"]
    assert len(memory.search("needle", sources=["A-"])) == 1


def test_streamed_events_are_published_once(spark, memory, tmp_path):
    memory.ingest(chat(tmp_path / "in" / "a.jsonl", [("user", "my name is Ada")]))
    seen = []

    def publish(batch, number):
        seen.append((number, batch.count()))

    stream = lambda: spark.readStream.schema(memory.journal.events().schema).parquet(memory.journal.path)
    consolidate.follow(stream(), publish, str(tmp_path / "offsets"))
    consolidate.follow(stream(), publish, str(tmp_path / "offsets"))
    memory.ingest(chat(tmp_path / "in" / "b.jsonl", [("user", "my name is Bob"), ("user", "x")]))
    consolidate.follow(stream(), publish, str(tmp_path / "offsets"))
    assert [n for _, n in seen] == [1, 2]


def test_what_was_forgotten_is_erased_from_old_revisions(memory):
    memory.request_change("remember", "r1", "w_app", fact("fact_7", "secret alpha"))
    memory.request_change("remember", "r2", "w_app", fact("fact_77", "another thing"))
    memory.request_change("correct", "r3", "w_app", fact("fact_8", "secret beta"), target="fact_7")
    memory.request_change("forget", "r4", "w_app", target="fact_7")
    memory.store.write_intent("q1", {"base": 1, "request": {"kind": "forget", "entity_id": "w_app", "target": "fact_77", "fact": None}})
    memory.store.write_intent("q2", {"base": 1, "request": {"kind": "forget", "entity_id": "w_app", "target": "fact_7", "fact": None}})
    assert memory.store.ever("facts").filter("id = 'fact_7'").count() > 0
    assert memory.erase("fact_7")["facts"] == 1
    for revision in memory.store.revisions():
        rows = memory.store.table("facts", revision)
        assert rows.filter("id = 'fact_7' or statement like '%alpha%'").count() == 0
        assert revision < 2 or rows.filter("id = 'fact_77'").count() == 1
    assert set(memory.store.intents()) == {"q1"}
    assert memory.erase("fact_7") == {"facts": 0, "events": 0, "folders": 0, "same_statement": 0}


def test_a_pruned_fact_goes_with_its_entity(memory):
    memory.request_change("remember", "r1", "w_app", fact("fact_1", "old words"))
    memory.request_change("forget", "r2", "w_app", target="fact_1")
    memory.request_change("remember", "r3", "w_app", fact("fact_2", "new words"))
    assert memory.erase("w_app")["facts"] == 2
    assert memory.store.ever("facts").count() == 0


def test_one_writer_at_a_time(memory, spark):
    first = memory.journal.append_one("chat", "a:1", "user", "hello")
    assert memory.journal.append_one("chat", "a:2", "user", "again") == first + 1
    assert memory.journal.append_one("chat", "a:1", "user", "hello") == first
    with only_writer(spark, f"{memory.journal.path}.lock"), pytest.raises(Locked):
        memory.journal.append_one("chat", "a:3", "user", "more")
    assert memory.journal.append_one("chat", "a:3", "user", "more") == first + 2
    assert [r.n for r in memory.journal.days().collect()] == [3]


def test_session_stores_and_own_adapters(spark, tmp_path):
    store = tmp_path / "storage"
    for name, content in {"session/p/S1.json": {"id": "S1"}, "message/S1/m1.json": {"id": "m1", "role": "user"}, "part/m1/t1.json": {"type": "text", "text": "from a store"}}.items():
        (store / name).parent.mkdir(parents=True, exist_ok=True)
        (store / name).write_text(json.dumps(content))
    (tmp_path / "own.jsonl").write_text(json.dumps({"role": "user", "text": "plain row"}))
    none = F.lit(None).cast("timestamp")
    own = ("chat", lambda found: found.select(F.lit("own:1").alias("source_id"), F.lit(0).alias("position"), none.alias("occurred_at"), F.lit("user").alias("role"), F.upper("content").alias("content"), F.lit("{}").alias("metadata"), "file", F.lit(0).alias("line")))
    memory = Memory(spark, str(tmp_path / "memory"), adapters={"loud": own})
    assert memory.ingest(str(store), adapter="session_store") == {"new": 1, "skipped": 0}
    assert memory.ingest(str(tmp_path / "own.jsonl"), adapter="local_transcript") == {"new": 1, "skipped": 0}
    assert memory.ingest(str(tmp_path / "own.jsonl"), adapter="loud") == {"new": 1, "skipped": 0}
    said = {r.content for r in memory.journal.events().collect()}
    assert {"from a store", "plain row"} < said and any("PLAIN ROW" in s for s in said)
    with pytest.raises(Invalid):
        memory.ingest(str(store), adapter="none")


def test_index_is_published_only_if_it_changed(memory):
    memory.request_change("remember", "r1", "w_app", fact("fact_1", "words [fact_9]"))
    assert memory.publish_index().revision == 2 and memory.publish_index() is None
    assert "`w_app`" in memory.store.manifest()["state"]["index"]
    assert {(r.problem, r.what) for r in memory.validate().collect()} == {("unknown reference", "fact_9")}
    with pytest.raises(Invalid):
        memory.store.publish(2, "back", "d", state={"through_seq": -1})
    assert [r["active_facts"] for r in memory.session_start("w_app")] == [1]
