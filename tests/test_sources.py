import json

import pytest
from pyspark.sql import functions as F

from annalist.sources import chats, entities, files, notes


def lines(spark, *rows, file="/x/a.jsonl"):
    return spark.createDataFrame([(file, k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(rows)], "file string, line int, value string")


def said(df):
    return [(r.source_id, r.role, r.content) for r in df.orderBy("line").collect()]


def test_chat_export(spark):
    rows = lines(spark, {"id": "1", "text": "hi", "extra": 1}, {"id": "2", "role": "assistant", "content": "there", "ts": "2024-01-02T03:04:05Z"}, "broken", {"text": "no id"}, {"id": "3", "role": "boss", "text": "x"}, {"id": "4", "message": {"content": "deep"}}, {"id": "5", "text": " ", "query": "q"})
    found = chats.chat_export(rows)
    assert said(found) == [("1", "user", "hi"), ("2", "assistant", "there"), ("4", "user", "deep"), ("5", "user", "q")]
    assert found.filter("source_id = '2'").first().occurred_at is not None
    assert json.loads(found.filter("source_id = '1'").first().metadata) == {"extra": "1"}
    assert chats.chat_problems(rows).count() == 3
    with pytest.raises(Exception, match="not a chat record"):
        chats.chat_export(rows, strict=True).collect()


def test_records_without_a_text_field(spark):
    rows = lines(spark, {"id": "1", "n": 2}, {"id": "2", "question": {"stem": "why?", "choices": [{"text": "a"}, {"text": "b"}]}}, {"id": "3", "content": [{"type": "text", "text": "x"}]})
    found = dict((i, c) for i, _, c in said(chats.chat_export(rows)))
    assert json.loads(found["1"]) == {"id": "1", "n": 2} and found["2"] == "why?\na\nb"
    assert json.loads(found["3"]) == [{"type": "text", "text": "x"}]


def test_session_transcript(spark):
    rows = lines(
        spark,
        {"type": "user", "uuid": "u1", "sessionId": "S", "cwd": "/w/p", "message": {"content": "hello"}},
        {"type": "assistant", "sessionId": "S", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"type": "output_text", "text": "b"}]}},
        {"type": "summary", "sessionId": "S"},
        {"type": "user", "message": {"content": "no session"}},
        {"type": "user", "sessionId": "S", "message": {"content": " "}},
    )
    found = chats.claude_transcript(rows)
    assert said(found) == [("claude:S:u1", "user", "hello"), ("claude:S:line1", "assistant", "a\nb")]
    assert json.loads(found.filter("line = 0").first().metadata) == {"project": "/w/p"}


def item(role, text, **more):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}], **more}}


def test_rollouts(spark):
    rows = lines(
        spark,
        item("user", "before"),
        {"type": "session_meta", "payload": {"id": "A", "cwd": "/w"}},
        item("user", "<environment_context>x</environment_context> real"),
        item("assistant", "draft", channel="analysis"),
        item("assistant", "done", channel="final"),
        {"type": "session_meta", "payload": {"id": "B"}},
        item("user", "later"),
        item("developer", "no"),
        file="/r/roll.jsonl",
    )
    assert said(chats.codex_rollout(rows, "dflt")) == [
        ("codex:dflt:roll:line0", "user", "before"), ("codex:A:roll:line2", "user", " real"), ("codex:A:roll:line4", "assistant", "done"), ("codex:B:roll:line6", "user", "later")
    ]
    for payload in ({"id": "C", "thread_source": "subagent"}, {"id": "C", "source": {"subagent": "x"}}):
        assert chats.codex_rollout(lines(spark, {"type": "session_meta", "payload": payload}, item("user", "x"))).count() == 0


def test_plain_rows_of_a_local_transcript(spark):
    rows = lines(spark, {"role": "user", "text": " hi "}, {"role": "tool", "text": "x"}).unionByName(lines(spark, {"type": "user", "sessionId": "S", "uuid": "u", "message": {"content": "c"}, "role": "user", "text": "t"}, file="/x/b.jsonl"))
    assert sorted(said(chats.local_transcript(rows))) == [("claude:S:u", "user", "c"), ("local:/x/a.jsonl:0", "user", "hi")]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "p" / "node_modules").mkdir(parents=True)
    (tmp_path / "p" / "AGENTS.md").write_text("﻿# Rules\nuse tabs\n")
    (tmp_path / "p" / "node_modules" / "x.md").write_text("no")
    (tmp_path / "p" / "b.jsonl").write_text('{"type":"session_meta","payload":{"id":"C"}}\n')
    (tmp_path / "p" / "c.txt").write_text("no")
    found = files.files(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.collect()) == ["AGENTS.md", "b.jsonl"]
    note = notes.markdown(found.filter(files.extension(F.col("file")) == "md")).first()
    assert note.content == "# Rules\nuse tabs\n" and json.loads(note.metadata)["kind"] == "agents"
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in files.sniffed(files.lines(found)).collect()}
    assert kinds["b.jsonl"] == "codex"


def test_note_ids_follow_the_content(spark):
    rows = spark.createDataFrame([("/a/n.md", "one"), ("/b/n.md", "one"), ("/a/n.md", "two"), ("/c/n.md", "")], "file string, content string")
    ids = [r.source_id for r in notes.markdown(rows).collect()]
    assert len(ids) == 3 == len(set(ids)) and ids[0].rsplit(":", 1)[1] == ids[1].rsplit(":", 1)[1]


def test_calendar(spark):
    cal = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART:20240102T030405Z\r\nSUMMARY:Meet\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART:20240103\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT\r\n"
    found = notes.calendar(spark.createDataFrame([("/c.ics", cal)], "file string, content string")).orderBy("line").collect()
    assert [(r.source_id, r.position, str(r.occurred_at), r.content) for r in found] == [("1", 0, "2024-01-02 03:04:05", "Meet"), ("2", 1, "2024-01-03 00:00:00", "")]


def test_captions_without_cue_numbers(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = files.lines(spark.createDataFrame([("/v/talk.srt", "1\n00:00:01.500 --> 00:00:02\nHello\n\n2\n00:00:05,5 --> x\nWorld 3\nagain")], "file string, content string"))
    found = notes.captions(rows, start).orderBy("position").collect()
    assert [(r.source_id, r.content) for r in found] == [("talk", "Hello"), ("talk", "World 3"), ("talk", "again")]
    assert str(found[0].occurred_at) == "2024-01-01 00:00:01.500000" and found[1].occurred_at is None


def test_ide_history(spark):
    rows = spark.createDataFrame([("/i/h.ide.json", json.dumps({"events": [{"id": "a", "ts": "2024-01-01T00:00:00Z", "command": "ls", "result": "ok"}, {"command": "pwd", "result": {"n": 1}}]}))], "file string, content string")
    found = notes.ide_history(rows).orderBy("position").collect()
    assert [(r.source_id, r.role, r.content) for r in found] == [("a", "tool", "ls"), ("h.ide_1", "tool", "pwd")]
    assert json.loads(found[0].metadata) == {"result": "ok"} and json.loads(found[1].metadata) == {"result": {"n": 1}}


ENTITY = {"id": "w_a", "type": "project", "title": "A", "aliases": ["x"], "facts": [{"id": "f1", "predicate": "p", "statement": "Uses é: tabs", "status": "active"}, {"id": "f2", "predicate": "p", "statement": "old", "status": "superseded"}]}


def test_entity_round_trip(spark):
    text = entities.rendered(ENTITY | {"visibility": "private"})
    assert "visibility" not in text and "- [f1] Uses é: tabs" in text and "old\n" not in text.split("## Current")[1]
    back, body = entities.parsed(text)
    assert back["facts"] == ENTITY["facts"] and back["visibility"] == "private" and body.startswith("# A")
    rows = entities.parse(spark.createDataFrame([("m.md", text), ("bad.md", "no front"), ("bad2.md", "---\nid: \"x\"\n---\n")], "file string, content string")).collect()
    assert [(r.entity_id, r.ord, r.id, r.status) for r in rows] == [("w_a", 0, "f1", "active"), ("w_a", 1, "f2", "superseded")]


@pytest.mark.parametrize("text", ["x", "---\nid: \"a\"\n", "---\nid: \"a\"\ntype: \"t\"\n---\n", "---\nid: \"a\"\ntype: \"t\"\ntitle: \"x\"\nfacts: [{\"id\": \"\"}]\n---\n"])
def test_broken_entity_files(text):
    with pytest.raises(ValueError):
        entities.parsed(text)
