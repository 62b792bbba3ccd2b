"""Adapters for JSON lines: chat exports and the transcripts of coding agents.

Each takes lines (file, line, value) and gives (file, line, source_id, position, occurred_at, role,
content, metadata); ``journal.raw_events`` makes events of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.sources.files import field, has, parsed

# Fields that may hold a record's text, in order; parts of a message that are text.
TEXT_FIELDS = ("text", "message", "content", "body", "stem", "prompt", "input", "query")
NESTED_FIELDS = ("content", "message")
TEXT_PARTS = ("text", "input_text", "output_text")
OWN_FIELDS = ("text", "ts", "id", "role", "metadata")
NESTING = 2


def record_text(v: Column, at: tuple[str, ...] = ()) -> Column:
    """The text of a parsed record: its first text field that is not blank, a question with its choices, else all of it."""
    options = []
    for name in TEXT_FIELDS:
        said = F.trim(field(v, *at, name))
        options.append(F.when(said != "", said))
        if name in NESTED_FIELDS and len(at) < NESTING:
            inner = F.try_variant_get(v, "$" + "".join(f".{n}" for n in (*at, name)), "variant")
            found = record_text(v, (*at, name))
            options.append(F.when(inner.isNotNull() & (F.schema_of_variant(inner) != "STRING") & (F.trim(found) != ""), found))
    path = "$" + "".join(f".{n}" for n in at)
    stem = F.trim(field(v, *at, "question", "stem"))
    choices = F.try_variant_get(v, f"{path}.question.choices", "array<struct<text:string>>")
    named = F.filter(F.transform(F.coalesce(choices, F.array().cast("array<struct<text:string>>")), lambda c: c["text"]), lambda t: t.isNotNull())
    labels = F.when(F.size(named) > 0, F.concat(F.lit("\n"), F.array_join(named, "\n"))).otherwise("")
    options.append(F.when(stem != "", F.concat(stem, labels)))
    return F.coalesce(*options, F.to_json(F.try_variant_get(v, path, "variant")))


def message_text(v: Column, path: str) -> Column:
    """A message's content: a string without NULs, or its text parts, one to a line."""
    parts = F.try_variant_get(v, path, "array<struct<type:string, text:string>>")
    said = F.transform(F.filter(parts, lambda p: p["type"].isin(*TEXT_PARTS) & p["text"].isNotNull()), lambda p: p["text"])
    names = path.removeprefix("$.").split(".")
    plain = F.replace(field(v, *names), F.lit("\0"), F.lit(""))
    return F.coalesce(plain, F.array_join(said, "\n"), F.lit(""))


def _moment(v: Column, name: str) -> Column:
    return F.try_to_timestamp(field(v, name))


def _rows(df: DataFrame, source_id: Column, position: Column | int, occurred_at: Column, role: Column, content: Column, metadata: Column) -> DataFrame:
    at = F.lit(position) if isinstance(position, int) else position
    return df.select("file", "line", source_id.alias("source_id"), at.cast("long").alias("position"), occurred_at.alias("occurred_at"), role.alias("role"), content.alias("content"), metadata.alias("metadata"))


def chat_problems(lines: DataFrame) -> DataFrame:
    """(file, line, problem) of the lines that a lenient reading skips and a strict one fails on."""
    lines, v = parsed(lines), F.col("v")
    role = F.coalesce(field(v, "role"), F.lit("user"))
    problem = F.when(v.isNull(), "bad json").when(field(v, "id").isNull(), "missing id").when(text.role(role).isNull(), F.concat(F.lit("unknown role "), role))
    return lines.select("file", "line", problem.alias("problem")).filter("problem is not null")


def chat_export(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Records with an id, a known role (``user`` if none is given) and text; others are skipped, or fail a strict reading."""
    lines, v = parsed(lines), F.col("v")
    role = text.role(F.coalesce(field(v, "role"), F.lit("user")))
    given = F.get_json_object("value", "$.metadata")
    fields = F.from_json("value", "map<string,string>")
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*OWN_FIELDS))
    good = lines.filter(field(v, "id").isNotNull() & role.isNotNull())
    if strict:
        bad = F.concat(F.lit("line "), F.col("line") + 1, F.lit(": not a chat record"))
        ok = field(v, "id").isNotNull() & role.isNotNull()
        good = parsed(lines.withColumn("value", F.when(F.coalesce(ok, F.lit(False)), F.col("value")).otherwise(F.raise_error(bad))))
    found = _rows(good, field(v, "id"), 0, _moment(v, "ts"), role, record_text(v), F.coalesce(given, F.to_json(rest)))
    return found.filter(F.trim("content") != "")


def claude_transcript(lines: DataFrame) -> DataFrame:
    """Turns of users and assistants that name their session; the project is where the session ran."""
    lines, v = parsed(lines), F.col("v")
    kind, session = field(v, "type"), field(v, "sessionId")
    key = F.coalesce(field(v, "uuid"), F.concat(F.lit("line"), F.col("line").cast("string")))
    good = lines.filter(kind.isin("user", "assistant") & session.isNotNull() & has(v, "message"))
    found = _rows(good, F.concat(F.lit("claude:"), session, F.lit(":"), key), 0, _moment(v, "timestamp"), kind, message_text(v, "$.message.content"), _project(field(v, "cwd")))
    return found.filter(F.trim("content") != "")


def _project(cwd: Column) -> Column:
    return F.when(cwd.isNotNull(), F.to_json(F.struct(cwd.alias("project")))).otherwise(F.lit("{}"))


def codex_rollout(lines: DataFrame, session: str = "default") -> DataFrame:
    """Messages of a rollout; its last ``session_meta`` before a line gives the session and folder. Subagents' files are left out.

    Lines are first told apart by their type, so that the window over a file carries two strings, not texts.
    """
    lines, v = parsed(lines), F.col("v")
    kind, item = field(v, "type"), field(v, "payload", "type")
    meta = kind == "session_meta"
    subagent = meta & ((field(v, "payload", "thread_source") == "subagent") | F.get_json_object("value", "$.payload.source.subagent").isNotNull())
    agents = lines.filter(F.coalesce(subagent, F.lit(False))).select("file").distinct()
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heads = lines.select("file", "line", F.when(meta, F.struct(field(v, "payload", "id").alias("id"), field(v, "payload", "cwd").alias("cwd"))).alias("m"))
    heads = heads.withColumn("m", F.last("m", True).over(before))
    role = field(v, "payload", "role")
    channel = field(v, "payload", "channel")
    wanted = (kind == "response_item") & (item == "message") & role.isin("user", "assistant") & ((role == "user") | channel.isNull() | (channel == "final"))
    turns = lines.filter(wanted).join(heads, ["file", "line"]).join(agents, "file", "left_anti")
    said = message_text(v, "$.payload.content")
    said = F.when(role == "user", F.element_at(F.split(said, "</environment_context>"), -1)).otherwise(said)
    rollout = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    where = F.concat(F.lit("codex:"), F.coalesce("m.id", F.lit(session)), F.lit(":"), rollout, F.lit(":line"), F.col("line").cast("string"))
    return _rows(turns, where, 0, _moment(v, "timestamp"), role, said, _project(F.col("m.cwd"))).filter(F.trim("content") != "")


def opencode_store(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Text parts of messages of sessions, from three sets of files (file, content), joined on their ids.

    A message's file lies in its session's folder, a part's file in its message's.
    """
    folder = F.element_at(F.split("file", "/"), -2)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    v = F.col("v")
    s = parsed(sessions, "content").select(field(v, "id").alias("session"))
    m = parsed(messages, "content").select(folder.alias("session"), field(v, "id").alias("message"), field(v, "role").alias("said_by"))
    p = parsed(parts, "content").select("file", folder.alias("message"), stem.alias("key"), field(v, "type").alias("type"), field(v, "text").alias("said"))
    rows = p.filter("type = 'text'").join(m.filter(F.col("said_by").isin("user", "assistant")), "message").join(s.distinct(), "session").withColumn("line", F.lit(0))
    where = F.concat(F.lit("opencode:"), "session", F.lit(":"), "message", F.lit(":"), "key")
    found = _rows(rows, where, 0, F.lit(None).cast("timestamp"), F.col("said_by"), F.col("said"), F.lit("{}"))
    return found.filter(F.trim(F.replace("content", F.lit("\0"), F.lit(""))) != "")


def local_transcript(lines: DataFrame) -> DataFrame:
    """Transcripts as ``claude_transcript`` reads them; of files that give nothing that way, plain role and text rows."""
    first = claude_transcript(lines)
    lines, v = parsed(lines), F.col("v")
    rest = lines.join(first.select("file").distinct(), "file", "left_anti").filter(field(v, "role").isin("user", "assistant"))
    where = F.concat(F.lit("local:"), "file", F.lit(":"), F.col("line").cast("string"))
    plain = _rows(rest, where, 0, F.lit(None).cast("timestamp"), field(v, "role"), F.trim(F.coalesce(field(v, "text"), F.lit(""))), F.lit("{}"))
    return first.unionByName(plain.filter("content <> ''"))
