"""Facts from events: rules on what users say, and a gate for what a model proposes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import passages, text
from annalist.functions import words as W
from annalist.operators import packing

BATCH_BYTES, NOTE_CHARS, USER_CHARS = 16_000, 8_000, 2_000
KNOWN_ENTITIES, KNOWN_FACTS, KNOWN_BYTES = 200, 40, 8_000
#: The least characters of a quote that is looked for, and those of a token's piece: the longer of two words has as many.
QUOTE_CHARS, PIECE = 8, 4


def rule_proposals(events: DataFrame) -> DataFrame:
    """(seq, event_id, k, id, entity_id, entity_type, title, predicate, statement, evidence) of user turns.

    ``k`` numbers the proposals of an event: names, then homes, then wishes.
    """

    def each(rule: str, entity: Callable[[Column], Column], kind: str, title: Callable[[Column], Column], predicate: str, say: str, end: str, trim: bool) -> Column:
        # The whole match and its group are extracted in step.
        whole, group = F.regexp_extract_all("content", F.lit(rule), 0), F.regexp_extract_all("content", F.lit(rule), 1)

        def made(pair: Column) -> Column:
            said = F.trim(pair["group"]) if trim else pair["group"]
            return F.struct(
                entity(said).alias("entity_id"),
                F.lit(kind).alias("entity_type"),
                title(said).alias("title"),
                F.lit(predicate).alias("predicate"),
                F.concat(F.lit(say), said, F.lit(end)).alias("statement"),
                pair["whole"].alias("evidence"),
            )

        return F.transform(F.arrays_zip(whole.alias("whole"), group.alias("group")), made)

    found = F.concat(
        each(W.NAME_RULE, lambda s: F.concat(F.lit("p_"), text.slug(s)), "person", lambda s: s, "name", "User's name is ", ".", False),
        each(W.HOME_RULE, lambda s: F.lit("p_user"), "person", lambda s: F.lit("User"), "home_city", "User lives in ", ".", True),
        each(W.WISH_RULE, lambda s: F.lit("pref_user"), "preference", lambda s: F.lit("User preferences"), "comms_preference", "User requested: ", "", True),
    )
    rows = events.filter(F.col("role") == "user").select("seq", "event_id", F.posexplode(found).alias("k", "p")).select("seq", "event_id", "k", "p.*")
    return rows.withColumn("id", text.fact_id(F.col("entity_id"), F.col("predicate"), F.col("statement")))


def dispositions(events: DataFrame) -> DataFrame:
    """(seq, reason): why the rules set an event aside; a null reason: it was accepted."""
    hit = F.lit(False)
    for rule in (W.NAME_RULE, W.HOME_RULE, W.WISH_RULE):
        hit = hit | F.col("content").rlike(rule)
    reason = F.when(F.col("role") != "user", "not a user statement").when(~hit, "no high-confidence pattern matched")
    return events.select("seq", reason.alias("reason"))


def by_reason(found: DataFrame) -> DataFrame:
    """(reason, seqs): the events set aside, by reason."""
    return found.filter("reason is not null").groupBy("reason").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))


def candidates(events: DataFrame) -> DataFrame:
    """(seq, k, said): what a model may read of user turns and notes; notes in pieces."""
    said = F.when(F.col("role") == "note", F.col("content")).when(F.col("role") == "user", text.own_words(F.col("content")))
    rows = events.filter(F.col("role").isin("user", "note")).withColumn("said", said).filter(F.trim(F.coalesce("said", F.lit(""))) != "")
    pieces = F.when(F.col("role") == "note", passages.chunks_column(F.col("said"), NOTE_CHARS)).otherwise(F.array(F.left("said", F.lit(USER_CHARS))))
    return rows.select("seq", F.posexplode(pieces).alias("k", "said"))


Client = Callable[..., list[dict]]


def model_proposals(rows: DataFrame, client: Client, told: list[dict] | None = None) -> DataFrame:
    """(ref, lasting, entity_type, entity_name, predicate, statement, evidence) from a client, one call for each pack.

    ``rows`` are as ``candidates`` gives them. They are packed in order of seq, all of them together, so
    that a call's content does not depend on how rows are dealt; calls are made by many tasks. With
    ``told``, a bounded list as ``known_entities`` gives it, the client gets that as its second argument.
    """
    schema = "ref long, lasting boolean, entity_type string, entity_name string, predicate string, statement string, evidence string"
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = pa.schema([("ref", pa.int64()), ("lasting", pa.bool_()), *((n, pa.string()) for n in names[2:])])
    more = () if told is None else (told,)

    def call(own):
        items = own.sort_by([("seq", "ascending"), ("k", "ascending")]).to_pylist()
        refs = {x["seq"] for x in items}
        found = client([{"ref": x["seq"], "text": x["said"]} for x in items], *more)
        return pa.Table.from_pylist([{n: f.get(n) for n in names} for f in found if f.get("ref") in refs], arrow)

    packed = packing.packs(rows.select("seq", "k", "said"), ["seq", "k"], F.octet_length("said"), BATCH_BYTES)
    return packed.groupBy("pack").applyInArrow(call, schema)


def event_project(event: str = "") -> Column:
    """The event's project, else the folder of a note's file."""
    path = F.regexp_replace(F.regexp_replace("source_id", "^md:", ""), ":[^:]*$", "")
    folder = F.element_at(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), -1)
    from_file = F.when((F.col("source_kind") == "ide_history") & path.contains("/"), folder)
    return F.coalesce(text.project_name(F.col("project")), from_file, F.lit(""))


def gated(proposed: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Model proposals with ``reason`` (null: accepted), and entity, title and predicate resolved.

    A proposal of an event outside the batch is dropped by the inner join.
    """
    own = events.select(F.col("seq").alias("ref"), "event_id", "content", "role", event_project().alias("project_name"))
    rows = proposed.join(own, "ref").join(entities.select(F.col("entity_id").alias("known"), F.col("title").alias("known_title")), F.trim("entity_name") == F.col("known"), "left")
    typed = F.col("entity_type").isin("person", "org", "preference")
    start = F.when(F.col("entity_type") == "person", "p").when(F.col("entity_type") == "org", "o").when(F.col("entity_type") == "preference", "pref").otherwise("w")
    name = F.regexp_replace(text.slug(F.col("entity_name")), "^(pref_|p_|o_|w_|c_)", "")
    project = text.slug(F.col("project_name"))
    entity = F.when(~typed & (project != ""), F.concat(F.lit("w_"), project)).when(F.col("known").isNotNull(), F.col("known")).when(name != "", F.concat(start, F.lit("_"), name))
    statement, evidence, predicate = F.trim("statement"), F.trim("evidence"), text.slug(F.col("predicate"))
    reason = (
        F.when(~F.coalesce("lasting", F.lit(False)), "not lasting (true for one session only)")
        .when(F.char_length(evidence) < 8, "evidence too short")
        .when(~F.char_length(statement).between(8, 600), "statement empty or over 600 characters")
        .when(~passages.quoted_column(F.col("content"), evidence), "evidence not found in the cited event")
        .when(predicate == "", "no predicate")
        .when(entity.isNull(), "no entity name")
    )
    return rows.select(
        F.col("ref").alias("seq"),
        "event_id",
        entity.alias("entity_id"),
        F.when(typed, F.col("entity_type")).otherwise("project").alias("entity_type"),
        F.coalesce("known_title", F.when(~typed & (F.col("project_name") != ""), F.col("project_name")).otherwise(F.trim("entity_name"))).alias("title"),
        predicate.alias("predicate"),
        statement.alias("statement"),
        evidence.alias("evidence"),
        reason.alias("reason"),
    )


def contained(source: DataFrame, quotes: DataFrame, source_text: str, quote_text: str) -> DataFrame:
    """Pairs of a text and a quote of eight characters or more that it contains after normalising.

    They are joined on a word: the longest inner one of a quote must be a token of the text. A quote of
    two words has none, but the longer of them ends or begins a token, and a quote of one word lies
    within a token; these are joined on pieces of tokens. All keys of a text are found and exploded in
    one pass, each once, and containment is then checked.
    """
    normal = quotes.withColumn("quote_normal", text.normalised(F.col(quote_text))).filter(F.char_length("quote_normal") >= QUOTE_CHARS)
    said = F.split("quote_normal", " ")
    inner = F.array_max(F.transform(F.slice(said, F.lit(2), F.greatest(F.size(said) - 2, F.lit(0))), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("w"))))["w"]
    first, last = said[0], F.try_element_at(said, F.lit(2))
    behind = F.char_length(last) >= F.char_length(first)
    short = F.when(F.size(said) == 1, F.left(first, F.lit(QUOTE_CHARS))).when(behind, F.concat(F.lit(" "), F.left(last, F.lit(PIECE)))).otherwise(F.concat(F.right(first, F.lit(PIECE)), F.lit(" ")))
    keyed = normal.withColumn("key", F.when(F.size(said) > 2, inner).otherwise(short))
    texts = source.withColumn("source_normal", text.normalised(F.col(source_text)))
    keys = F.split("source_normal", " ")
    if not normal.filter(F.size(said) <= 2).isEmpty():
        # At each place what begins a token, ends one, or lies within one.
        piece = rf"(?=( [^ ]{{{PIECE}}}|[^ ]{{{QUOTE_CHARS}}}|[^ ]{{{PIECE}}} ))"
        keys = F.concat(keys, F.regexp_extract_all(F.concat(F.lit(" "), "source_normal", F.lit(" ")), F.lit(piece), 1))
    return texts.withColumn("key", F.explode(F.array_distinct(keys))).join(keyed, "key").filter(F.contains("source_normal", "quote_normal")).drop("key")


def known_entities(facts: DataFrame) -> list[dict]:
    """What a model is told of entities: two hundred, forty statements each, while a budget of bytes lasts."""
    live = facts.filter("status = 'active'")
    some = live.select("entity_id").distinct().orderBy("entity_id").limit(KNOWN_ENTITIES)
    first = live.join(some, "entity_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy("ord", "statement"))).filter(F.col("k") <= KNOWN_FACTS)
    rows = first.groupBy("entity_id").agg(F.min_by("title", "k").alias("title"), F.sort_array(F.collect_list(F.struct("ord", "statement"))).alias("facts"))
    budget, out = KNOWN_BYTES, []
    for row in rows.orderBy("entity_id").limit(KNOWN_ENTITIES).collect():
        shown = []
        for fact in row.facts:
            size = len(fact.statement.encode())
            if budget < size:
                break
            budget -= size
            shown.append(fact.statement)
        out.append({"id": row.entity_id, "title": row.title, "facts": shown})
    return out


def outdated(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """Ids of active facts whose sources all are older versions of notes that have come anew.

    ``notes`` are note events of one batch; the last version of a file is current. A version's id ends
    in a hash after its last colon.
    """
    newest = (
        notes.filter((F.col("role") == "note") & F.startswith("event_id", F.lit("evt_ide_md:")))
        .select(F.regexp_replace("event_id", "[^:]*$", "").alias("file"), "event_id", "seq")
        .groupBy("file")
        .agg(F.max_by("event_id", "seq").alias("current"))
    )
    sources = facts.filter("status = 'active'").select("id", F.explode("source_ids").alias("event_id"))
    checked = sources.withColumn("file", F.regexp_replace("event_id", "[^:]*$", "")).join(newest, "file", "left")
    older = F.coalesce(F.col("current") != F.col("event_id"), F.lit(False))
    return checked.groupBy("id").agg(F.every(older).alias("old")).filter("old").select("id")
