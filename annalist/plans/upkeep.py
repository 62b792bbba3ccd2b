"""Queries for extraction, restatement, changes, erasure, validation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import passages, text
from annalist.operators import change, eligibility, erasure, extract, packing, report, similarity, validate
from annalist.plans import sql
from annalist.plans.views import conversation_events, document_facts, label_controls, own_store, stored_facts, table
from annalist.storage import cut


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that open with sentences the rules know."""
    n = F.col("seq") % 5
    name = F.concat(F.lit("My Name is Ann"), F.col("session_id"), F.lit("x and my name is Bo-"), F.col("session_id"), F.lit("y. "))
    opening = (
        F.when(n == 0, F.regexp_replace(F.regexp_replace(name, "[0-9]", "q"), "q", "k"))
        .when(n == 1, F.lit("I am living in New Town . "))
        .when(n == 2, F.lit("please always use tabs! Please never do that? "))
        .when(n == 3, F.lit("i live in Rome, please don't shout. "))
        .otherwise("")
    )
    return conversation_events(spark, sf_dir).withColumn("content", F.concat(opening, "content"))


def rule_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in users' turns."""
    found = extract.rule_proposals(_said(spark, sf_dir))
    return found.select("seq", F.col("k").cast("long").alias("k"), "id", "entity_id", "title", "predicate", "statement", "evidence")


RULES_SQL = f"""
with {sql.CONVERSATION_EVENTS},
n as (select *, seq % 5 as n, repeat('k', length(session_id)) as q from j_conv where role = 'user'),
p as (
  select seq, 0 as k, 'p_' || lower('ann' || q || 'x') as entity_id, 'Ann' || q || 'x' as title, 'name' as predicate, 'User''s name is Ann' || q || 'x.' as statement, 'My Name is Ann' || q || 'x' as evidence from n where n = 0
  union all select seq, 1, 'p_bo_' || q || 'y', 'Bo-' || q || 'y', 'name', 'User''s name is Bo-' || q || 'y.', 'my name is Bo-' || q || 'y' from n where n = 0
  union all select seq, 0, 'p_user', 'User', 'home_city', 'User lives in New Town.', 'I am living in New Town ' from n where n = 1
  union all select seq, 0, 'pref_user', 'User preferences', 'comms_preference', 'User requested: use tabs', 'please always use tabs' from n where n = 2
  union all select seq, 1, 'pref_user', 'User preferences', 'comms_preference', 'User requested: do that', 'Please never do that' from n where n = 2
  union all select seq, 0, 'p_user', 'User', 'home_city', 'User lives in Rome.', 'i live in Rome' from n where n = 3
  union all select seq, 1, 'pref_user', 'User preferences', 'comms_preference', 'User requested: shout', 'please don''t shout' from n where n = 3)
select seq, k, 'fact_' || left(sha256(entity_id || '|' || predicate || '|' || lower(statement)), 12) as id, entity_id, title, predicate, statement, evidence from p"""


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why events were set aside: each reason with its events."""
    found = extract.by_reason(extract.dispositions(_said(spark, sf_dir)))
    return found.select("reason", F.size("seqs").cast("long").alias("n"), F.md5(F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",")).alias("seqs"))


DISPOSITIONS_SQL = f"""
with {sql.CONVERSATION_EVENTS}, r as (select seq, case when role <> 'user' then 'not a user statement' when seq % 5 = 4 then 'no high-confidence pattern matched' end as reason from j_conv)
select reason, count(*) as n, md5(string_agg(cast(seq as varchar), ',' order by seq)) as seqs from r where reason is not null group by 1"""


def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may read: users' own words and notes, clipped or in pieces."""
    e = conversation_events(spark, sf_dir).select("seq", "role", "content")
    return extract.candidates(e).select("seq", F.col("k").cast("long").alias("k"), F.md5("said").alias("said"))


def _client(batch: list[dict]) -> list[dict]:
    """A client of fixed behaviour: proposals follow from the numbers; every fifth cites what was not said."""
    out = []
    for x in batch:
        n, said = x["ref"], x["text"].strip()
        quote = "nobody ever said this" if n % 5 == 0 else said[:40]
        out.append({"ref": n, "lasting": n % 7 > 0, "entity_type": ("person", "project", "preference")[n % 3], "entity_name": f"w_Name {n % 4}", "predicate": "Says So", "statement": f"It was said at {n}.", "evidence": quote})
    return [*out, {"ref": -1, "lasting": True, "entity_type": "org", "entity_name": "x", "predicate": "p", "statement": "out of the batch", "evidence": "x" * 9}]


def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of a client of fixed behaviour, accepted or with the reason against them."""
    e = conversation_events(spark, sf_dir).filter("role = 'user'")
    known = e.limit(0).select(F.lit("").alias("entity_id"), F.lit("").alias("title"))
    proposed = extract.model_proposals(extract.candidates(e), _client)
    return extract.gated(proposed, e, known).select("seq", "entity_id", "entity_type", "predicate", "reason")


GATE_SQL = f"""
with {sql.CONVERSATION_EVENTS}, u as (select *, trim(regexp_replace(content, '^\\s+', ''), ' ') as said from j_conv where role = 'user' and trim(content, ' ') <> '')
select seq, case when seq % 3 = 1 then 'w_project' || (cast(session_id as bigint) % 7) when seq % 3 = 0 then 'p_name_' || (seq % 4) else 'pref_name_' || (seq % 4) end as entity_id,
       ['person', 'project', 'preference'][seq % 3 + 1] as entity_type, 'says_so' as predicate,
       case when seq % 7 = 0 then 'not lasting (true for one session only)' when seq % 5 > 0 and length(left(said, 40)) < 8 then 'evidence too short'
            when seq % 5 = 0 then 'evidence not found in the cited event' end as reason
from u"""


def evidence_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or pieces of its first two words or of its first word, as a quote."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    quotes = F.array("text", F.regexp_extract("text", r"^\s*\S(\S+\s+\S+)", 1), F.regexp_extract("text", r"^\s*(\S+)", 1))
    b = b.select("item_id", F.posexplode(quotes).alias("part", "quote"))
    return extract.contained(d, b, "text", "quote").select("doc_id", "item_id", F.col("part").cast("long").alias("part"))


EVIDENCE_SQL = f"""
with d as (select doc_id, {sql.normalised("text")} as s from documents),
p as (select item_id, unnest([0, 1, 2]) as part, unnest([text, regexp_extract(text, '^\\s*\\S(\\S+\\s+\\S+)', 1), regexp_extract(text, '^\\s*(\\S+)', 1)]) as q from benchmark),
b as (select item_id, cast(part as bigint) as part, {sql.normalised("q")} as q from p)
select doc_id, item_id, part from d, b where length(q) >= 8 and contains(s, q)"""


def quotes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn quoted in two halves with an elision between them: found if a half is long enough to count."""
    c = table(spark, sf_dir, "conversations")
    half = F.floor(F.char_length("text") / 2).cast("int")
    quote = F.concat(F.lit("**"), F.left("text", half), F.lit("** … "), F.substring(F.col("text"), half + 1, F.char_length("text")))
    return c.select("conv_id", "turn", passages.quoted_column(F.col("text"), quote).alias("in_order"))


QUOTES_SQL = f"""
with c as (select conv_id, turn, left(text, length(text) // 2) as a, substr(text, length(text) // 2 + 1) as b from conversations)
select conv_id, turn, length({sql.normalised("a")}) >= 8 or length({sql.normalised("b")}) >= 8 as in_order from c"""


def restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of facts that say nearly the same, of one family or with the user's preferences."""
    return similarity.matches(_statements(spark, sf_dir))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a statement of its source."""
    d = table(spark, sf_dir, "documents")
    entity = F.when(F.col("doc_id") % 11 == 0, "pref_user").otherwise(F.concat(F.lit("w_g"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 3, F.when(F.col("doc_id") % 4 == 0, "_2").otherwise("")))
    return d.select(F.col("doc_id").alias("id"), entity.alias("entity_id"), F.col("text").alias("statement"))


STATEMENTS_SQL = f"""st as (
  select doc_id as id, case when doc_id % 11 = 0 then 'pref_user' else 'w_g' || (cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3) || case when doc_id % 4 = 0 then '_2' else '' end end as entity_id,
         text as statement from documents),
ws as (select *, {sql.family("entity_id")} as f, {sql.content_words("statement")} as w from st),
pr as (
  select x.id as a, y.id as b, x.f as af, y.f as bf, len(list_intersect(x.w, y.w)) as i, len(x.w) as na, len(y.w) as nb
  from ws x join ws y on x.id < y.id and (x.f = y.f or x.f = 'pref_user' or y.f = 'pref_user') where len(x.w) > 0 and len(y.w) > 0),
ma as (select * from pr where i > 0 and (i >= 0.6 * (na + nb - i) or (least(na, nb) >= 3 and i >= 0.75 * least(na, nb))))"""


def duplicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that repeat a fuller one that is kept."""
    return similarity.duplicates(_statements(spark, sf_dir))


def placeable_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that restate neither a fact nor an earlier proposal, and are not blocked."""
    s = _statements(spark, sf_dir).withColumn("order", F.col("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    proposals, existing = s.join(labels, "id", "left_anti"), s.join(labels.filter("quality = 1"), "id", "left_semi")
    again = s.join(labels.filter("quality = 0 or toxic = 1"), "id", "left_semi")
    blocked = labels.filter("toxic = 1").select(F.col("id").alias("target"))
    return similarity.placeable(proposals.unionByName(again), existing.select("id", "entity_id", "statement"), blocked).select("id")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_facts(spark, sf_dir).withColumn("supersedes", F.array().cast("array<string>"))


def outdated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts all of whose sources are older versions of notes that came anew."""
    d = table(spark, sf_dir, "documents")
    version = lambda k: F.concat(F.lit("evt_ide_md:/"), "source", F.lit("/"), F.col("doc_id") % 50, F.lit(":"), k)
    h = F.left(F.sha2("text", 256), F.lit(8))
    facts = d.select(F.col("doc_id").alias("id"), F.lit("active").alias("status"), F.when(F.col("doc_id") % 4 == 0, F.array(version(h), F.lit("evt_chat_x"))).otherwise(F.array(version(h))).alias("source_ids"))
    notes = d.filter("lang = 'en'").select(version(h).alias("event_id"), F.lit("note").alias("role"), F.col("doc_id").alias("seq"))
    return extract.outdated(facts, notes)


OUTDATED_SQL = """
with d as (select doc_id, lang, 'evt_ide_md:/' || source || '/' || (doc_id % 50) || ':' as p, left(sha256(text), 8) as h from documents),
n as (select p, arg_max(p || h, doc_id) as cur from d where lang = 'en' group by 1)
select doc_id as id from d join n using (p) where doc_id % 4 <> 0 and cur <> p || h"""


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after an upsert: known ids are replaced whole, new ones added."""
    f = _base(spark, sf_dir)
    new = f.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("id", F.when(F.col("quality") == 1, F.col("id")).otherwise(F.concat("id", F.lit("n")))).withColumn("status", F.lit("active")).withColumn("statement", F.lit("new"))
    return change.upserted(f, new).select("id", "status", F.md5("statement").alias("statement"))


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after corrections: the old one is superseded and names the new one."""
    f = _base(spark, sf_dir)
    pairs = f.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("id", F.concat("id", F.lit("c")).alias("new_id"))
    return change.superseded(f, pairs).select("id", "status", F.array_join("supersedes", ",").alias("supersedes"))


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after forgetting: suppressed and retracted ones are pruned; others keep their state."""
    f, controls = _base(spark, sf_dir), label_controls(spark, sf_dir)
    ids = f.join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id").select("id")
    after = change.forgotten(controls, ids)
    return change.pruned(change.with_status(f, ids, "retracted"), after).select("id", "status")


FORGOTTEN_SQL = f"""
with {sql.FACTS}, both_ as (select target from ctl where control = 'suppressed' intersect select target from ctl where control = 'retracted')
select id, status from f_docs where doc_id not in (select doc_id from labels where quality = 0) and id not in (select target from both_)"""


def controls_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls after forgetting: each id suppressed and retracted once."""
    ids = _base(spark, sf_dir).join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id").select("id")
    return change.forgotten(label_controls(spark, sf_dir), ids).groupBy("control").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


def erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an erasure of one entity removes, and the events that its facts came from."""
    f = _base(spark, sf_dir)
    gone = change.erasure_targets(f, "w_src2")
    e = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "evt_ide_md:").otherwise("evt_chat_conv:"), "doc_id").alias("event_id"))
    hit = e.join(change.source_events(gone), "event_id", "left_semi")
    return gone.select(F.lit("fact").alias("kind"), "id").unionByName(hit.select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name no erased id; a longer id that begins with one stays."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.concat(F.lit("- [fact_"), F.col("doc_id") % 100, F.lit("] "), "text").alias("line"))
    needles = d.filter("doc_id in (1, 2, 33)").select(F.concat(F.lit("fact_"), F.col("doc_id")).alias("needle"))
    return change.scrubbed(lines, needles, "line").select("doc_id")


def layered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts published in four batches, each of which stores only its own rows, as every revision has them."""
    store, f = own_store(spark), cut(stored_facts(spark, sf_dir))
    n, here = F.col("doc_id"), F.lit(False)
    batches = [
        f.filter(n % 10 < 7).withColumn("gone", here),
        f.filter(n % 10 == 7).withColumn("gone", here),
        f.filter(n % 10 == 5).withColumn("predicate", F.lit("revised")).withColumn("gone", here),
        f.filter((n % 10 == 7) & (n % 3 == 0)).withColumn("gone", F.lit(True)).unionByName(f.filter(n % 10 == 9).withColumn("gone", here)),
    ]
    for k, batch in enumerate(batches):
        store.publish(k, f"batch-{k}", "", changes={"facts": batch.drop("doc_id")})
    out = None
    for number in store.revisions():
        own = store.table("facts", number).select(F.lit(number).cast("long").alias("revision"), "id", "predicate", F.md5("statement").alias("statement"))
        out = own if out is None else out.unionByName(own)
    return out


LAYERS_SQL = f"""
with {sql.DOCUMENT_FACTS}, f as (select distinct id, predicate, md5(statement) as statement, doc_id from f_docs), r as (select unnest([1, 2, 3, 4]) as revision)
select cast(revision as bigint) as revision, id, case when doc_id % 10 = 5 and revision >= 3 then 'revised' else predicate end as predicate, statement
from f, r
where doc_id % 10 < 7 or (doc_id % 10 = 7 and revision >= 2 and not (revision = 4 and doc_id % 3 = 0)) or (doc_id % 10 = 9 and revision = 4)"""


def erased_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every revision still has after one source's facts, and all facts of the same statements, were erased from all of them.

    Evidence of other facts that holds an erased statement is emptied.
    """
    store, n = own_store(spark), F.col("doc_id") % 4
    for k, which in enumerate((n != 1, n == 1, n == 2)):
        batch = stored_facts(spark, sf_dir, which)
        batch = batch.withColumn("status", F.lit("superseded")) if k == 2 else batch
        store.publish(k, f"batch-{k}", "", changes={"facts": batch.drop("doc_id").withColumn("gone", F.lit(False))})
    gone = change.erasure_targets(store.ever("facts"), "w_src2")
    store.rewrite(3, "erase-1", "", erasure.sought(gone.select("id"), gone.select("statement")), store.table("controls").limit(0))
    out = None
    for number in store.revisions():
        own = store.table("facts", number).select(F.lit(number).cast("long").alias("revision"), "id", "status", F.md5("evidence").alias("evidence"))
        out = own if out is None else out.unionByName(own)
    return out


ERASED_SQL = f"""
with {sql.DOCUMENT_FACTS}, f as (select distinct id, status, entity_id, statement, substr(statement, 1, 60) as evidence, doc_id from f_docs),
needle as (select distinct id, statement from f where entity_id = 'w_src2'),
r as (select unnest([1, 2, 3, 4]) as revision),
kept as (select * from f where id not in (select id from needle) and statement not in (select statement from needle where statement is not null)),
quoting as (select distinct kept.id from kept join needle on needle.statement <> '' and contains(kept.evidence, needle.statement))
select cast(revision as bigint) as revision, id, case when revision >= 3 and doc_id % 4 = 2 then 'superseded' else status end as status,
       case when id not in (select id from quoting) then md5(evidence) end as evidence
from kept, r where doc_id % 4 <> 1 or revision >= 2"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that new facts go to: each the first of its family with room."""
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("w_"), "source").alias("entity_id"), F.col("text").alias("statement"), F.col("doc_id").alias("order"))
    sizes = spark.createDataFrame([("w_src1", "w_src1", 50_000), ("w_src1_2", "w_src1", 1_000)], "entity_id string, family string, bytes long")
    return change.placed(s, sizes)


def bad_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that break a rule of form."""
    d = table(spark, sf_dir, "documents")
    day = F.lit("2024-01-02").cast("timestamp")
    f = d.select(
        F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("predicate"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise("").alias("statement"),
        day.alias("valid_from"), F.when(F.col("doc_id") % 4 == 0, F.lit("2024-01-01").cast("timestamp")).when(F.col("doc_id") % 4 == 1, day).alias("valid_to"),
    )
    return eligibility.violations(f).groupBy("reason").agg(F.count("*").alias("n"))


BAD_FACTS_SQL = """
select reason, count(*) as n from (
  select 'empty id' as reason from documents where doc_id % 50 = 0 union all select 'empty predicate' from documents where doc_id % 7 = 0 or lang is null
  union all select 'empty statement' from documents where doc_id % 9 = 0 or trim(text, ' ') = '' union all select 'ends before it begins' from documents where doc_id % 4 = 0) group by 1"""


def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that texts cite and no fact has."""
    d = table(spark, sf_dir, "documents")
    texts = d.select(F.concat(F.lit("see [fact_"), F.col("doc_id") * 3, F.lit("] and [id_"), F.col("lang"), F.lit("]")).alias("t"))
    return validate.unknown_references(texts, d.select(F.concat(F.lit("fact_"), "doc_id").alias("id")), "t")


def unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions of what does not exist and was not deleted or retracted."""
    facts, controls = document_facts(spark, sf_dir), label_controls(spark, sf_dir)
    odd = table(spark, sf_dir, "labels").filter("doc_id % 5 = 0").select(F.lit("suppressed").alias("control"), F.concat(F.lit("gone_"), F.col("doc_id")).alias("target"))
    excused = odd.filter(F.endswith("target", F.lit("0"))).withColumn("control", F.lit("retracted"))
    return validate.unknown_targets(controls.unionByName(odd).unionByName(excused), facts)


def bad_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a change set of all documents may not be published."""
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, "state/controls.json").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("memory/people/"), "doc_id", F.lit(".md"))).otherwise(F.concat(F.lit("tmp/"), "doc_id"))
    return validate.bad_changes(d.select(path.alias("path"), F.col("text").alias("content"))).groupBy("reason").agg(F.count("*").alias("n"))


BAD_CHANGES_SQL = """
with d as (select case doc_id % 3 when 0 then 'state/controls.json' when 1 then 'memory/people/' || doc_id || '.md' else 'tmp/' || doc_id end as path, text as content from documents),
c as (select path, count(*) as n, max(content) as content from d group by 1)
select reason, count(*) as n from (
  select 'path' as reason from c where starts_with(path, 'tmp/') union all select 'size' from c where strlen(content) > 65536
  union all select 'json' from c where ends_with(path, '.json') union all select 'twice' from c where n > 1
  union all select 'files' where (select count(*) from d) > 64 union all select 'payload' where (select sum(strlen(content)) from d) > 262144) group by 1"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a store: events, projects, entities, active facts, and how far consolidation lags."""
    return report.status(conversation_events(spark, sf_dir), document_facts(spark, sf_dir), 7000)


def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type with their numbers and what their properties hold."""
    e = table(spark, sf_dir, "events")
    return report.by_type(e, "event_type", "event_id", "user_id", F.get_json_object("props", "$.k").cast("long"))


def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: a line for each entity while a budget of 60,000 bytes lasts."""
    c = table(spark, sf_dir, "customer")
    entities = c.select(F.concat(F.lit("p_"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("title"))
    facts = table(spark, sf_dir, "orders").select(F.concat(F.lit("p_"), F.col("o_custkey").cast("string")).alias("entity_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("superseded").alias("status"))
    return report.index_rows(report.entity_counts(entities, facts)).withColumn("k", F.col("k").cast("long"))


INDEX_SQL = """
with a as (select 'p_' || o_custkey as e, count(*) as n from orders where o_orderstatus = 'O' group by 1),
r as (select 'p_' || c_custkey as id, c_name, coalesce(n, 0) as n from customer left join a on e = 'p_' || c_custkey),
l as (select id, '- `' || id || '` (person) ' || c_name || ' — ' || n || case when n = 1 then ' active fact' else ' active facts' end || chr(10) as line from r),
u as (select row_number() over (order by id) as k, line, 16 + sum(strlen(line)) over (order by id rows unbounded preceding) as upto from l),
s as (select k, line from u where upto <= 60000)
select * from s union all select (select count(*) from s) + 1, '- … and ' || ((select count(*) from l) - (select count(*) from s)) || ' more entities' || chr(10) where (select count(*) from l) > (select count(*) from s)"""


def overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree after some files were written and some deleted."""
    d = table(spark, sf_dir, "documents")
    base = d.filter("lang in ('en', 'es')").select(F.concat(F.lit("memory/"), "doc_id").alias("path"), F.col("lang").alias("title"))
    updates = d.filter("lang in ('en', 'fr')").select(F.concat(F.lit("memory/"), "doc_id").alias("path"), F.lit("new").alias("title"), (F.col("source") == "src1").alias("deleted"))
    return report.overlaid(base, updates)


def export_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export shows under each heading."""
    found = report.export_digests(document_facts(spark, sf_dir))
    return found.select("heading", F.col("rank").cast("long").alias("rank"), "n", F.col("md5").alias("lines"))


EXPORT_SQL = f"""
with {sql.DOCUMENT_FACTS}, s as (
  select case when entity_id = 'pref_user' then 'Preferences' else 'Project' end as heading, case when entity_id = 'pref_user' then 5 else 0 end as rank, path, ord,
         '- [' || id || '] ' || statement || case when visibility in ('shared', 'public') then ' _(' || visibility || ')_' else '' end as line
  from f_docs where status in ('active', 'disputed') and doc_id % 2 = 1)
select heading, min(rank) as rank, count(*) as n, md5(string_agg(line, chr(10) order by path, ord)) as lines from s group by 1"""


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an export, numbered over all and within their heading."""
    return report.export_lines(document_facts(spark, sf_dir)).select("n", "heading", "k", F.md5("line").alias("line"))


EXPORT_LINES_SQL = EXPORT_SQL[: EXPORT_SQL.index("select heading, min(rank)")] + """
select row_number() over (order by rank, heading, path, ord, line) as n, heading, row_number() over (partition by heading order by path, ord, line) as k, md5(line) as line from s"""


def prompt_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may read, in packs for one call each: rows and bytes of each pack."""
    said = extract.candidates(conversation_events(spark, sf_dir).select("seq", "role", "content"))
    found = packing.packs(said, ["seq", "k"], F.octet_length("said"), extract.BATCH_BYTES)
    return found.groupBy("pack").agg(F.count("*").alias("n"), F.sum(F.octet_length("said")).cast("long").alias("bytes"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and 95th percentile by nearest index."""
    e = table(spark, sf_dir, "events")
    return report.timings(e.select("event_type", F.col("value").alias("ms")), ["event_type"])


TIMINGS_SQL = """
with l as (select event_type, list_sort(list(value)) as v, count(*) as n from events group by 1)
select event_type, n as runs, v[1] as min_ms, v[cast(floor((n - 1) * 0.5 + 0.5) as int) + 1] as median_ms, v[cast(floor((n - 1) * 0.95 + 0.5) as int) + 1] as p95_ms from l"""


def statement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each statement occurs in its entity, where it does so more than once."""
    return report.repeated_statements(document_facts(spark, sf_dir), F.md5("statement"))


def agreed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two passes of a judge agree on, but for what is to be kept."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    keep = table(spark, sf_dir, "documents").filter("lang = 'fr'").withColumnRenamed("doc_id", "id")
    return change.agreed(labels.filter("quality = 1"), labels.filter("toxic = 1"), keep).withColumnRenamed("id", "doc_id")


def blocked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be extracted again: suppressed or deleted, each once."""
    return eligibility.blocked(label_controls(spark, sf_dir))


def consolidation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches that consolidation reads: so many events after the last, of all scopes."""
    from annalist.streaming.consolidate import windows

    return windows(conversation_events(spark, sf_dir), 0, 40)


WINDOWS_SQL = f"""
with {sql.CONVERSATION_EVENTS}, r as (select *, (row_number() over (order by seq) - 1) // 40 as batch from j_conv where seq > 0)
select batch, min(seq) as from_seq, max(seq) as through_seq, count(*) as events from r group by 1"""


QUERIES = {
    "rule_proposals": rule_proposals,
    "dispositions": dispositions,
    "model_candidates": model_candidates,
    "model_gate": model_gate,
    "evidence_found": evidence_found,
    "quotes_in_order": quotes_in_order,
    "restatements": restatements,
    "duplicate_facts": duplicate_facts,
    "placeable_facts": placeable_facts,
    "outdated_facts": outdated_facts,
    "remembered": remembered,
    "corrected": corrected,
    "forgotten": forgotten,
    "controls_after": controls_after,
    "erased": erased,
    "scrubbed": scrubbed,
    "layered_facts": layered_facts,
    "erased_history": erased_history,
    "homes": homes,
    "bad_facts": bad_facts,
    "unknown_references": unknown_references,
    "unknown_targets": unknown_targets,
    "bad_changes": bad_changes,
    "status": status,
    "event_status": event_status,
    "entity_index": entity_index,
    "overlaid": overlaid,
    "export_sections": export_sections,
    "export_lines": export_lines,
    "prompt_packs": prompt_packs,
    "timings": timings,
    "statement_counts": statement_counts,
    "agreed_findings": agreed_findings,
    "blocked_targets": blocked_targets,
    "consolidation_windows": consolidation_windows,
}

ORACLE_SQL = {
    "rule_proposals": RULES_SQL,
    "dispositions": DISPOSITIONS_SQL,
    "model_candidates": "select conv_id * 1000 + turn as seq, cast(0 as bigint) as k, md5(left(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\n$', ''), 2000)) as said from conversations where role = 'user' and trim(text, ' ') <> ''",
    "model_gate": GATE_SQL,
    "evidence_found": EVIDENCE_SQL,
    "quotes_in_order": QUOTES_SQL,
    "restatements": f"with {STATEMENTS_SQL} select a, b from ma",
    "outdated_facts": OUTDATED_SQL,
    "remembered": f"""with {sql.DOCUMENT_FACTS} select id, status, md5(statement) as statement from f_docs where doc_id not in (select doc_id from labels where quality = 1)
       union all select id || case when quality = 1 then '' else 'n' end, 'active', md5('new') from f_docs join labels using (doc_id)""",
    "corrected": f"with {sql.DOCUMENT_FACTS} select id, case when t then 'superseded' else status end as status, case when t then id || 'c' else '' end as supersedes from (select *, doc_id in (select doc_id from labels where toxic = 1) as t from f_docs)",
    "forgotten": FORGOTTEN_SQL,
    "controls_after": f"""with {sql.FACTS}, a as (select * from ctl union select c, id from f_docs, (values ('suppressed'), ('retracted')) v(c) where doc_id in (select doc_id from labels where quality = 0))
       select control, count(*) as n, count(distinct target) as targets from a group by 1""",
    "erased": f"""with {sql.DOCUMENT_FACTS}, g as (select * from f_docs where entity_id = 'w_src2') select 'fact' as kind, id from g
       union all select 'event', source_ids[1] from g""",
    "scrubbed": "select doc_id from documents where doc_id % 100 not in (1, 2, 33)",
    "layered_facts": LAYERS_SQL,
    "erased_history": ERASED_SQL,
    "bad_facts": BAD_FACTS_SQL,
    "unknown_references": "select distinct 'fact_' || (doc_id * 3) as reference from documents where doc_id * 3 not in (select doc_id from documents) union select 'id_' || lang from documents",
    "unknown_targets": "select 'gone_' || doc_id as target from labels where doc_id % 10 = 5",
    "bad_changes": BAD_CHANGES_SQL,
    "status": f"""with {sql.CONVERSATION_EVENTS}, {sql.DOCUMENT_FACTS}
       select * from (select count(*) as events, max(seq) as last_seq, count(distinct project) as projects, greatest(max(seq) - 7000, 0) as lag from j_conv),
                     (select count(distinct entity_id) as entities, count(*) filter (where status = 'active') as active_facts from f_docs)""",
    "event_status": "select event_type, count(*) as n, max(event_id) as last_seq, count(distinct user_id) as users, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1",
    "entity_index": INDEX_SQL,
    "overlaid": """select 'memory/' || doc_id as path, case when lang in ('en', 'fr') then 'new' else lang end as title from documents
       where lang in ('en', 'es', 'fr') and not (lang in ('en', 'fr') and source = 'src1')""",
    "export_sections": EXPORT_SQL,
    "export_lines": EXPORT_LINES_SQL,
    "timings": TIMINGS_SQL,
    "statement_counts": f"with {sql.DOCUMENT_FACTS} select entity_id, md5(statement) as statement, count(*) as n from f_docs group by 1, 2 having count(*) > 1",
    "agreed_findings": "select distinct doc_id from labels where quality = 1 and toxic = 1 and doc_id not in (select doc_id from documents where lang = 'fr')",
    "blocked_targets": f"with {sql.FACTS} select distinct target from ctl where control in ('suppressed', 'deleted')",
    "consolidation_windows": WINDOWS_SQL,
}
