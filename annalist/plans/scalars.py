"""Queries for the text functions, one for each group, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import passages, text
from annalist.plans import sql
from annalist.plans.views import table


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and stems of every text, counted (tokenize, stem)."""
    c = table(spark, sf_dir, "conversations")
    word = F.explode(text.tokens(F.col("text"))).alias("word")
    return c.select(word).select("word", text.stem(F.col("word")).alias("stem")).groupBy("word", "stem").agg(F.count("*").alias("n"))


def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words and content terms of every turn (three stopword lists)."""
    c = table(spark, sf_dir, "conversations")
    sets = {"words": text.content_words(F.col("text")), "terms": text.content_terms(F.col("text")), "stems": text.stems(F.col("text"))}
    return c.select("conv_id", "turn", *(F.array_join(F.array_sort(x), " ").alias(k) for k, x in sets.items()))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, hashes, fact ids, event ids, families, folders, types and labels."""
    d = table(spark, sf_dir, "documents")
    entity = F.concat(F.element_at(F.array(*map(F.lit, ("w_", "p_", "o_", "pref_", "c_", "x_"))), (F.col("doc_id") % 6 + 1).cast("int")), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "_2").otherwise(""))
    title = F.col("text")
    kind = F.element_at(F.array(*map(F.lit, ("chat", "calendar", "voice", "ide_history", "custom"))), (F.col("doc_id") % 5 + 1).cast("int"))
    where = F.concat(F.lit("claude:"), F.col("source"))
    return d.select(
        "doc_id",
        text.slug(title).alias("slug"),
        F.sha2("text", 256).alias("sha"),
        text.fact_id(entity, F.col("lang"), title).alias("fact_id"),
        text.event_id(kind, where, F.col("doc_id"), F.lit("mail")).alias("event_id"),
        text.source_label(kind, where, F.lit("mail")).alias("source_label"),
        text.family(entity).alias("family"),
        text.entity_path(entity).alias("path"),
        text.entity_type(entity).alias("entity_type"),
        text.heading(text.bucket(entity)).alias("heading"),
        text.label(F.when(F.col("doc_id") % 3 == 0, "active").otherwise("retracted")).alias("label"),
        text.project_name(F.concat(F.lit("/a/"), F.col("source"), F.lit("/"))).alias("project_name"),
    )


def _kind_sql(values, n: int) -> str:
    return f"{sql.listed(values)}[doc_id % {n} + 1]"


IDENTITIES_SQL = f"""
with d as (
  select *, {_kind_sql(("w_", "p_", "o_", "pref_", "c_", "x_"), 6)} || source || case when doc_id % 2 = 0 then '_2' else '' end as entity,
         {_kind_sql(("chat", "calendar", "voice", "ide_history", "custom"), 5)} as kind, 'claude:' || source as w from documents)
select doc_id, {sql.slug("text")} as slug, sha256(text) as sha,
       'fact_' || left(sha256(entity || '|' || lang || '|' || lower(text)), 12) as fact_id,
       case kind when 'chat' then 'evt_chat_' || w when 'calendar' then 'evt_cal_' || w || '_' || doc_id when 'voice' then 'evt_voice_' || w || '_' || doc_id
                 when 'ide_history' then 'evt_ide_' || w || '_' || doc_id else 'evt_mail_' || w || '_' || doc_id end as event_id,
       case kind when 'chat' then 'claude' when 'ide_history' then 'ide' when 'custom' then 'mail' else kind end as source_label,
       {sql.family("entity")} as family,
       'memory/' || {sql.bucket("entity")} || '/' || regexp_replace(entity, '^(pref_|p_|o_|w_|c_)', '') || '.md' as path,
       case when starts_with(entity, 'pref_') then 'preference' when entity[1] = 'p' then 'person' when entity[1] = 'o' then 'org'
            when entity[1] = 'w' then 'workstream' when entity[1] = 'c' then 'conversation' else 'thing' end as entity_type,
       case {sql.bucket("entity")} when 'workstreams' then 'Project' when 'people' then 'People' when 'orgs' then 'Organisations'
            when 'preferences' then 'Preferences' else 'Conversations' end as heading,
       case when doc_id % 3 = 0 then 'current' else 'non-current' end as label, source as project_name
from d"""


def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped texts and first lines."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.clip(F.col("text"), 2048)).alias("clip"), text.first_lines(F.col("text"), 2).alias("lines"), text.first_lines(F.concat(F.lit("\n \n"), "text"), 1).alias("led"))


def quotes_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as quotes are compared, with list markers, marks and curly quotes put in."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("- 12. **“"), "text", F.lit("”** — `x`\n  + # y\n3. z | >"))
    return d.select("doc_id", F.md5(text.normalised(raw)).alias("normalised"), F.right(text.normalised(raw), F.lit(20)).alias("tail"))


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users typed, out of turns with injected blocks, commands, images and temporary paths."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") % 6
    said = F.col("text")
    raw = (
        F.when(n == 0, F.concat(F.lit("<system-reminder a=1>x\ny</system-reminder>"), said))
        .when(n == 1, F.concat(F.lit("<command-name>go</command-name><command-args> "), said, F.lit(" </command-args>")))
        .when(n == 2, F.concat(F.lit("<image src=1>z</image>[Image #3]"), said, F.lit("\n/tmp/a.png\n  /var/folders/b\nend")))
        .when(n == 3, F.concat(F.lit("# AGENTS.md instructions for x "), said))
        .when(n == 4, F.lit("  <skill>all</skill>  "))
        .otherwise(said)
    )
    return c.select("conv_id", "turn", text.own_words(raw).alias("said"))


OWN_WORDS_SQL = """
select conv_id, turn,
       case conv_id % 6 when 0 then regexp_replace(s, '^\\s+', '') when 1 then trim(s, ' ') when 2 then s || chr(10) || 'end'
            when 5 then regexp_replace(regexp_replace(s, '^\\s+', ''), '\\n$', '') end as said
from (select *, text as s from conversations)"""


def note_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of notes, roles, headings and visibility ranks."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, ("AGENTS.md", "Claude.md", "codex.local.md", "README.md", ".windsurfrules", "notes.md")))
    name = F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool", "system", "note", "boss"))), (F.col("doc_id") % 6 + 1).cast("int"))
    rank = text.visibility_rank(F.element_at(F.array(*map(F.lit, ("private", "shared", "public"))), (F.col("doc_id") % 3 + 1).cast("int")))
    return d.select("doc_id", text.note_kind(name).alias("kind"), text.role(role).alias("role"), rank.cast("long").alias("rank"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar times and cue offsets."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyyMMdd")).otherwise("soon")
    cue = F.concat(F.lit("0"), F.col("event_id") % 7, F.lit(":"), F.col("event_id") % 60, F.lit(":"), F.col("user_id") % 60, F.when(F.col("event_id") % 2 == 0, ".250").otherwise(",5"))
    return e.select("event_id", F.date_format(text.calendar_time(stamp), "yyyy-MM-dd HH:mm:ss").alias("at"), text.cue_offset(cue).alias("offset_ms"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model logits and judged relevances as scores."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.round(text.sigmoid(F.col("value") / 100), 6).alias("sigmoid"),
        F.round(text.relevance(F.col("value") / 50 - 1, F.col("value") / 200), 6).alias("relevance"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids cited in texts, and replies without their fences."""
    d = table(spark, sf_dir, "documents")
    cited = F.concat("text", F.lit(" [fact_"), F.col("doc_id"), F.lit("] [id_x] [other_1] [fact_"))
    fenced = F.concat(F.lit("```json\n{\"n\": "), F.col("doc_id"), F.lit("}\n```"))
    return d.select("doc_id", F.array_join(text.reference_tokens(cited), ",").alias("cited"), F.get_json_object(text.without_fence(fenced), "$.n").cast("long").alias("n"))


TERM = "the"


def passages_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of twelve words around a term."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", passages.snippet_column(F.col("text"), ["zzqx"], 12).alias("snippet"))


PASSAGES_SQL = r"""
with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as f from documents),
s as (select *, len(f) as n, greatest(len(f) // 2 - 6, 0) as a from w),
t as (select *, least(a + 12, n) as b from s)
select doc_id, case when n <= 12 then text
  else case when greatest(b - 12, 0) > 0 then '... ' else '' end || array_to_string(f[greatest(b - 12, 0) + 1 : b], ' ') || case when b < n then ' ...' else '' end end as snippet
from t"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of texts that do not hold the term: their first 320 bytes, widened to whole characters."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", passages.excerpt_column(F.col("text"), ["zzqx"]).alias("excerpt"))


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pieces of 500 characters: how many, and that none is longer; nothing but line breaks is lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", passages.chunks_column(F.col("text"), 500).alias("p"))
    whole = F.regexp_replace(F.array_join("p", ""), r"\n", "") == F.regexp_replace("text", r"\n", "")
    return d.select("doc_id", whole.alias("nothing_lost"), F.coalesce(F.array_max(F.transform("p", F.char_length)) <= 502, F.lit(True)).alias("short"))


QUERIES = {
    "text_tokens": text_tokens,
    "term_sets": term_sets,
    "identities": identities,
    "clipped_lines": clipped_lines,
    "quotes_normalised": quotes_normalised,
    "own_words": own_words,
    "note_kinds": note_kinds,
    "times": times,
    "scores": scores,
    "references": references,
    "snippets": passages_around,
    "excerpts": excerpts,
    "text_pieces": text_pieces,
}

_SORTED = "array_to_string(list_sort({}), ' ')"
_RAW = "'- 12. **“' || text || '”** — `x`' || chr(10) || '  + # y' || chr(10) || '3. z | >'"
_LINES = r"list_filter(list_transform(regexp_split_to_array({}, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _first(source: str, n: int) -> str:
    full = _LINES.format(source)
    return f"case when len({full}) = 0 then trim({source}, ' ') else array_to_string(({full})[1:{n}], chr(10)) || case when len({full}) > {n} then chr(10) || '...' else '' end end"


ORACLE_SQL = {
    "text_tokens": f"select word, {sql.stem('word')} as stem, count(*) as n from (select unnest({sql.tokens('text')}) as word from conversations) group by all",
    "term_sets": f"select conv_id, turn, {_SORTED.format(sql.content_words('text'))} as words, {_SORTED.format(sql.content_terms('text'))} as terms, {_SORTED.format(sql.stems('text'))} as stems from conversations",
    "identities": IDENTITIES_SQL,
    "clipped_lines": f"select doc_id, md5(case when length(text) > 2048 then left(text, 2048) || '…' else text end) as clip, {_first('text', 2)} as lines, {_first('(chr(10) || chr(32) || chr(10) || text)', 1)} as led from documents",
    "quotes_normalised": f"select doc_id, md5(q) as normalised, right(q, 20) as tail from (select doc_id, {sql.normalised(_RAW)} as q from documents)",
    "own_words": OWN_WORDS_SQL,
    "note_kinds": "select doc_id, ['agents', 'claude', 'codex', 'readme', 'windsurf', 'project_markdown'][doc_id % 6 + 1] as kind, ['user', 'assistant', 'tool', 'system', 'note', null][doc_id % 6 + 1] as role, doc_id % 3 as rank from documents",
    "times": """select event_id, case event_id % 3 when 0 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') when 1 then strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') end as at,
       case when event_id % 2 = 0 then ((event_id % 7 * 60 + event_id % 60) * 60 + user_id % 60) * 1000 + 250 end as offset_ms from events""",
    "scores": "select event_id, round(1 / (1 + exp(-value / 100)), 6) as sigmoid, round(least(greatest((value / 50 - 1) / 3, 0), 1) * least(greatest(value / 200, 0), 1), 6) as relevance from events",
    "references": "select doc_id, 'fact_' || doc_id || ',id_x' as cited, doc_id as n from documents",
    "snippets": PASSAGES_SQL,
    "text_pieces": "select doc_id, true as nothing_lost, true as short from documents",
}
