"""Queries for eligibility, filters, search, interleaving, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import eligibility, report, search, wordindex
from annalist.plans import sql
from annalist.plans.views import NOW, conversation_events, document_events, document_facts, label_controls, own_store, stored_facts, table

#: Words of the synthetic prose: a rare one, a common one, one with an ending and a stopword.
QUERY = "thereing handed the connected"
PROMPT = "that thon and thre with ther than"
EVENT_QUERY = "the thereing entre hand"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.eligible_facts(document_facts(spark, sf_dir), label_controls(spark, sf_dir), _now())


def eligible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a search may return, to three audiences, with and without disputed ones."""
    facts, controls = document_facts(spark, sf_dir), label_controls(spark, sf_dir)
    out = None
    for audience in ("private", "shared", "public"):
        for disputed in (False, True):
            own = eligibility.eligible_facts(facts, controls, _now(), audience, disputed).select(F.lit(audience).alias("audience"), F.lit(disputed).alias("disputed"), "id", "path")
            out = own if out is None else out.unionByName(own)
    return out


ELIGIBLE_SQL = f"""
with {sql.FACTS}, a as (select * from (values ('private', 0), ('shared', 1), ('public', 2)) t(audience, r)), q as (select * from (values (false), (true)) t(disputed)),
v as (select *, case visibility when 'shared' then 1 when 'public' then 2 else 0 end as fv, case entity_visibility when 'shared' then 1 else 0 end as vv from f_docs)
select audience, disputed, id, path from v, a, q
where (status = 'active' or (disputed and status = 'disputed')) and fv >= r and vv >= r and (expires_at is null or expires_at > timestamp '2024-06-01')
  and (valid_to is null or valid_to > timestamp '2024-06-01') and (valid_from is null or valid_from <= timestamp '2024-06-01') and id not in (select target from ctl)"""


def readable_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of every entity: all facts that are neither suppressed nor deleted, with labels."""
    found = eligibility.readable_facts(document_facts(spark, sf_dir), label_controls(spark, sf_dir))
    return found.select("entity_id", "id", "status", text.label(F.col("status")).alias("label"))


def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading each entity gives: its first active fact and how many there are."""
    return report.current_of_entities(eligibility.readable_facts(document_facts(spark, sf_dir), label_controls(spark, sf_dir)))


def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each filter admits: scope, project by name and by path, source prefixes."""
    e = conversation_events(spark, sf_dir)
    tests = {
        "scope": eligibility.in_scope("team"),
        "project_name": eligibility.in_project("pROJECT3/"),
        "project_path": eligibility.in_project("/work/Project4"),
        "sources": eligibility.from_sources(["EVT_CHAT_conv:1", "conv:2"]),
    }
    return e.groupBy("role").agg(*(F.count_if(t).alias(k) for k, t in tests.items()))


def fact_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one project, facts that cite a source, facts from files only."""
    f = document_facts(spark, sf_dir)
    f = f.withColumn("entity_id", F.concat("entity_id", F.when(F.col("doc_id") % 3 == 0, "_7").when(F.col("doc_id") % 3 == 1, "_x").otherwise("")))
    return f.select(
        "doc_id",
        eligibility.project_entities("SRC3").alias("of_project"),
        eligibility.cites_sources(["evt_chat_conv:1", "evt_ide_md:2"]).alias("cites"),
        eligibility.from_files_only().alias("files_only"),
    )


FACT_FILTERS_SQL = f"""
with {sql.DOCUMENT_FACTS}
select doc_id, entity_id in ('w_src3', 'pref_user') and doc_id % 3 <> 1 as of_project,
       starts_with(source_ids[1], 'evt_chat_conv:1') or starts_with(source_ids[1], 'evt_ide_md:2') as cites, starts_with(source_ids[1], 'evt_ide_md:') as files_only
from f_docs"""


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, ids and prompts that the rules admit."""
    d = table(spark, sf_dir, "documents")
    kinds = ("INDEX.md", "memory/people/{}.md", "memory/pets/{}.md", "sessions/{}/TASKS.md", "state/controls.json", "x/memory/people/{}.md", "state/dispositions/{}.json", "memory/people/{} .md")
    path = F.replace(F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 8 + 1).cast("int")), F.lit("{}"), F.col("source"))
    request = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit("!")))
    revision = F.left(F.sha2("text", 256), F.when(F.col("doc_id") % 3 == 0, 40).when(F.col("doc_id") % 3 == 1, 64).otherwise(50))
    prompt = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/"), F.col("text"))).when(F.col("doc_id") % 4 == 1, F.lit(" two words ")).otherwise(F.lit("now three words"))
    return d.select(
        "doc_id",
        eligibility.writable(path).alias("writable"),
        request.rlike(eligibility.REQUEST_ID).alias("request"),
        revision.rlike(eligibility.REVISION).alias("revision"),
        eligibility.asks_something(prompt).alias("asks"),
    )


def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty facts: rarity of exact stems, less for shared prefixes."""
    return search.search_facts(_facts(spark, sf_dir), QUERY, 20).select("rank", "id", "score")


def indexed_fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same twenty, of a store that has the facts in three layers: by the postings of the query's terms."""
    store, n = own_store(spark), F.col("doc_id") % 8
    for k, part in enumerate((n < 5, n == 5, n > 5)):
        store.publish(k, f"part-{k}", "", changes={"facts": stored_facts(spark, sf_dir, part).drop("doc_id").withColumn("gone", F.lit(False))})
    keys = search.posting_keys(spark, QUERY)
    eligible = eligibility.eligible_facts(store.table("facts"), label_controls(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return search.search_postings(eligible, store.indexed([k for _, _, k in keys], part=wordindex.SEARCH), keys, QUERY, 20).select("rank", "id", "score")


def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every eligible fact that the query matches."""
    return search.scored_facts(_facts(spark, sf_dir), QUERY).select("id", F.round("score", 6).alias("score"))


def term_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and rarity of every stem among eligible facts."""
    return search.rarities(_facts(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty turns of one scope and project."""
    e = conversation_events(spark, sf_dir).filter(eligibility.in_scope("personal") & eligibility.in_project("project2"))
    return search.search_events(e, EVENT_QUERY, 20).select("rank", "event_id", "seq", "score")


def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every note that the query matches; many are long."""
    e = document_events(spark, sf_dir).withColumn("score", F.round(search.event_score(EVENT_QUERY), 6)).filter("score > 0")
    return e.select("event_id", "score")


def sibling_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose events share ids, so that short siblings of long hits come after them."""
    e = document_events(spark, sf_dir).withColumn("event_id", F.concat(F.lit("evt_"), F.col("seq") % 50))
    return search.search_events(e, EVENT_QUERY, 10, True).select("rank", "event_id", "seq", "score")


SIBLING_SQL = f"""
with {sql.DOCUMENT_EVENTS}, src as (select * replace ('evt_' || (seq % 50) as event_id) from j_docs), {sql.event_scores(EVENT_QUERY, "src")},
top as (select row_number() over (order by score desc, seq) as rank, event_id, seq, score, content from es where score > 0 qualify row_number() over (order by score desc, seq) <= 10),
cl as (select distinct event_id from top where rank <= 3 and length(content) > 2048),
sh as (select event_id, seq, strlen(content) as n, row_number() over (partition by event_id order by strlen(content), seq) as k
       from src where event_id in (select event_id from cl) and length(content) <= 2000 and length(trim(content, ' ')) >= 16 and seq not in (select seq from top)),
ex as (select 10 + row_number() over (order by n, seq) as rank, event_id, seq, 0.0 as score from sh where k <= 8 qualify row_number() over (order by n, seq) <= 2)
select rank, event_id, seq, score from top union all select * from ex"""


def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and turns for one query, a fact first, then in turn."""
    found = search.combined(_facts(spark, sf_dir), conversation_events(spark, sf_dir), QUERY, 12)
    return found.select("place", "id", "entity_id", "path", "score")


COMBINED_SQL = f"""
with {sql.FACTS}, {sql.CONVERSATION_EVENTS}, {sql.fact_scores(QUERY)}, {sql.event_scores(QUERY, "j_conv")},
a as (select id, entity_id, path, score, 0 as side, row_number() over (order by score desc, path, ord, id) as r from fs where score > 0 qualify r <= 12),
b as (select 'journal:' || event_id || '#' || seq as id, scope_id as entity_id, 'journal/conv' as path, score, 1 as side, row_number() over (order by score desc, seq) as r from es where score > 0 qualify r <= 12),
u as (select *, row_number() over (order by r, side) as place from (select * from a union all select * from b))
select place, id, entity_id, path, score from u where place <= 12"""


def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a judge of fixed behaviour: relevance follows from the first letter of the hit."""
    judge = search.judge_reranker(lambda query, statement: ((ord(statement[:1] or "a") % 4), 0.5))
    keep = eligibility.project_entities("src3")
    found = search.combined(_facts(spark, sf_dir), conversation_events(spark, sf_dir), QUERY, 12, judge, keep)
    return found.select("place", "id", F.round("score", 6).alias("score"))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty turns as a list of hits; every third lost its score."""
    top = search.search_events(conversation_events(spark, sf_dir), EVENT_QUERY, 20)
    return top.select(F.col("seq").alias("id"), F.when(F.col("rank") % 3 == 0, 0.0).otherwise(F.col("score")).alias("score"), F.col("rank").alias("place"))


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown of a list of hits, of which every third has no score."""
    return search.judged_pool(_page(spark, sf_dir)).select("id", "place")


def merged_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged hits first by relevance, the rest as they stood; one judged hit has no relevance."""
    base = _page(spark, sf_dir)
    judged = search.judged_pool(base).filter("place <> 2").select("id", ((F.col("place") * 7 % 5) / 5.0).alias("relevance"))
    return search.reranked(base, judged, 12).select("place", "id", "score")


_POOL_SQL = f"""{sql.CONVERSATION_EVENTS}, {sql.event_scores(EVENT_QUERY, "j_conv")},
base as (select seq as id, case when place % 3 = 0 then 0.0 else score end as score, place from (
  select seq, score, row_number() over (order by score desc, seq) as place from es where score > 0 qualify place <= 20)),
pool as (select *, row_number() over (partition by score > 0 order by place) as k, count(*) filter (where score > 0) over () as pos from base
         qualify (score > 0 and k <= 5) or (score <= 0 and k <= 8 - least(pos, 5)))"""


def source_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the events that turns were learned from; some are missing."""
    c = conversation_events(spark, sf_dir)
    hits = c.filter("role = 'assistant'").select(
        F.col("event_id").alias("id"),
        F.array(F.regexp_replace("event_id", "[0-9]+$", "0"), F.col("event_id"), F.concat(F.lit("gone_"), "event_id")).alias("source_ids"),
    )
    return search.source_excerpts(hits, c, 2).select("id", F.col("k").cast("long").alias("k"), "event_id", "excerpt")


_LINES = r"list_filter(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
EXCERPTS_SQL = f"""
with {sql.CONVERSATION_EVENTS},
h as (select event_id as id, unnest([regexp_replace(event_id, '[0-9]+$', '0'), event_id, 'gone_' || event_id]) as event_id, unnest([0, 1, 2]) as k from j_conv where role = 'assistant'),
l as (select event_id, {_LINES} as f from j_conv)
select id, cast(k as bigint) as k, h.event_id,
       case when f is null then '(source event not found)' else array_to_string(f[1:2], chr(10)) || case when len(f) > 2 then chr(10) || '...' else '' end end as excerpt
from h left join l on h.event_id = l.event_id"""


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that earn a place beside a prompt."""
    return search.prompt_facts(_facts(spark, sf_dir), PROMPT).select("place", "id")


PROMPT_SQL = f"""
with {sql.FACTS}, {sql.fact_scores(PROMPT)},
t as (select id, statement, row_number() over (order by score desc, path, ord, id) as r from fs where score > 0 qualify r <= 12),
k as (select id, row_number() over (order by r) as place from t
      where len(list_intersect({sql.content_terms("statement")}, {sql.listed([t for t in dict.fromkeys(map(search.stem, search.tokens(PROMPT))) if len(t) > 2 and t not in search.W.FACT_STOPWORDS])})) >= 2)
select place, id from k where place <= 6"""


def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session starts with: how many facts are current, and the user's first twenty preferences."""
    return report.session_start(eligibility.readable_facts(document_facts(spark, sf_dir), label_controls(spark, sf_dir)), "pref_user").drop("statement")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric: each benchmark item is a case that expects one document and some words."""
    b = table(spark, sf_dir, "benchmark")
    doc = (F.col("item_id") * 3).cast("string")
    return b.select(
        F.col("item_id").alias("case_id"),
        F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"),
        F.array(doc).alias("expected"),
        F.array(F.lit("THE")).alias("must_include"),
        F.array(F.lit("zzqx"), F.concat(F.lit("no"), doc)).alias("must_not_include"),
    )


def _case_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 5).alias("case_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("place"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("statement"))


def evaluation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case of the rubric against its hits."""
    found = report.case_scores(_cases(spark, sf_dir), _case_hits(spark, sf_dir))
    return found.withColumn("first_expected_rank", F.col("first_expected_rank").cast("int"))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, cases passed, and recall."""
    found = report.run_report(report.case_scores(_cases(spark, sf_dir), _case_hits(spark, sf_dir)))
    return found.withColumn("recall", F.round("recall", 6))


_CASES_SQL = """cs as (
  select item_id as case_id, case when item_id % 2 = 0 then 'even' else 'odd' end as category, cast(item_id * 3 as varchar) as e from benchmark),
ch as (select doc_id // 5 as c, list(cast(doc_id as varchar) order by doc_id) as ids, lower(string_agg(text, chr(10) order by doc_id)) as said from documents group by 1),
sc as (select case_id, category, coalesce(list_contains(ids, e), false) as recall, coalesce(contains(said, 'the'), false) as includes_ok,
              not coalesce(contains(said, 'zzqx') or contains(said, 'no' || e), false) as excludes_ok, nullif(list_position(ids, e), 0) as p
       from cs left join ch on case_id = c)"""


QUERIES = {
    "eligible_facts": eligible_facts,
    "readable_facts": readable_facts,
    "current_facts": current_facts,
    "event_filters": event_filters,
    "fact_filters": fact_filters,
    "path_rules": path_rules,
    "fact_search": fact_search,
    "indexed_fact_search": indexed_fact_search,
    "fact_scores": fact_scores,
    "term_rarity": term_rarity,
    "event_search": event_search,
    "note_search": note_search,
    "sibling_search": sibling_search,
    "combined_search": combined_search,
    "reranked_search": reranked_search,
    "rerank_pool": rerank_pool,
    "merged_judgement": merged_judgement,
    "source_excerpts": source_excerpts,
    "prompt_context": prompt_context,
    "session_context": session_context,
    "evaluation_cases": evaluation_cases,
    "evaluation_report": evaluation_report,
}

_READABLE = "id not in (select target from ctl where control <> 'retracted')"
ORACLE_SQL = {
    "eligible_facts": ELIGIBLE_SQL,
    "readable_facts": f"with {sql.FACTS} select entity_id, id, status, case when status = 'active' then 'current' else 'non-current' end as label from f_docs where {_READABLE}",
    "current_facts": f"with {sql.FACTS} select entity_id, arg_min(id, ord) as fact_id, count(*) as facts from f_docs where status = 'active' and {_READABLE} group by 1",
    "event_filters": f"""with {sql.CONVERSATION_EVENTS} select role, count(*) filter (where scope_id = 'team') as scope, count(*) filter (where project = '/work/Project3') as project_name,
       count(*) filter (where project = '/work/Project4') as project_path, count(*) filter (where starts_with(source_id, 'conv:1') or starts_with(source_id, 'conv:2')) as sources from j_conv group by 1""",
    "fact_filters": FACT_FILTERS_SQL,
    "path_rules": """select doc_id, doc_id % 8 in (0, 1, 3, 4, 6) as writable, doc_id % 2 = 0 as request, doc_id % 3 < 2 as revision, doc_id % 4 > 1 as asks from documents""",
    "fact_search": f"with {sql.FACTS}, {sql.fact_scores(QUERY)} select row_number() over (order by score desc, path, ord, id) as rank, id, score from fs where score > 0 qualify rank <= 20",
    "indexed_fact_search": f"with {sql.FACTS}, {sql.fact_scores(QUERY)} select row_number() over (order by score desc, path, ord, id) as rank, id, score from fs where score > 0 qualify rank <= 20",
    "fact_scores": f"with {sql.FACTS}, {sql.fact_scores(QUERY)} select id, score from fs where score > 0",
    "term_rarity": f"""with {sql.FACTS}, w as (select unnest({sql.stems("statement || ' ' || title || ' ' || lang")}) as stem from el), n as (select count(*) as n from el)
       select stem, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from (select stem, count(*) as df from w group by 1), n""",
    "event_search": f"""with {sql.CONVERSATION_EVENTS}, src as (select * from j_conv where scope_id = 'personal' and project = '/work/Project2'), {sql.event_scores(EVENT_QUERY, "src")}
       select row_number() over (order by score desc, seq) as rank, event_id, seq, score from es where score > 0 qualify rank <= 20""",
    "note_search": f"with {sql.DOCUMENT_EVENTS}, {sql.event_scores(EVENT_QUERY, 'j_docs')} select event_id, score from es where score > 0",
    "sibling_search": SIBLING_SQL,
    "combined_search": COMBINED_SQL,
    "rerank_pool": f"with {_POOL_SQL} select id, place from pool",
    "merged_judgement": f"""with {_POOL_SQL}, r as (
       select b.id, case when p.id is not null then case when b.place = 2 then 0.0 else (b.place * 7 % 5) / 5.0 end else b.score end as score, p.id is not null as pooled, b.place as old
       from base b left join pool p using (id))
       select row_number() over (order by pooled desc, case when pooled then score end desc, old) as place, id, score from r qualify place <= 12""",
    "source_excerpts": EXCERPTS_SQL,
    "prompt_context": PROMPT_SQL,
    "session_context": f"""with {sql.FACTS}, r as (select * from f_docs where status = 'active' and {_READABLE})
       select ord, id, (select count(*) from r) as active_facts from r where entity_id = 'pref_user' order by ord limit 20""",
    "evaluation_cases": f"with {_CASES_SQL} select case_id, category, recall, includes_ok, excludes_ok, recall and includes_ok and excludes_ok as passed, p as first_expected_rank from sc",
    "evaluation_report": f"with {_CASES_SQL} select count(*) as total, count(*) filter (where recall and includes_ok and excludes_ok) as passed, round(avg(recall::double), 6) as recall from sc",
}
