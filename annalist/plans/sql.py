"""Pieces of DuckDB SQL that say what the columns of ``functions.text`` and the views say."""

from annalist.functions import words as W


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_-]+'), lambda x: x <> '')"


def stem(w: str) -> str:
    return (
        f"case when regexp_matches({w}, '^.{{3,}}ing$') then left({w}, -3) when regexp_matches({w}, '^.{{3,}}ed$') then left({w}, -2) "
        f"when regexp_matches({w}, '^.{{3,}}es$') and regexp_matches({w}, '(s|x|z|ch|sh)es$') then left({w}, -2) "
        f"when regexp_matches({w}, '^.{{2,}}[^s]s$') then left({w}, -1) else {w} end"
    )


def stems(text: str) -> str:
    return f"list_distinct(list_transform({tokens(text)}, lambda w: {stem('w')}))"


def content_words(text: str) -> str:
    found = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and not list_contains({listed(W.RESTATEMENT_STOPWORDS)}, x))"
    return f"list_distinct(list_transform({found}, lambda w: {stem('w')}))"


def content_terms(text: str) -> str:
    return f"list_filter({stems(text)}, lambda x: length(x) > 2 and not list_contains({listed(W.FACT_STOPWORDS)}, x))"


def slug(text: str) -> str:
    return f"rtrim(left(trim(regexp_replace(lower({text}), '[^a-z0-9]+', '_', 'g'), '_'), 60), '_')"


def family(entity: str) -> str:
    return rf"regexp_replace({entity}, '^(.*_.*)_\+?[0-9]+$', '\1')"


def bucket(entity: str) -> str:
    cases = " ".join(f"when starts_with({entity}, {quoted(k)}) then {quoted(v)}" for k, v in W.BUCKETS.items())
    return f"case {cases} else 'conversations' end"


def project_name(root: str) -> str:
    return f"split_part(rtrim({root}, '/'), '/', -1)"


def normalised(text: str) -> str:
    lines = rf"list_transform(regexp_split_to_array({text}, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^\s*([-+] )?', ''), '^[0-9]+[.] ', ''))"
    plain = f"translate(array_to_string({lines}, chr(10)), '‘’“”–—*`#>|', '''''\"\"--')"
    return rf"lower(trim(regexp_replace({plain}, '\s+', ' ', 'g')))"


CONVERSATION_EVENTS = """j_conv as (
  select 'evt_chat_conv:' || conv_id || ':' || turn as event_id, conv_id * 1000 + turn as seq,
         case when conv_id % 5 = 0 then 'team' else 'personal' end as scope_id, cast(conv_id as varchar) as session_id, role,
         'chat' as source_kind, 'conv:' || conv_id || ':' || turn as source_id, text as content,
         '/work/Project' || (conv_id % 7) as project, '{"turn":' || turn || '}' as metadata
  from conversations)"""

DOCUMENT_EVENTS = """j_docs as (
  select 'evt_ide_md:' || source || '/' || doc_id || ':' || left(sha256(text), 16) || '_0' as event_id, doc_id as seq,
         'personal' as scope_id, 'note' as role, 'ide_history' as source_kind,
         'md:' || source || '/' || doc_id || ':' || left(sha256(text), 16) as source_id, text as content,
         '/work/' || source as project, '{"lang":"' || lang || '"}' as metadata
  from documents)"""

DOCUMENT_FACTS = f"""f_docs as (
  select entity_id, 'memory/' || {bucket("entity_id")} || '/' || regexp_replace(entity_id, '^(pref_|p_|o_|w_|c_)', '') || '.md' as path,
         doc_id as ord, 'Notes of ' || source as title, lang, case when source = 'src1' then 'shared' else 'private' end as entity_visibility,
         'fact_' || left(sha256(entity_id || '|' || lang || '|' || doc_id || '|' || lower(text)), 12) as id, lang as predicate, text as statement,
         case when doc_id % 13 = 0 then 'disputed' when doc_id % 17 = 0 then 'superseded' else 'active' end as status,
         case doc_id % 3 when 0 then 'shared' when 1 then 'public' else 'private' end as visibility,
         case when doc_id % 19 = 0 then timestamp '2024-06-02' end as valid_from,
         case when doc_id % 23 = 0 then timestamp '2024-05-31' when doc_id % 29 = 0 then timestamp '2024-06-02' end as valid_to,
         case when doc_id % 31 = 0 then timestamp '2024-06-01' end as expires_at,
         [case when doc_id % 2 = 0 then 'evt_ide_md:' else 'evt_chat_conv:' end || doc_id] as source_ids, doc_id
  from (select *, case when doc_id % 11 = 0 then 'pref_user' else 'w_' || source end as entity_id from documents))"""

LABEL_CONTROLS = """ctl as (
  select 'suppressed' as control, id as target from labels join f_docs using (doc_id) where toxic = 1
  union all select 'retracted', id from labels join f_docs using (doc_id) where quality = 0
  union all select 'deleted', id from labels join f_docs using (doc_id) where doc_id % 37 = 0)"""

ELIGIBLE = """el as (
  select * from f_docs
  where status = 'active' and (expires_at is null or expires_at > timestamp '2024-06-01') and (valid_to is null or valid_to > timestamp '2024-06-01')
    and (valid_from is null or valid_from <= timestamp '2024-06-01') and id not in (select target from ctl))"""

FACTS = f"{DOCUMENT_FACTS}, {LABEL_CONTROLS}, {ELIGIBLE}"


def _query_terms(query: str):
    from annalist.operators.search import stem as one
    from annalist.operators.search import tokens as split

    return list(dict.fromkeys(map(one, split(query)))), split(query)


def fact_scores(query: str, source: str = "el") -> str:
    """CTEs ``fs``: every fact of ``source`` with its rounded score for a query."""
    terms, _ = _query_terms(query)
    exact = ", ".join(f"list_contains(st, {quoted(t)}) as e{k}" for k, t in enumerate(terms))
    near = ", ".join(
        f"len(list_filter(st, lambda x: starts_with(x, {quoted(t[:5])}))) > 0 as p{k}" if len(t.encode()) >= 5 else f"false as p{k}" for k, t in enumerate(terms)
    )
    df = ", ".join(f"count(*) filter (where e{k}) as df{k}" for k in range(len(terms)))
    part = " + ".join(
        f"case when e{k} then 1.0 when p{k} then {W.PREFIX_WEIGHT} else 0.0 end * ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * {W.STOPWORD_WEIGHT if t in W.FACT_STOPWORDS else 1.0}"
        for k, t in enumerate(terms)
    )
    hay = "statement || ' ' || title || ' ' || lang"
    return f"""
fw as (select *, {stems(hay)} as st from {source}),
ft as (select *, {exact}, {near} from fw),
fn as (select count(*) as n, {df} from ft),
fs as (select *, round({part}, 6) as score from ft, fn)"""


def event_scores(query: str, source: str) -> str:
    """CTE ``es``: every event of ``source`` with its rounded score for a query."""
    _, terms = _query_terms(query)

    def tf(text: str, t: str) -> str:
        return f"(length({text}) - length(replace({text}, {quoted(t)}, ''))) / {len(t)}"

    part = " + ".join(f"{W.STOPWORD_WEIGHT if t in W.EVENT_STOPWORDS else 1.0} * (ln(1 + {tf('lc', t)}) + ln(1 + {tf('lm', t)}))" for t in terms)
    return f"""
ev as (select *, lower(content) as lc, lower(metadata) as lm from {source}),
es as (select *, round(({part}) / ln(greatest(strlen(content) + strlen(metadata), 2000)), 6) as score from ev)"""
