"""Every query of the library against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from annalist.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_kept_turns_are_those_of_one_pass(spark, duck):
    turns = duck.sql("select conv_id, turn, conv_id || ':' || (turn + 1) // 2, text from conversations order by 1, 2").fetchall()
    kept, ids, texts = [], set(), set()
    for conv, turn, own, text in turns:
        if own not in ids and text not in texts:
            kept.append((conv, turn))
            ids.add(own)
            texts.add(text)
    assert sorted(tuple(r) for r in registry.QUERIES["journal_first_kept"](spark, FOLDER).collect()) == kept
    assert len(kept) < len(turns)


def test_prompts_are_packed_as_in_one_pass(spark):
    from annalist.functions import passages
    from annalist.operators import extract
    from annalist.plans.views import conversation_events

    said = extract.candidates(conversation_events(spark, FOLDER).select("seq", "role", "content")).orderBy("seq", "k").collect()
    packs = list(passages.packed(said, lambda r: len(r.said.encode()), extract.BATCH_BYTES))
    wanted = [(p, len(own), sum(len(r.said.encode()) for r in own), own[0].seq, own[-1].seq) for p, own in enumerate(packs)]
    assert sorted(tuple(r) for r in registry.QUERIES["prompt_packs"](spark, FOLDER).collect()) == wanted


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_an_erasure_has_long_statements_too(duck):
    # Whatever the length of its statement, a fact of the erased source is in no revision.
    assert duck.sql("select count(*) from documents where source = 'src2' and doc_id % 11 > 0 and length(text) >= 200").fetchall()[0][0] > 0
    kept = "'fact_' || left(sha256('w_src2|' || lang || '|' || doc_id || '|' || lower(text)), 12)"
    assert duck.sql(f"select count(*) from ({registry.ORACLE_SQL['erased_history']}) where id in (select {kept} from documents where source = 'src2' and doc_id % 11 > 0)").fetchall()[0][0] == 0
