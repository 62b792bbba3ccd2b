"""What one row, one batch or one task holds does not grow with the input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from annalist import journal
from annalist.functions import passages
from annalist.operators import change, extract
from annalist.plans import ingest
from annalist.sources import entities

FOLDER = "/root/testdata/sf0.001"


def by_sql(query, table="documents"):
    return duckdb.sql(query.replace(f"from {table}", f"from '{FOLDER}/{table}.parquet'")).fetchall()


def test_patterns_are_asked_for_lines_that_hold_the_needle_only(spark):
    lines = spark.createDataFrame([(1, "- [fact_1] a"), (2, "- [fact_12] b"), (3, "fact_12 and fact_1"), (4, None), (5, "none")], "n int, line string")
    needles = spark.createDataFrame([("fact_1",), ("a.c",)], "needle string")
    found = change.scrubbed(lines, needles, "line")
    assert sorted(r.n for r in found.collect()) == [2, 4, 5]
    assert "contains(line" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_batch_is_cut_in_slices(spark):
    texts = [None if k % 50 == 7 else f"line {k}\n\n" * (k % 9) + "x" * (k % 23) for k in range(3 * passages.SLICE_ROWS + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    found = {r.n: r.p for r in rows.select("n", passages.chunks_column(F.col("t"), 20).alias("p")).collect()}
    assert found == {k: None if t is None else passages.chunks(t, 20) for k, t in enumerate(texts)}


@pytest.mark.parametrize("ids", [16, 1024])
def test_entity_files_come_in_parts(spark, monkeypatch, ids):
    monkeypatch.setattr(ingest, "SEGMENT_IDS", ids)
    seen, real = [], entities.parse
    monkeypatch.setattr(entities, "parse", lambda made: seen.append(made) or real(made))
    found = ingest.entity_files(spark, FOLDER)
    names = ["entity_id", "path", "fact_id", "predicate", "statement", "status", "entity_visibility", "valid_from"]
    assert sorted(map(tuple, found.select(names).collect()), key=repr) == sorted(by_sql(ingest.ENTITY_SQL), key=repr)
    assert all(r.content.count('"predicate"') <= ids for r in seen[0].collect())


@pytest.mark.parametrize("ids", [16, 1024])
def test_framed_logs_come_in_segments(spark, monkeypatch, ids):
    monkeypatch.setattr(ingest, "SEGMENT_IDS", ids)
    seen, real = [], journal.framed
    monkeypatch.setattr(journal, "framed", lambda logs: seen.append(logs) or real(logs))
    found = ingest.framed_logs(spark, FOLDER)
    assert sorted(map(tuple, found.collect())) == sorted(by_sql(ingest.FRAMED_SQL))
    assert all(r.content.count("\n") <= 2 * ids for r in seen[0].collect())


def test_texts_are_normalised_and_exploded_once(spark):
    texts = spark.createDataFrame([(1, "Say  alphabetic things"), (2, "a lphabet ic"), (3, "xalphabet bcdefgh tail"), (4, None)], "n int, t string")
    quotes = spark.createDataFrame([(1, "alphabet"), (2, "bet bcdefgh"), (3, "alphabetic thi"), (4, "say alphabetic things"), (5, "t bcdefg")], "q int, quote string")
    found = extract.contained(texts, quotes, "t", "quote")
    assert sorted((r.n, r.q) for r in found.collect()) == [(1, 1), (1, 3), (1, 4), (3, 1), (3, 2), (3, 5)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_entity_files_hold_facts_without_values(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "src1") for k in range(5)]
    rows += [(5, "", "en", "src1"), (6, None, "de", "src1"), (7, "a", None, "src1"), (8, "=-", "", "src1"), (9, "-", "-", ""), (10, "b", "fr", None), (None, "c", "fr", "src2"), (12, " ", "en", "src3"), (13, "---\n\ufeff\0", "en", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = ingest.entity_files(spark, str(tmp_path))
    names = ["entity_id", "path", "fact_id", "predicate", "statement", "status", "entity_visibility", "valid_from"]
    wanted = duckdb.sql(ingest.ENTITY_SQL.replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, found.select(names).collect()), key=repr) == sorted(wanted, key=repr) and len(wanted) == 12


def test_a_statement_may_be_longer_than_the_limit_of_a_parser(spark):
    long = "x" * 20_000_001
    made = entities.rendered({"id": "w_a", "type": "project", "title": "a", "facts": [{"id": "f", "predicate": "p", "statement": long}]})
    files = spark.createDataFrame([("a.md", made)], "file string, content string")
    assert [tuple(r) for r in entities.parse(files).select("id", F.char_length("statement")).collect()] == [("f", len(long))]
