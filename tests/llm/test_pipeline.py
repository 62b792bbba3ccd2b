import itertools
from collections import Counter

import pytest

import corpus_pipeline
from annalist.llm import decontaminate, quality_rules
from annalist.llm.common import cut
from tests.llm import fixtures


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    fixtures.documents(spark).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k != 104)) for k in [*range(20), 104]], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(fixtures.prose(4, 80).split()[10:40])), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs
        docs = cut(stage(spark, docs, folder))
        assert docs.columns == columns, name
        after = Counter(map(tuple, docs.collect()))
        assert after <= before, name
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality_rules.judged(given).filter("kept").collect()}
        if name == "near_dedup":
            assert docs.count() == given.count() - _copies(given)
        if name == "decontamination":
            bad = decontaminate.judged(given.select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated")
            assert {r.doc_id for r in bad.collect()} == {4} and 4 not in {r.doc_id for r in docs.collect()}
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    assert all(len(r.ids) == r.n_tokens for r in out)


def _copies(docs):
    """Rows beyond the first of each class of texts whose five-word shingles are similar by 0.8, by brute force."""
    texts = [r.text.lower().split() for r in docs.collect()]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(range(len(sets)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return sum(root(k) != k for k in range(len(sets)))


def test_run_is_all_stages(spark, folder):
    found = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert 4 not in found and 105 not in found and {0, 1, 3, 5} <= found


def test_run_on_empty_tables(spark, tmp_path):
    fixtures.nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
