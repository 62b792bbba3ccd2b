"""A training corpus from raw documents: five stages, each one operator over all rows of the last.

Every stage but the last returns the columns of ``documents``; the last adds the token ids.

Defined cases: a null text fails the quality rules, so do texts of under 50 words; rows without a
language are a language of their own; of equal rows, and of rows whose texts are similar by 0.8, one
stays, that of the least doc_id (a null one only where its class has no other); a row whose id
repeats with another text stays with that text; a benchmark item without text removes nothing; a
text of any length is read whole; empty tables give an empty result; further columns of any name
are carried to the last stage, which returns ids only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annalist.llm import bpe, decontaminate, quality_classifier, quality_rules, simhash
from annalist.llm.common import cut, cuts, drop_cuts, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity band of their language."""
    return quality_rules.filtered(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, accepts."""
    return quality_classifier.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose five-word shingles are similar by 0.8 or more."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of ``benchmark``."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids, and digests of them and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.coded_ids(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: Learned models and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    since = cuts()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_cuts(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
