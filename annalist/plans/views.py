"""The driver tables as the events, facts and controls that the operators take."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.schemas import FACT
from annalist.storage import shared_dir
from annalist.store import Store

#: The time at which queries are asked, so that results do not depend on the day.
NOW = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chat events; a project for each seventh part of the conversations, the turn's number as metadata."""
    c = table(spark, sf_dir, "conversations")
    source_id = F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), F.col("turn"))
    return c.select(
        F.concat(F.lit("evt_chat_"), source_id).alias("event_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.when(F.col("conv_id") % 5 == 0, "team").otherwise("personal").alias("scope_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        "role",
        F.lit("chat").alias("source_kind"),
        source_id.alias("source_id"),
        F.lit(None).cast("string").alias("custom_kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("/work/Project"), F.col("conv_id") % 7).alias("project"),
        F.concat(F.lit('{"turn":'), F.col("turn"), F.lit("}")).alias("metadata"),
    )


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes; many are long."""
    d = table(spark, sf_dir, "documents")
    source_id = F.concat(F.lit("md:"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(":"), F.left(F.sha2("text", 256), F.lit(16)))
    return d.select(
        F.concat(F.lit("evt_ide_"), source_id, F.lit("_0")).alias("event_id"),
        F.col("doc_id").alias("seq"),
        F.lit("personal").alias("scope_id"),
        F.lit("backfill").alias("session_id"),
        F.lit("note").alias("role"),
        F.lit("ide_history").alias("source_kind"),
        source_id.alias("source_id"),
        F.lit(None).cast("string").alias("custom_kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("/work/"), F.col("source")).alias("project"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')).alias("metadata"),
    )


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts of their source's workstream; status, dates and visibility follow from the id."""
    d = table(spark, sf_dir, "documents")
    n, now = F.col("doc_id"), F.lit(NOW).cast("timestamp")
    entity = F.when(n % 11 == 0, "pref_user").otherwise(F.concat(F.lit("w_"), F.col("source")))
    day = F.make_interval(days=F.lit(1))
    return d.select(
        entity.alias("entity_id"),
        text.entity_path(entity).alias("path"),
        n.alias("ord"),
        F.concat(F.lit("Notes of "), F.col("source")).alias("title"),
        F.array(F.col("lang")).alias("aliases"),
        F.when(F.col("source") == "src1", "shared").otherwise("private").alias("entity_visibility"),
        F.concat(F.lit("fact_"), F.left(F.sha2(F.concat_ws("|", entity, F.col("lang"), n.cast("string"), F.lower("text")), 256), F.lit(12))).alias("id"),
        F.col("lang").alias("predicate"),
        F.col("text").alias("statement"),
        F.when(n % 13 == 0, "disputed").when(n % 17 == 0, "superseded").otherwise("active").alias("status"),
        F.when(n % 3 == 0, "shared").when(n % 3 == 1, "public").otherwise("private").alias("visibility"),
        F.when(n % 19 == 0, now + day).alias("valid_from"),
        F.when(n % 23 == 0, now - day).when(n % 29 == 0, now + day).alias("valid_to"),
        F.when(n % 31 == 0, now).alias("expires_at"),
        F.array(F.concat(F.when(n % 2 == 0, "evt_ide_md:").otherwise("evt_chat_conv:"), n.cast("string"))).alias("source_ids"),
        n.alias("doc_id"),
    )


def label_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as controls on the documents' facts: toxic ones suppressed, those of no quality retracted, some deleted."""
    facts = document_facts(spark, sf_dir).select("doc_id", F.col("id").alias("target"))
    labels = table(spark, sf_dir, "labels")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("toxic") == 1, F.lit("suppressed")),
            F.when(F.col("quality") == 0, F.lit("retracted")),
            F.when(F.col("doc_id") % 37 == 0, F.lit("deleted")),
        )
    )
    return labels.join(facts, "doc_id").select(F.explode(kinds).alias("control"), "target")


def own_store(spark: SparkSession) -> Store:
    """A store of its own in the shared folder."""
    return Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


def stored_facts(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """The documents' facts, once for each id, in the shape in which they are stored; ``which`` of them by doc_id, on which the id depends."""
    f = document_facts(spark, sf_dir)
    f = (f if which is None else f.filter(which)).dropDuplicates(["id"])
    none = {name: F.lit(None).cast(kind) for name, kind in (("observed_at", "timestamp"), ("supersedes", "array<string>"))}
    fill = none | {"entity_type": text.entity_type(F.col("entity_id")), "kind": F.lit("explicit_assertion"), "evidence": F.substring("statement", 1, 60)}
    names = [field.split()[0] for field in FACT.split(", ")]
    return f.select(*(fill[c].alias(c) if c in fill else F.col(c) for c in names), "doc_id")
